"""Directed-edge analytics on Spark DataFrames.

An edge frame is any DataFrame with two bigint columns, ``follower`` and
``followee``: a bag of rows in which repeated edges and self-loops count.
Every operator takes and returns DataFrames and is lazy unless it says it
checks a size.
"""

from followgraph.operators.adjacency import adjacency, in_adjacency, out_adjacency
from followgraph.operators.counts import (
    aggregate_by_key,
    edge_count,
    fold_by_key,
    follower_count,
    group_count_by_key,
    reduce_by_key,
)
from followgraph.operators.degrees import degrees, two_path_by_node, two_path_total
from followgraph.operators.edges import (
    collapse,
    where_multiple,
    reverse,
    tag_endpoints,
    truncate,
)
from followgraph.operators.paths import close_paths, two_paths
from followgraph.operators.triangles import (
    closed_walks,
    triangle_count,
    triangle_edges,
    triangle_triples,
    triangle_walks,
)
from followgraph.sources.readers import read_edges, read_two_paths
from followgraph.sources.sinks import write_answer, write_result
from followgraph.sources.store import EdgeStore, read_clustered, write_clustered

__all__ = [
    "EdgeStore",
    "adjacency",
    "aggregate_by_key",
    "close_paths",
    "closed_walks",
    "collapse",
    "degrees",
    "edge_count",
    "fold_by_key",
    "follower_count",
    "group_count_by_key",
    "in_adjacency",
    "out_adjacency",
    "read_clustered",
    "read_edges",
    "read_two_paths",
    "reduce_by_key",
    "where_multiple",
    "reverse",
    "tag_endpoints",
    "triangle_count",
    "triangle_edges",
    "triangle_triples",
    "triangle_walks",
    "truncate",
    "two_path_by_node",
    "two_path_total",
    "two_paths",
    "write_answer",
    "write_clustered",
    "write_result",
]
