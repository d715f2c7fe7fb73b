"""Adjacency lists, in pages of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from followgraph.functions.columns import page_of
from followgraph.operators.edges import check_endpoint, collapse, other_endpoint
from followgraph.plans.skew import MAX_HOT_KEYS, is_hot

PAGE_SIZE = 10_000


def adjacency(
    edges: DataFrame,
    endpoint: str,
    page_size: int = PAGE_SIZE,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Neighbours of every ``endpoint`` node: (endpoint, page, neighbours, n).

    ``neighbours`` is an array of (id, copies) sorted by id, and ``n`` the
    number of edges it stands for. A node with m distinct neighbours has
    ceil(m / page_size) pages; an entry's page is a hash of its id, so a page
    holds about ``page_size`` of them, and no other node has a say.

    Nodes that hold at least 1 / max_hot of all distinct edges, and more than
    a page, are split at once: their sizes are broadcast, and their entries
    are shuffled by page. All other nodes stay whole in one shuffle by node,
    which serves their sizes and their pages.
    """
    key = check_endpoint(endpoint)
    other = other_endpoint(endpoint)
    pairs = collapse(edges)
    # n is read (it is always positive) so that this pass and the main one
    # share the shuffle of collapse.
    sizes = pairs.groupBy(F.col(key).alias("_hot")).agg(F.expr("count_if(n > 0) AS _size"))
    hot = sizes.where(is_hot(sizes, "_size", page_size + 1, max_hot))
    hot = F.broadcast(hot)
    same = F.expr(f"{key} = _hot")
    large = pairs.join(hot, same)
    small = pairs.join(hot, same, "left_anti").withColumn(
        "_size", F.count(F.lit(1)).over(Window.partitionBy(key))
    )

    def paged(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_pages", F.expr(f"(_size + {page_size - 1}L) div {page_size}L"))
            .selectExpr(key, f"{page_of(other, '_pages')} AS page", f"struct({other} AS id, n AS copies) AS entry")
            .groupBy(key, "page")
            .agg(F.expr("array_sort(collect_list(entry)) AS neighbours"), F.expr("sum(entry.copies) AS n"))
        )

    return paged(small).unionAll(paged(large))


def in_adjacency(edges: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Followers of every followee."""
    return adjacency(edges, "followee", page_size)


def out_adjacency(edges: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Followees of every follower."""
    return adjacency(edges, "follower", page_size)
