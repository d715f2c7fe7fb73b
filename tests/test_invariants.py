"""Relations that hold between answers, whatever the graph."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import followgraph as fg
from graphs import random_multigraph


@pytest.fixture(scope="module", params=[11])
def edges(frame, request):
    return frame(random_multigraph(request.param, nodes=25, edges=200)).cache()


def walks(edges):
    return int(fg.triangle_count(edges).first().closed_walks)


def paths(edges):
    return int(fg.two_path_total(edges).first().two_paths)


def test_total_equals_rows(edges):
    assert paths(edges) == fg.two_paths(edges).count()
    assert walks(edges) == fg.triangle_edges(edges).count()


def test_reversal(edges):
    assert walks(fg.reverse(edges)) == walks(edges)
    assert paths(fg.reverse(edges)) == paths(edges)


def test_copies_scale(edges):
    thrice = edges.unionAll(edges).unionAll(edges)
    assert walks(thrice) == 27 * walks(edges)
    assert paths(thrice) == 9 * paths(edges)


def test_relabelling(edges):
    moved = edges.select(
        (F.col("follower") * -3 + 7).alias("follower"), (F.col("followee") * -3 + 7).alias("followee")
    )
    assert walks(moved) == walks(edges)


def test_followers_add_up(edges):
    total = fg.follower_count(edges).agg(F.sum("followers")).first()[0]
    assert total == fg.edge_count(edges).first().edge_count == edges.count()


def test_degrees_add_up(edges):
    ins, outs = fg.degrees(edges).agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert ins == outs == edges.count()
