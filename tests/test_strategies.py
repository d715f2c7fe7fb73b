"""All strategies against brute force on random multigraphs, hubs split or not."""

from __future__ import annotations

import functools
import math
import operator
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import followgraph as fg
from followgraph.operators import counts, paths, triangles
from graphs import hub_graph, random_multigraph, side_by_side

PAIRS = side_by_side(
    random_multigraph(0),
    random_multigraph(1),
    hub_graph(),
    [(1, 1)] * 50 + [(1, 2), (2, 1), (2, 2)],
)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges(frame):
    return frame(PAIRS).cache()


@pytest.mark.parametrize("strategy", triangles.STRATEGIES)
def test_closed_walks(edges, strategy):
    want = brute.closed_walks(PAIRS)
    # Few nodes ranked by degree for the rows, all of them for the count.
    assert bag(fg.closed_walks(edges, strategy, ranked_nodes=2)) == want
    total = want.total()
    count = fg.triangle_count(edges, strategy)
    assert [tuple(map(int, r)) for r in count.collect()] == [(total, total // 3)]


@pytest.mark.parametrize("threshold", ["-1", "200", "10m"])
def test_any_size_is_answered_whatever_is_replicated(spark, edges, monkeypatch, threshold):
    monkeypatch.setattr(triangles, "PAGE_ENTRIES", 2)
    want = brute.closed_walks(PAIRS)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, threshold)
        for strategy in ("broadcast", "adjacency", "auto"):
            assert int(fg.triangle_count(edges, strategy).first().closed_walks) == want.total()
        assert bag(fg.closed_walks(edges, "adjacency")) == want
        assert fg.triangle_walks(edges).count() == want.total()
    finally:
        for name in names:
            spark.conf.unset(name)


def test_small_cells_of_the_walk_grid(edges, monkeypatch):
    monkeypatch.setattr(triangles, "LEAST_CELL", 1)
    monkeypatch.setattr(triangles, "CELLS_PER_PARTITION", 1000)
    assert bag(fg.closed_walks(edges, "shuffle")) == brute.closed_walks(PAIRS)


def test_sliced_closing_edges(edges, monkeypatch):
    monkeypatch.setattr(triangles, "CLOSING_ROWS", 2)
    assert bag(fg.closed_walks(edges, "shuffle")) == brute.closed_walks(PAIRS)


@pytest.mark.parametrize("cell_rows", [1, 10_000])
def test_two_paths(edges, cell_rows):
    assert bag(fg.two_paths(edges, cell_rows=cell_rows)) == brute.two_paths(PAIRS)


def test_few_hot_middles(edges):
    got = fg.two_paths(edges, cell_rows=1, max_hot=2)
    assert bag(got) == brute.two_paths(PAIRS)


def test_hub_is_spread_over_cells(frame):
    hot = paths.hot_middles(fg.collapse(frame(hub_graph())), 5, 3).collect()
    assert 0 in {r["_hot"] for r in hot} and len(hot) <= 6
    # As many slices as there are shuffle partitions, at most.
    hub = next(r for r in hot if r["_hot"] == 0)
    assert hub["_ins"] == hub["_outs"] == 3


def test_close_paths(edges):
    got = fg.close_paths(fg.two_paths(edges), edges)
    assert bag(got) == brute.closed_walks(PAIRS)


@pytest.mark.parametrize("endpoint", ["followee", "follower"])
def test_follower_counts(edges, endpoint):
    want = {k: v.total() for k, v in brute.neighbours(PAIRS, endpoint).items()}
    for strategy in counts.STRATEGIES:
        got = fg.follower_count(edges, strategy, endpoint)
        assert dict(map(tuple, got.collect())) == want, strategy


def test_degrees(edges):
    got = {r.node: (r.in_degree, r.out_degree) for r in fg.degrees(edges).collect()}
    assert got == brute.degrees(PAIRS)


@pytest.mark.parametrize("endpoint", ["followee", "follower"])
@pytest.mark.parametrize("page_size", [4, 10_000])
def test_adjacency_pages(edges, endpoint, page_size):
    want = brute.neighbours(PAIRS, endpoint)
    got = {}
    pages = Counter()
    for r in fg.adjacency(edges, endpoint, page_size).collect():
        ids = [x.id for x in r.neighbours]
        assert ids == sorted(set(ids))
        assert r.n == sum(x.copies for x in r.neighbours)
        got.setdefault(r[endpoint], Counter()).update({x.id: x.copies for x in r.neighbours})
        pages[r[endpoint]] += 1
    assert got == want
    if page_size == 10_000:
        assert set(pages.values()) == {1}
    else:
        assert all(pages[k] == 1 for k, v in want.items() if len(v) <= page_size)
        assert all(pages[k] <= -(-len(v) // page_size) for k, v in want.items())
        assert max(pages.values()) > 1 or max(map(len, want.values())) <= page_size


def pages_of(df, key="followee"):
    return {(r[key], r.page): [x.id for x in r.neighbours] for r in df.collect()}


def test_pages_depend_on_their_node_alone(frame):
    node = [(i * 2**31, 7) for i in range(400)]
    others = [(i % 90, 1000 + i) for i in range(900)]
    alone = pages_of(fg.in_adjacency(frame(node), 20))
    for max_hot in (2, 100_000):
        both = pages_of(fg.adjacency(frame(node + others), "followee", 20, max_hot))
        assert {k: v for k, v in both.items() if k[0] == 7} == alone
    assert len(alone) > 15 and max(map(len, alone.values())) < 40
    shifted = pages_of(fg.in_adjacency(frame([(i << 22, 7) for i in range(400)]), 20))
    assert len(shifted) > 15 and max(map(len, shifted.values())) < 40


def test_fold_with_another_merge(edges):
    lowest = fg.fold_by_key(
        edges,
        "followee",
        F.col("follower"),
        F.lit(2**62).cast("bigint"),
        lambda a, b: F.least(a, b),
        "lowest",
    )
    want = {k: min(v) for k, v in brute.neighbours(PAIRS, "followee").items()}
    assert dict(map(tuple, lowest.collect())) == want


FOLDS = {"sum": sum, "min": min, "max": max, "bit_xor": lambda v: functools.reduce(operator.xor, v)}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_named_folds_are_combined_first(edges, name):
    zero = {"min": 2**62, "max": -(2**62)}.get(name, 0)
    value = F.col("follower") % 1000
    got = fg.fold_by_key(edges, "followee", value, F.lit(zero).cast("bigint"), name, "out")
    held = {}
    for a, b in PAIRS:
        held.setdefault(b, []).append(int(math.fmod(a, 1000)))
    assert dict(map(tuple, got.collect())) == {k: FOLDS[name](v) for k, v in held.items()}
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in shown and "collect_list" not in shown


def test_folds_of_flags_and_nulls(spark):
    df = spark.createDataFrame([(1, True, None), (1, False, 6), (2, None, None), (3, True, 3)], "k int, b boolean, v int")
    any_, all_ = (fg.fold_by_key(df, "k", F.col("b"), F.lit(z), m, "out") for z, m in ((False, "bool_or"), (True, "bool_and")))
    assert sorted(map(tuple, any_.collect())) == [(1, True), (2, False), (3, True)]
    assert sorted(map(tuple, all_.collect())) == [(1, False), (2, True), (3, True)]
    both = fg.fold_by_key(df, "k", F.col("v"), F.lit(0), "bit_or", "out")
    assert sorted(map(tuple, both.collect())) == [(1, 6), (2, 0), (3, 3)]
    with pytest.raises(ValueError):
        fg.fold_by_key(df, "k", F.col("v"), F.lit(0), "mean", "out")


def test_aggregate_with_other_steps(edges):
    highest = fg.aggregate_by_key(
        edges, "followee", "follower", F.max("follower"), F.max, "highest", slices=3
    )
    want = {k: max(v) for k, v in brute.neighbours(PAIRS, "followee").items()}
    assert dict(map(tuple, highest.collect())) == want


def test_counts_beyond_bigint(frame, spark):
    # 3 * 10^6 copies of one self-loop: the cube passes 2^63.
    loops = spark.range(3_000_000).select(
        F.lit(7).cast("bigint").alias("follower"), F.lit(7).cast("bigint").alias("followee")
    )
    row = fg.triangle_count(loops).first()
    assert int(row.closed_walks) == 27 * 10**18
    assert int(row.triangles) == 9 * 10**18
