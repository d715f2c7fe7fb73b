"""Shapes of the physical plans: what is scanned, shuffled, sorted and replicated."""

from __future__ import annotations

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import followgraph as fg
from followgraph.operators import counts, paths, triangles
from followgraph.plans.skew import is_hot
from graphs import hub_graph, random_multigraph

FOLDER = pathlib.Path("/root/testdata/sf0.001")

needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plan(df):
    """The plan before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name):
    return len(re.findall(rf"[-*: ]{name}\b", plan(df)))


def shuffles(df):
    return nodes(df, "Exchange hashpartitioning")


@pytest.fixture(scope="module")
def edges(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "hub")
    frame(hub_graph()).write.parquet(path)
    return spark.read.parquet(path)


def test_follower_count_plans_differ(edges):
    plans = {s: fg.follower_count(edges, s) for s in ("reduce", "group", "fold", "aggregate")}
    assert shuffles(plans["reduce"]) == 1
    assert "partial_sum" in plan(plans["reduce"])
    assert shuffles(plans["aggregate"]) == 2
    assert shuffles(plans["fold"]) == 1 and "partial_sum" in plan(plans["fold"])
    pairs = fg.fold_by_key(edges, "followee", F.lit(1), F.lit(0), lambda a, b: a + b, "n")
    assert "collect_list" in plan(pairs)
    assert "REPARTITION_BY_COL" in plan(plans["group"])
    assert shuffles(plans["group"]) == 2
    assert not any("collect_list" in plan(plans[s]) for s in ("reduce", "group", "fold", "aggregate"))


def test_narrow_operators_do_not_shuffle(edges):
    for df in (fg.truncate(edges, 5), fg.reverse(edges), fg.tag_endpoints(edges)):
        assert "Exchange" not in plan(df)


def test_one_shuffle_each(edges):
    assert shuffles(fg.collapse(edges)) == 1
    assert shuffles(fg.degrees(edges)) == 1
    assert shuffles(fg.two_path_total(edges)) == 1
    assert "Join" not in plan(fg.two_path_total(edges))


def test_triangle_plans_differ(edges):
    by = {s: fg.triangle_count(edges, s) for s in triangles.STRATEGIES}
    assert nodes(by["shuffle"], "SortMergeJoin") == 2
    for s in triangles.STRATEGIES:
        assert "Union" not in plan(by[s])
        by[s].collect()
        final = plan(by[s]).split("== Initial Plan ==")[0]
        # The join kind is settled when sizes are known; only the shuffle strategy insists.
        assert ("SortMergeJoin" in final) == (s == "shuffle"), s
    assert "array_intersect" not in plan(by["adjacency"])
    assert "collect_list" in plan(by["adjacency"])
    assert "collect_list" not in plan(by["broadcast"])


def test_strategy_is_chosen_from_the_plan(edges):
    assert triangles.strategy_for(edges) == "broadcast"
    assert triangles.strategy_for(edges, max_bytes=1) == "shuffle"
    assert triangles.strategy_for(edges, "adjacency", 1) == "adjacency"
    with pytest.raises(ValueError):
        triangles.strategy_for(edges, "fastest")


def tasks_of(df, *counted):
    """Rows in each task of the stage that makes ``df``."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("t")).count().collect()]


def test_walks_of_one_node_are_spread(spark, frame, monkeypatch):
    """A node between many larger ones: few edges, but nearly all walks of two steps."""
    monkeypatch.setattr(triangles, "LEAST_CELL", 100)
    hubs = range(1, 121)
    pairs = [(0, h) for h in hubs] + [(h, 0) for h in hubs]
    pairs += [(h, 1000 + 10 * h + k) for h in hubs for k in range(130)]
    pairs += [(1000 + 10 * h + k, h) for h in hubs for k in range(130)]
    ups, downs, _ = triangles._sides(fg.collapse(frame(pairs)), triangles.RANKED_NODES)
    ups, downs = (triangles.deal_out(leg, *triangles.CELL) for leg in (ups, downs))
    walks = ups.where("a = 0").join(downs.where("a = 0").hint("merge"), ["a", "_rows", "_columns"])
    sizes = tasks_of(walks)
    assert sum(sizes) == 120 * 120 and len(sizes) > 1
    assert max(sizes) <= 2 * sum(sizes) / 3


def test_group_spreads_copies_from_one_split(spark):
    one = spark.range(0, 1_000_000, 1, 1).selectExpr("1L AS follower", "id % 2 AS followee")
    part = counts.slice_of(3, "follower", "spark_partition_id()", counts.row_block())
    dealt = one.selectExpr("followee", f"{part} AS _slice").repartition(3, "followee", "_slice")
    sizes = tasks_of(dealt)
    assert len(sizes) > 1 and max(sizes) < 900_000
    assert dict(map(tuple, fg.follower_count(one, "group").collect())) == {0: 500_000, 1: 500_000}


def test_fold_collects_bounded_arrays(spark):
    one = spark.range(0, 400_000, 1, 1).selectExpr("1L AS follower", "2L AS followee")
    count = fg.fold_by_key(one, "followee", F.lit(1), F.lit(0), lambda a, b: a + b, "n")
    assert count.first().n == 400_000
    block = one.selectExpr(f"{counts.row_block()} AS b").groupBy("b").count()
    assert block.agg(F.max("count")).first()[0] <= 65_536


def test_copies_of_a_path_reach_all_tasks(frame):
    edges = frame([(1, 1)] * 60, parts=2)
    closed = fg.close_paths(fg.two_paths(edges), edges)
    sizes = tasks_of(closed)
    assert sum(sizes) == 60**3 and len(sizes) >= 2


def test_paths_no_edge_can_close_are_not_shuffled(spark):
    """Of 10,000 paths, the few whose ends an edge may join are all that is counted and shuffled."""
    given = spark.range(10_000).selectExpr("id AS src", "-1L AS mid", "id + 1000000 AS dst")
    pairs = [(1_000_007, 7), (1_000_008, 9), (1_000_007, 7), (5, 1_000_005), (-3, -4)]
    edges = spark.createDataFrame(pairs, "follower bigint, followee bigint")
    closing = fg.collapse(edges).selectExpr("follower AS dst", "followee AS src", "n")
    kept = paths._ending_at(paths._ending_at(given, "dst", closing), "src", closing)
    assert kept.where("src = 7").count() == 1 and kept.count() < 20
    closed = fg.close_paths(given, edges)
    assert len(re.findall("BroadcastHashJoin.*LeftSemi", plan(closed))) == 2
    assert list(map(tuple, closed.collect())) == [(7, -1, 1_000_007)] * 2


def test_marks_of_sparse_nodes_are_bounded(spark, monkeypatch):
    """Every node of the closing edges passes, with few numbers as well, whatever its id."""
    monkeypatch.setattr(paths, "MARKS", 4)
    ids = [0, 1, -1, 64, -64, 2**62, -(2**63), 2**63 - 1, *range(640, 64_000, 640)]
    edges = spark.createDataFrame([(i, -i - 1) for i in ids], "follower bigint, followee bigint")
    given = edges.selectExpr("followee AS src", "5L AS mid", "follower AS dst")
    assert sorted(fg.close_paths(given, edges).collect()) == sorted(given.collect())


def test_edges_on_no_path_are_not_shuffled_to_their_middle(spark, monkeypatch):
    """Of 5,000 edges, those to nodes without edges out and from nodes without edges in are dropped, but for a few."""
    kept, grid = {}, paths.grid_paths
    monkeypatch.setattr(paths, "grid_paths", lambda ins, outs, *more: kept.update(ins=ins, outs=outs) or grid(ins, outs, *more))
    edges = spark.range(5_000).selectExpr("id + 100000000 AS follower", "id AS followee")
    edges = edges.unionAll(spark.createDataFrame([(7, 900_000_000), (7, 900_000_000)], edges.schema))
    found = fg.two_paths(edges)
    assert list(map(tuple, found.collect())) == [(100_000_007, 7, 900_000_000)] * 2
    assert 1 <= kept["ins"].count() < 20 and 1 <= kept["outs"].count() < 20


def test_building_a_query_runs_no_job(spark):
    if not FOLDER.exists():
        pytest.skip("no test tables")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    for name, query in contract._graph_queries().items():
        spark.read.parquet(f"{FOLDER}/lineitem.parquet")
        start = set(tracker.getJobIdsForGroup(None))
        query(spark, str(FOLDER))
        # Only the schema of a file is read.
        assert len(set(tracker.getJobIdsForGroup(None)) - start) <= 2, name
    assert before is not None


def test_closing_join_has_both_keys(edges):
    shown = plan(fg.triangle_count(edges))
    assert re.search(r"SortMergeJoin \[b#\d+L, c#\d+L, _slice#\d+L\]", shown)


def test_hubs_are_no_middle_nodes(edges):
    """The hub has edges to and from all leaves; ranking keeps its groups small."""
    first, last, _ = triangles._legs(triangles._ranked(fg.collapse(edges), triangles.RANKED_NODES))
    for side in (first, last):
        largest = side.groupBy("a").count().agg(F.max("count")).first()[0]
        assert largest <= 3


def test_broadcast_of_ranks_is_bounded(edges):
    pairs = fg.collapse(edges)
    distinct = pairs.count()
    for ranked_nodes in (1, 5, 1_000_000):
        kept = triangles._ranks(pairs, ranked_nodes).count()
        assert kept <= max(ranked_nodes, (2 * distinct) ** 0.5)


def test_hot_keys_are_bounded(edges):
    counted = fg.follower_count(edges)
    for max_keys in (1, 2, 7):
        hot = counted.where(is_hot(counted, "followers", 1, max_keys))
        assert hot.count() <= max_keys


def test_hot_paths_reach_many_tasks(edges):
    """With small cells the hub's paths are made of many join keys."""
    pairs = fg.collapse(edges)
    hot = paths.hot_middles(pairs, 10, 100)
    half = paths._half(pairs, hot, "followee", "follower", 10)
    cells = half.where("mid = 0").groupBy("_ins", "_outs").count()
    assert cells.count() == 9
    assert cells.agg(F.max("count")).first()[0] <= 60


def test_path_join_is_not_merged_into_few_tasks(edges):
    """Adaptive execution leaves shuffles of a stated number of partitions alone."""
    assert plan(fg.two_paths(edges)).count("REPARTITION_BY_NUM") == 2


@needs_tables
@pytest.mark.parametrize("name", sorted(contract._graph_queries()))
def test_registered_plans(spark, name):
    shown = plan(contract.queries()[name](spark, str(FOLDER)))
    for absent in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "ExistingRDD"):
        assert absent not in shown
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", shown):
        assert len(schema.split(",")) <= 2


@needs_tables
def test_bound_reaches_the_scan(spark):
    shown = plan(contract.queries()["edges_truncated"](spark, str(FOLDER)))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", shown).group(1)
    assert "LessThan(l_suppkey," in pushed and "LessThan(l_partkey," in pushed


def rows_scanned(df):
    """Rows that the file scans of an executed plan gave out."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name.startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_clustered_edges_below_a_bound_are_all_that_is_read(spark, frame, tmp_path):
    pairs = [(a, (a * 7 + k) % 5000) for a in range(5000) for k in range(8)] + [(4999, b) for b in range(5000)] + [(1, 2)] * 9
    fg.write_clustered(frame(pairs), f"{tmp_path}/clustered", 4096)
    want = {(a, b) for a, b in pairs if max(a, b) < 100}
    got = fg.read_clustered(spark, f"{tmp_path}/clustered", 100)
    assert {(r.follower, r.followee): r.n for r in got.collect()} == {p: pairs.count(p) for p in want}
    everything = fg.read_clustered(spark, f"{tmp_path}/clustered")
    assert rows_scanned(everything) == len(set(pairs))
    assert rows_scanned(got) < len(set(pairs)) / 10


@pytest.fixture(scope="module")
def store(spark, frame, tmp_path_factory):
    pairs = random_multigraph(5) + hub_graph()
    path = str(tmp_path_factory.mktemp("store") / "edges")
    kept = fg.EdgeStore.write(frame(pairs), "plan_store", path, buckets=4, cell_rows=10)
    yield kept, frame(pairs)
    kept.drop()


def test_stored_edges_are_joined_without_a_shuffle(store):
    kept, edges = store
    assert kept.table("hot").count() > 0 and kept.table("ins").count() > 0
    for got, want in ((kept.degrees(), fg.degrees(edges)), (kept.two_paths(), fg.two_paths(edges))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # All edges counted, split in four tables; only rows of hot nodes are moved.
    cold = kept.table("ins").join(kept.table("outs").hint("merge"), F.expr("plan_store_ins.followee = plan_store_outs.follower"))
    assert "SortMergeJoin" in plan(cold) and "Exchange" not in plan(cold)
    both = kept.degrees()
    assert plan(both).count("Exchange") == plan(both).count("Exchange hashpartitioning") == 2


def test_single_rows_are_repeated_by_a_constant(spark):
    from followgraph.functions.columns import each, repeat_rows

    rows = spark.createDataFrame([(1, 1), (2, 3), (3, 1), (4, 70_000)], "a bigint, n bigint")
    got = repeat_rows(rows, "n").groupBy("a").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 3), (3, 1), (4, 70_000)]
    assert "if ((n" in plan(rows.selectExpr(each("n"))).lower()
