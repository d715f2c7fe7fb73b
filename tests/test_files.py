"""Reading edge files, writing results, and the batch jobs."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

import __spark_entry__ as contract
import followgraph as fg
from followgraph.sources.scratch import scratch_folder, shared_folder
from followgraph import jobs
from followgraph.sources import sinks
from graphs import DIRTY, DIRTY_EDGES, HUNDREDS, TINY


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def lines(folder):
    return sorted(
        line for part in folder.glob("part-*") for line in part.read_text().splitlines()
    )


@pytest.fixture
def edge_file(tmp_path):
    def write(pairs, name="edges.csv"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(f"{a},{b}" for a, b in pairs))
        return str(path)

    return write


def test_permissive(spark, tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text(DIRTY)
    edges = fg.read_edges(spark, str(path))
    assert edges.dtypes == [("follower", "bigint"), ("followee", "bigint")]
    assert bag(edges) == sorted(DIRTY_EDGES)
    assert edges.count() == len(DIRTY_EDGES)


@pytest.mark.parametrize("bad", ["foo,bar", "4,", ",100", "5", "1.5,2"])
def test_failfast(spark, tmp_path, bad):
    path = tmp_path / "bad.csv"
    path.write_text(f"1,2\n{bad}\n3,4\n")
    assert bag(fg.read_edges(spark, str(path))) == [(1, 2), (3, 4)]
    with pytest.raises(PySparkException):
        fg.read_edges(spark, str(path), mode="failfast").collect()
    with pytest.raises(PySparkException):
        fg.read_edges(spark, str(path), mode="failfast").count()


def test_failfast_accepts_good_lines(spark, tmp_path):
    path = tmp_path / "good.csv"
    path.write_text("1,2\n\n1,2,9\n 7,8\n-5,6")
    got = fg.read_edges(spark, str(path), mode="failfast")
    assert bag(got) == [(-5, 6), (1, 2), (1, 2), (7, 8)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        fg.read_edges(spark, "nowhere", mode="lenient")


def test_folders(spark, tmp_path, edge_file):
    edge_file([(1, 2)], "in/a.csv")
    edge_file([(3, 4)], "in/deep/b.csv")
    assert bag(fg.read_edges(spark, str(tmp_path / "in"))) == [(1, 2)]
    assert bag(fg.read_edges(spark, str(tmp_path / "in"), recursive=True)) == [(1, 2), (3, 4)]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(300, 2), (100, 3)], "followee bigint, followers bigint")
    for fmt, want in {
        "tuple": ["(100,3)", "(300,2)"],
        "csv": ["100,3", "300,2"],
        "tsv": ["100\t3", "300\t2"],
    }.items():
        out = tmp_path / fmt
        fg.write_result(df, str(out), fmt)
        assert lines(out) == want
    fg.write_result(df, str(tmp_path / "pq"), "parquet")
    assert bag(spark.read.parquet(str(tmp_path / "pq"))) == [(100, 3), (300, 2)]
    fg.write_result(df.where("followee = 300").select("followers"), str(tmp_path / "one"), "text")
    assert lines(tmp_path / "one") == ["2"]
    with pytest.raises(ValueError):
        fg.write_result(df, str(tmp_path / "x"), "text")
    with pytest.raises(ValueError):
        fg.write_result(df, str(tmp_path / "x"), "xml")


def test_existing_output(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n bigint")
    out = str(tmp_path / "out")
    fg.write_result(df, out)
    with pytest.raises(PySparkException, match="PATH_ALREADY_EXISTS"):
        fg.write_result(df, out)
    fg.write_result(df, out, mode="overwrite")
    with pytest.raises(ValueError):
        fg.write_result(df, out, mode="append")


def test_two_path_round_trip(spark, frame, tmp_path):
    edges = frame(TINY)
    out = tmp_path / "paths"
    fg.write_result(fg.two_paths(edges), str(out), "paths")
    assert "1,3\t3,4" in lines(out)
    paths = fg.read_two_paths(spark, str(out))
    assert bag(paths) == bag(fg.two_paths(edges))
    assert fg.close_paths(paths, edges).count() == 9


def test_compressed_two_paths(spark, frame, tmp_path, monkeypatch):
    """Stored paths of the chained queries are a fraction of their text, in files of bounded length."""
    edges = frame([(a, b) for a in range(40) for b in range(40, 80)] + [(b, a) for a in range(40) for b in range(40, 80)])
    monkeypatch.setattr(sinks, "FILE_ROWS", 10_000)
    sizes = {}
    for kind in ("none", "gzip"):
        out = tmp_path / kind
        assert fg.write_result(fg.two_paths(edges), str(out), "paths", compression=kind) == 128_000
        files = list(out.glob("part-*"))
        sizes[kind] = sum(f.stat().st_size for f in files)
    assert all(f.name.endswith(".gz") for f in files) and len(files) >= 12
    assert sizes["gzip"] * 3 < sizes["none"]
    assert bag(fg.read_two_paths(spark, str(tmp_path / "gzip"))) == bag(fg.two_paths(edges))


def test_path_queries_store_compressed_text(frame, tmp_path, monkeypatch):
    monkeypatch.setattr(contract, "scratch_folder", lambda spark: str(tmp_path / "place"))
    contract._write_paths(frame(TINY))
    files = list((tmp_path / "place" / "paths").glob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)


def test_stored_edges_are_compressed_and_shuffles_dropped(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(contract, "scratch_folder", lambda spark: str(tmp_path / "place"))
    edges, seen, inner = frame(TINY), [], sinks.shuffles_dropped
    monkeypatch.setattr(sinks, "shuffles_dropped", lambda spark: seen.append(spark) or inner(spark))
    assert bag(contract._edges_csv_round_trip(edges)) == bag(edges)
    contract._write_paths(edges)
    files = [f for f in (tmp_path / "place").rglob("part-*")]
    assert files and all(f.name.endswith(".gz") for f in files)
    assert len(seen) == 6


def test_broken_paths_are_dropped_and_counted(spark, tmp_path):
    path = tmp_path / "paths"
    path.write_text("1,2\t2,3\n1,2\t4,3\nx\n")
    rejected = Observation()
    assert bag(fg.read_two_paths(spark, str(path), rejected)) == [(1, 2, 3)]
    assert rejected.get == {"read": 3, "dropped": 2}


def test_fields_of_paths_are_read_once(spark, tmp_path):
    """No filter repeats the work of the fields; odd lines are as in a read that counts them."""
    path = tmp_path / "paths.tsv"
    path.write_text('1,2\t2,3\n1,2,9\t2,3,9\t7\n1,02\t2,3\n"1,2"\t"2,3"\n 1 ,2\t2, 3\n\n1\t1,2\nx,2\t2,3\n1,2\t3,4\n')
    paths = fg.read_two_paths(spark, str(path))
    assert bag(paths) == [(1, 2, 3)] * 5
    assert bag(fg.read_two_paths(spark, str(path), Observation())) == [(1, 2, 3)] * 5
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert not any("split" in line for line in plan.splitlines() if "Filter" in line)


def test_missing_values_and_separators(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 3)], "a bigint, b bigint, c bigint")
    for fmt, want in {"csv": "1,null,3", "tuple": "(1,null,3)", "tsv": "1\tnull\t3"}.items():
        assert fg.write_result(df, str(tmp_path / fmt), fmt) == 1
        assert lines(tmp_path / fmt) == [want]
    apart = spark.createDataFrame([("1,2", 3)], "a string, b bigint")
    with pytest.raises(Exception, match="holds a separator"):
        fg.write_result(apart, str(tmp_path / "x"), "csv")
    fg.write_result(apart, str(tmp_path / "y"), "tsv")
    assert lines(tmp_path / "y") == ["1,2\t3"]


def test_close_paths_job(spark, tmp_path, edge_file, capsys):
    path = edge_file([*TINY, ("a", "b")])
    assert jobs.run(spark, ["two-paths", path, str(tmp_path / "paths")]) == 13
    assert "13 rows written; 1 of 11 lines dropped" in capsys.readouterr().out
    args = ["close-paths", path, str(tmp_path / "closed")]
    with pytest.raises(ValueError):
        jobs.run(spark, args)
    assert jobs.run(spark, [*args, "--paths", str(tmp_path / "paths")]) == 9
    assert len(lines(tmp_path / "closed")) == 9


JOB_ANSWERS = [
    ("follower-count-reduce", HUNDREDS, ["--modulus", "100"], ["(100,3)", "(300,1)", "(400,2)"]),
    ("follower-count-group", HUNDREDS, ["--modulus", "100"], ["(100,3)", "(300,1)", "(400,2)"]),
    ("follower-count-fold", HUNDREDS, ["--modulus", "100"], ["(100,3)", "(300,1)", "(400,2)"]),
    ("follower-count-aggregate", HUNDREDS, ["--modulus", "100"], ["(100,3)", "(300,1)", "(400,2)"]),
    (
        "follower-count-dataset",
        HUNDREDS,
        ["--modulus", "100"],
        ["100,1", "200,1", "300,2", "400,1"],
    ),
    ("edge-count", TINY, ["--max-id", "5"], ["5"]),
    (
        "two-path-by-node",
        TINY,
        [],
        ["1\t4", "2\t3", "3\t2", "4\t2", "5\t1", "6\t1", "7\t0"],
    ),
    ("two-path-total", TINY, [], ["13"]),
    ("two-paths", [(1, 2), (2, 3)], [], ["1,2\t2,3"]),
    ("triangle-count-shuffle", TINY, [], ["3"]),
    ("triangle-count-broadcast", TINY, ["--max-id", "5"], ["2"]),
    ("triangle-count-adjacency", TINY, [], ["3"]),
    ("triangle-edges", [(1, 2), (2, 1), (1, 1)], ["--max-id", "2"], ["1,1\t1,1\t1,1"]),
    ("triangle-walks", [(4, 4)], [], ["4\t4,4,4,4"]),
    ("triangle-triples", [(4, 4)], [], ["4,4,4"]),
    ("degrees", [(4, 5)], [], ["4\t0\t1", "5\t1\t0"]),
]


@pytest.mark.parametrize("job,pairs,options,want", JOB_ANSWERS, ids=[j[0] for j in JOB_ANSWERS])
def test_jobs(spark, tmp_path, edge_file, job, pairs, options, want):
    out = tmp_path / "out"
    jobs.run(spark, [job, edge_file(pairs), str(out), *options])
    assert lines(out) == want


def test_every_job_is_tested():
    assert {j[0] for j in JOB_ANSWERS} | {"close-paths"} == set(jobs.JOBS)


@pytest.mark.parametrize("job,said", [("triangle-count-adjacency", "triangles: 3"), ("edge-count", "edge_count: 10"), ("two-path-total", "two_paths: 13")])
def test_jobs_of_one_value_print_it(spark, tmp_path, edge_file, capsys, job, said):
    assert jobs.run(spark, [job, edge_file(TINY), str(tmp_path / "out")]) == 1
    assert capsys.readouterr().out.splitlines() == [said, "1 rows written; 0 of 10 lines dropped"]


def test_answers_are_one_row(spark, tmp_path):
    one = spark.createDataFrame([(None,)], "v bigint")
    assert fg.write_answer(one, str(tmp_path / "a")) is None
    with pytest.raises(ValueError, match="one row"):
        fg.write_answer(one.unionAll(one), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="single column"):
        fg.write_answer(spark.range(1).selectExpr("id", "id AS b"), str(tmp_path / "c"))


def test_scratch_folders_are_shared_or_refused(spark):
    assert scratch_folder(spark) != scratch_folder(spark)
    assert shared_folder("hdfs://x/y", "yarn") == "hdfs://x/y"
    assert shared_folder(None, "local[4]") == shared_folder("", "local")
    for master in ("yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(None, master)


def test_job_refuses_existing_output(spark, tmp_path, edge_file, capsys):
    args = ["edge-count", edge_file(TINY), str(tmp_path / "out")]
    jobs.run(spark, args)
    with pytest.raises(PySparkException):
        jobs.run(spark, args)
    jobs.run(spark, [*args, "--overwrite", "--explain"])
    assert "Physical Plan" in capsys.readouterr().out
    assert lines(tmp_path / "out") == ["10"]
