"""The questions as batch jobs: edge files in, result files out.

    spark-submit ... followgraph/__main__.py JOB INPUT OUTPUT [--max-id N] ...
    python -m followgraph JOB INPUT OUTPUT [--max-id N] ...
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

import followgraph as fg


@dataclass(frozen=True)
class Job:
    """A question and the text format of its answer."""

    run: Callable[[DataFrame, argparse.Namespace], DataFrame]
    fmt: str
    about: str


def _followers(strategy: str) -> Job:
    return Job(
        lambda e, a: fg.follower_count(e, strategy, modulus=a.modulus),
        "tuple",
        f"followers of selected nodes, strategy {strategy}",
    )


def _triangles(strategy: str) -> Job:
    return Job(
        lambda e, a: fg.triangle_count(e, strategy).select("triangles"),
        "text",
        f"number of directed triangles, strategy {strategy}",
    )


JOBS = {
    "follower-count-reduce": _followers("reduce"),
    "follower-count-group": _followers("group"),
    "follower-count-fold": _followers("fold"),
    "follower-count-aggregate": _followers("aggregate"),
    "follower-count-dataset": Job(
        lambda e, a: fg.follower_count(e, "dataset", "follower", a.modulus, out="count"),
        "csv",
        "edges per selected node of the first column",
    ),
    "edge-count": Job(lambda e, a: fg.edge_count(e), "text", "number of edges"),
    "degrees": Job(lambda e, a: fg.degrees(e), "tsv", "in- and out-degree per node"),
    "two-path-by-node": Job(
        lambda e, a: fg.two_path_by_node(e), "tsv", "number of two-paths per middle node"
    ),
    "two-path-total": Job(lambda e, a: fg.two_path_total(e), "text", "number of two-paths"),
    "two-paths": Job(lambda e, a: fg.two_paths(e), "paths", "all two-paths"),
    "close-paths": Job(
        lambda e, a: fg.close_paths(fg.read_two_paths(e.sparkSession, a.paths), e),
        "csv",
        "stored two-paths (--paths) that an edge closes",
    ),
    "triangle-edges": Job(
        lambda e, a: fg.triangle_edges(e), "tsv", "triangles as closing edge and two hops"
    ),
    "triangle-walks": Job(
        lambda e, a: fg.triangle_walks(e), "tsv", "triangles as start and walk"
    ),
    "triangle-triples": Job(lambda e, a: fg.triangle_triples(e), "csv", "triangles as three nodes"),
    "triangle-count-shuffle": _triangles("shuffle"),
    "triangle-count-broadcast": _triangles("broadcast"),
    "triangle-count-adjacency": _triangles("adjacency"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(
        prog="followgraph",
        formatter_class=argparse.RawDescriptionHelpFormatter,
        epilog="jobs:\n" + "\n".join(f"  {name:26s} {job.about}" for name, job in JOBS.items()),
    )
    p.add_argument("job", choices=sorted(JOBS), metavar="JOB")
    p.add_argument("input", help="edge files: a file, a folder or a glob")
    p.add_argument("output", help="result folder")
    p.add_argument("--max-id", type=int, help="keep edges whose ids are both below this")
    p.add_argument("--modulus", type=int, help="follower counts: keep multiples of this")
    p.add_argument("--paths", help="close-paths: files that two-paths wrote")
    p.add_argument("--recursive", action="store_true", help="read subfolders of the input")
    p.add_argument("--mode", choices=("permissive", "failfast"), default="permissive")
    p.add_argument("--overwrite", action="store_true", help="replace an existing result")
    p.add_argument("--explain", action="store_true", help="print the plan before running")
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """Run one job; the number of rows written. Any failure raises.

    Prints that number and how many lines of the input were dropped, and
    before it the answer of a job whose result is one value. All are seen in
    the pass that makes the result.
    """
    args = parser().parse_args(argv)
    if args.job == "close-paths" and not args.paths:
        raise ValueError("close-paths needs --paths")
    lines = Observation("lines")
    edges = fg.read_edges(
        spark, args.input, mode=args.mode, recursive=args.recursive, rejected=lines
    )
    if args.max_id is not None:
        edges = fg.truncate(edges, args.max_id)
    job = JOBS[args.job]
    result = job.run(edges, args)
    if args.explain:
        result.explain("formatted")
    mode = "overwrite" if args.overwrite else "errorifexists"
    if job.fmt == "text":
        rows, answer = 1, fg.write_answer(result, args.output, mode)
        print(f"{result.columns[0]}: {answer}")
    else:
        rows = fg.write_result(result, args.output, job.fmt, mode)
    seen = lines.get
    print(f"{rows} rows written; {seen['dropped']} of {seen['read']} lines dropped")
    return rows
