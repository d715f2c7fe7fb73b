"""

Every query reads whole tables. An id bound or a modulus appears only in the
queries whose feature it is; their names say ``truncated`` or ``selected``.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import followgraph as fg  # noqa: E402
from followgraph.sources.scratch import scratch_folder  # noqa: E402
from followgraph.sources.tables import purchase_edges, supply_edges  # noqa: E402

try:
    from followgraph.llm import queries as llm
except ImportError as problem:
    if problem.name not in ("followgraph.llm", "followgraph.llm.queries"):
        raise
    llm = None

try:
    import corpus_pipeline
except ImportError as problem:
    if problem.name not in ("corpus_pipeline", "followgraph.llm"):
        raise
    corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the operators whose feature is a bound, a modulus or a page.
BOUND = 500
MODULUS = 100
PAGE = 256
BUCKETS = 32


def entry(spark: SparkSession) -> DataFrame:
    """Directed triangles of the supplier -> part graph."""
    return queries()["triangle_count_shuffle"](spark, "/root/testdata/sf0.001")


def _supply(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(supply_edges(spark, folder))


def _purchase(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(purchase_edges(spark, folder))


def _bigint(df: DataFrame, *columns: str) -> DataFrame:
    """Exact wide totals as bigint; too large a total raises, it never wraps."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _count_triangles(strategy: str) -> Callable[[DataFrame], DataFrame]:
    return lambda e: _bigint(fg.triangle_count(e, strategy), "closed_walks", "triangles")


def _list_text(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adjacency pages with the list as text ``id:copies,id:copies``."""
    entry_text = F.transform(
        "neighbours",
        lambda x: F.concat_ws(":", x["id"].cast("string"), x["copies"].cast("string")),
    )
    return df.select(key, "page", F.array_join(entry_text, ",").alias(out), "n")


def _column_zero_counts(edges: DataFrame, modulus: int | None = None) -> DataFrame:
    """Edges per source node, under the names a reader of column 0 expects."""
    counted = fg.follower_count(edges, "dataset", "follower", modulus, out="count")
    return counted.withColumnRenamed("follower", "followee")


def queries() -> dict[str, Query]:
    found = _graph_queries() | _stored_queries() | (llm.queries() if llm else {})
    return found | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def oracle_sql() -> dict[str, str]:
    """The same results as SQL over the same tables, where SQL can express them."""
    found = _graph_sql() | _stored_sql() | (llm.oracle_sql() if llm else {})
    sql = corpus_pipeline.ORACLE_SQL if corpus_pipeline else None
    return found | ({"pipeline": sql} if sql else {})


def _graph_queries() -> dict[str, Query]:
    return {
        "edges_truncated": _supply(lambda e: fg.truncate(e, BOUND)),
        "edges_reversed": _supply(fg.reverse),
        "edges_tagged": _supply(fg.tag_endpoints),
        "edge_count": _supply(fg.edge_count),
        "edge_count_truncated": _supply(lambda e: fg.edge_count(fg.truncate(e, BOUND))),
        "follower_count_reduce": _supply(lambda e: fg.follower_count(e, "reduce")),
        "follower_count_group": _supply(lambda e: fg.follower_count(e, "group")),
        "follower_count_fold": _supply(lambda e: fg.follower_count(e, "fold")),
        "follower_count_fold_pairs": _supply(
            lambda e: fg.fold_by_key(e, "followee", F.expr("1L"), F.expr("0L"), lambda a, b: a + b, "followers")
        ),
        "follower_highest_fold": _supply(
            lambda e: fg.fold_by_key(e, "followee", F.col("follower"), F.expr("-1L"), "max", "highest")
        ),
        "follower_count_aggregate": _supply(lambda e: fg.follower_count(e, "aggregate")),
        "follower_count_dataset": _purchase(_column_zero_counts),
        "follower_count_selected": _supply(lambda e: fg.follower_count(e, modulus=MODULUS)),
        "follower_count_dataset_selected": _purchase(lambda e: _column_zero_counts(e, MODULUS)),
        "in_adjacency": _supply(
            lambda e: _list_text(fg.in_adjacency(e, PAGE), "followee", "followers")
        ),
        "out_adjacency": _supply(
            lambda e: _list_text(fg.out_adjacency(e, PAGE), "follower", "followees")
        ),
        "degrees": _supply(fg.degrees),
        "two_path_by_node": _supply(lambda e: _bigint(fg.two_path_by_node(e), "two_paths")),
        "two_path_total": _supply(lambda e: _bigint(fg.two_path_total(e), "two_paths")),
        "two_path_count_truncated": _supply(
            lambda e: _bigint(fg.two_path_total(fg.truncate(e, BOUND)), "two_paths")
        ),
        "two_paths": _supply(fg.two_paths),
        "closed_two_paths": _supply(lambda e: fg.close_paths(fg.two_paths(e), e)),
        "triangle_edges": _supply(fg.triangle_edges),
        "triangle_walks": _supply(fg.triangle_walks),
        "triangle_triples": _supply(fg.triangle_triples),
        "triangle_count_shuffle": _supply(_count_triangles("shuffle")),
        "triangle_count_broadcast": _supply(_count_triangles("broadcast")),
        "triangle_count_adjacency": _supply(_count_triangles("adjacency")),
        "triangle_count_purchases": _purchase(_count_triangles("shuffle")),
    }


def _write_lines(edges: DataFrame, place: str) -> None:
    """The edges as compressed text in folders of two depths, among lines that are no edges."""
    kind = F.col("followee") % 10
    text = edges.withColumns({c: F.col(c).cast("string") for c in edges.columns})
    fg.write_result(text.where(kind != 2), f"{place}/plain", compression="gzip")
    fg.write_result(text.where(kind == 2).withColumn("more", F.lit("x")), f"{place}/deep/er/more", compression="gzip")
    broken = text.where(kind == 0).withColumn("follower", F.concat(F.lit("x"), "follower"))
    fg.write_result(broken, f"{place}/deep/broken", compression="gzip")
    missing = text.where(kind == 1).withColumn("followee", F.lit(None))
    fg.write_result(missing, f"{place}/deep/missing", compression="gzip")


FOLDERS = ("plain", "deep/er/more", "deep/broken", "deep/missing")


def _edges_csv_round_trip(edges: DataFrame) -> DataFrame:
    place = scratch_folder(edges.sparkSession)
    _write_lines(edges, place)
    return fg.read_edges(edges.sparkSession, [f"{place}/{f}" for f in FOLDERS])


def _edges_recursive(edges: DataFrame) -> DataFrame:
    place = scratch_folder(edges.sparkSession)
    _write_lines(edges, place)
    return fg.read_edges(edges.sparkSession, place, recursive=True)


def _edges_rejected(edges: DataFrame) -> DataFrame:
    """How many lines were read, and how many were no edges, seen in the pass that copies the edges."""
    spark, place, lines = edges.sparkSession, scratch_folder(edges.sparkSession), Observation("lines")
    _write_lines(edges, place)
    copied = fg.write_result(fg.read_edges(spark, place, recursive=True, rejected=lines), f"{place}-copy", "parquet")
    seen = lines.get
    return spark.createDataFrame([(seen["read"], seen["dropped"], copied)], "read bigint, dropped bigint, kept bigint")


def _write_paths(edges: DataFrame) -> list[str]:
    """The two-paths as compressed text, since neighbouring lines are much alike, and a folder of lines whose halves do not meet."""
    place, paths = scratch_folder(edges.sparkSession), fg.two_paths(edges)
    fg.write_result(paths, f"{place}/paths", "paths", compression="gzip")
    apart = edges.select(
        F.concat_ws(",", "follower", "followee").alias("first"),
        F.concat_ws(",", F.col("followee") + 1, "follower").alias("second"),
    )
    fg.write_result(apart, f"{place}/apart", "tsv", compression="gzip")
    return [f"{place}/paths", f"{place}/apart"]


def _closed_paths_stored(edges: DataFrame) -> DataFrame:
    """Two chained jobs: stored two-paths, closed by edges that are read from text."""
    spark, paths = edges.sparkSession, _write_paths(edges)
    return fg.close_paths(fg.read_two_paths(spark, paths), _edges_csv_round_trip(edges))


def _lines_of(fmt: str) -> Callable[[DataFrame], DataFrame]:
    """A result's text lines, as they are in its files."""

    def query(df: DataFrame) -> DataFrame:
        place = scratch_folder(df.sparkSession)
        fg.write_result(df, place, fmt)
        return df.sparkSession.read.text(place).withColumnRenamed("value", "line")

    return query


def _triangle_answer(edges: DataFrame) -> DataFrame:
    """The answer as a job prints it, beside the file that it writes."""
    place = scratch_folder(edges.sparkSession)
    answer = fg.write_answer(fg.triangle_count(edges).select("triangles"), place)
    return edges.sparkSession.read.text(place).select(F.lit(answer).alias("answer"), F.col("value").alias("stored"))


def _store(edges: DataFrame) -> fg.EdgeStore:
    name = f"edges_{uuid.uuid4().hex}"
    return fg.EdgeStore.write(edges, name, scratch_folder(edges.sparkSession), BUCKETS)


def _clustered_truncated(edges: DataFrame) -> DataFrame:
    place = scratch_folder(edges.sparkSession)
    fg.write_clustered(edges, place)
    return fg.read_clustered(edges.sparkSession, place, BOUND)


def _stored_queries() -> dict[str, Query]:
    """Queries that write their edges or results, and read them again."""
    return {
        "edges_csv_round_trip": _supply(_edges_csv_round_trip),
        "edges_recursive": _supply(_edges_recursive),
        "edges_rejected": _supply(_edges_rejected),
        "paths_round_trip": _supply(lambda e: fg.read_two_paths(e.sparkSession, _write_paths(e))),
        "closed_paths_stored": _supply(_closed_paths_stored),
        "follower_count_tuple_text": _supply(lambda e: _lines_of("tuple")(fg.follower_count(e))),
        "follower_count_csv_text": _purchase(lambda e: _lines_of("csv")(_column_zero_counts(e))),
        "degrees_tsv_text": _supply(lambda e: _lines_of("tsv")(fg.degrees(e))),
        "triangle_answer_text": _supply(_triangle_answer),
        "degrees_stored": _supply(lambda e: _store(e).degrees()),
        "two_paths_stored": _supply(lambda e: _store(e).two_paths()),
        "edges_clustered_truncated": _supply(_clustered_truncated),
    }


_SUPPLY = """e AS (
  SELECT l_suppkey AS follower, l_partkey AS followee FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL)"""

_PURCHASE = """e AS (
  SELECT o_custkey AS follower, l_suppkey AS followee
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL)"""

_BOUNDED = f"t AS (SELECT * FROM e WHERE follower < {BOUND} AND followee < {BOUND})"

_ENDS = """u AS (
  SELECT follower AS node, 0 AS i, 1 AS o FROM {edges}
  UNION ALL SELECT followee, 1, 0 FROM {edges}),
d AS (SELECT node, sum(i) AS i, sum(o) AS o FROM u GROUP BY node)"""

_WALKS = """e a JOIN e b ON a.followee = b.follower
JOIN e c ON b.followee = c.follower AND c.followee = a.follower"""


def _adjacency_sql(key: str, other: str, out: str) -> str:
    return f"""WITH {_SUPPLY},
p AS (SELECT {key}, {other}, count(*) AS n FROM e GROUP BY {key}, {other}),
g AS (SELECT {key} AS k, (count(*) + {PAGE - 1}) // {PAGE} AS pages FROM p GROUP BY {key}),
q AS (SELECT {key}, {other}, n, CASE WHEN pages = 1 THEN 0
        ELSE CAST('0x' || substr(md5(CAST({other} AS VARCHAR)), 1, 8) AS BIGINT) % pages END AS page
      FROM p JOIN g ON {key} = k)
SELECT {key}, CAST(page AS BIGINT) AS page,
       string_agg(CAST({other} AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY {other}) AS {out},
       CAST(sum(n) AS BIGINT) AS n
FROM q GROUP BY {key}, page"""


def _graph_sql() -> dict[str, str]:
    count_edges = "SELECT count(*) AS edge_count FROM"
    followers = f"""WITH {_SUPPLY}
SELECT followee, count(*) AS followers FROM e GROUP BY followee"""
    column_zero = """SELECT follower AS followee, count(*) AS "count" FROM e"""
    ends = _ENDS.format(edges="e")
    total = "SELECT CAST(coalesce(sum(i * o), 0) AS BIGINT) AS two_paths FROM d"
    triples = f"""WITH {_SUPPLY}
SELECT a.follower AS {{0}}, a.followee AS {{1}}, b.followee AS {{2}} FROM {_WALKS}"""
    triangles = f"""SELECT count(*) AS closed_walks, count(*) // 3 AS triangles FROM {_WALKS}"""
    return {
        "edges_truncated": f"WITH {_SUPPLY}, {_BOUNDED} SELECT * FROM t",
        "edges_reversed": f"""WITH {_SUPPLY}
SELECT followee AS follower, follower AS followee FROM e""",
        "edges_tagged": f"""WITH {_SUPPLY}
SELECT follower AS node, 'S' AS side, follower, followee FROM e
UNION ALL SELECT followee, 'D', follower, followee FROM e""",
        "edge_count": f"WITH {_SUPPLY} {count_edges} e",
        "edge_count_truncated": f"WITH {_SUPPLY}, {_BOUNDED} {count_edges} t",
        "follower_count_reduce": followers,
        "follower_count_group": followers,
        "follower_count_fold": followers,
        "follower_count_fold_pairs": followers,
        "follower_highest_fold": f"""WITH {_SUPPLY}
SELECT followee, max(follower) AS highest FROM e GROUP BY followee""",
        "follower_count_aggregate": followers,
        "follower_count_dataset": f"WITH {_PURCHASE} {column_zero} GROUP BY follower",
        "follower_count_selected": f"""WITH {_SUPPLY}
SELECT followee, count(*) AS followers FROM e WHERE followee % {MODULUS} = 0 GROUP BY followee""",
        "follower_count_dataset_selected": f"""WITH {_PURCHASE}
{column_zero} WHERE follower % {MODULUS} = 0 GROUP BY follower""",
        "in_adjacency": _adjacency_sql("followee", "follower", "followers"),
        "out_adjacency": _adjacency_sql("follower", "followee", "followees"),
        "degrees": f"""WITH {_SUPPLY}, {ends}
SELECT node, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree FROM d""",
        "two_path_by_node": f"""WITH {_SUPPLY}, {ends}
SELECT node, CAST(i * o AS BIGINT) AS two_paths FROM d""",
        "two_path_total": f"WITH {_SUPPLY}, {ends} {total}",
        "two_path_count_truncated": f"""WITH {_SUPPLY}, {_BOUNDED}
SELECT count(*) AS two_paths FROM t d JOIN t s ON d.followee = s.follower""",
        "two_paths": f"""WITH {_SUPPLY}
SELECT d.follower AS src, d.followee AS mid, s.followee AS dst
FROM e d JOIN e s ON d.followee = s.follower""",
        "closed_two_paths": triples.format("src", "mid", "dst"),
        "triangle_edges": f"""WITH {_SUPPLY}
SELECT c.follower || ',' || c.followee AS closing,
       a.follower || ',' || a.followee AS first_hop,
       b.follower || ',' || b.followee AS second_hop FROM {_WALKS}""",
        "triangle_walks": f"""WITH {_SUPPLY}
SELECT a.follower AS src,
       a.follower || ',' || a.followee || ',' || b.followee || ',' || c.followee AS walk
FROM {_WALKS}""",
        "triangle_triples": triples.format("follower", "intermediate", "followee"),
        "triangle_count_shuffle": f"WITH {_SUPPLY} {triangles}",
        "triangle_count_broadcast": f"WITH {_SUPPLY} {triangles}",
        "triangle_count_adjacency": f"WITH {_SUPPLY} {triangles}",
        "triangle_count_purchases": f"WITH {_PURCHASE} {triangles}",
    }


def _stored_sql() -> dict[str, str]:
    graph = _graph_sql()
    all_edges = f"WITH {_SUPPLY} SELECT follower, followee FROM e"
    ends = _ENDS.format(edges="e")
    return {
        "edges_csv_round_trip": all_edges,
        "edges_recursive": all_edges,
        "edges_rejected": f"""WITH {_SUPPLY}
SELECT count(*) + count_if(followee % 10 < 2) AS "read",
       CAST(count_if(followee % 10 < 2) AS BIGINT) AS dropped, count(*) AS kept FROM e""",
        "paths_round_trip": graph["two_paths"],
        "closed_paths_stored": graph["closed_two_paths"],
        "follower_count_tuple_text": f"""WITH {_SUPPLY}
SELECT '(' || followee || ',' || count(*) || ')' AS line FROM e GROUP BY followee""",
        "follower_count_csv_text": f"""WITH {_PURCHASE}
SELECT follower || ',' || count(*) AS line FROM e GROUP BY follower""",
        "degrees_tsv_text": f"""WITH {_SUPPLY}, {ends}
SELECT concat_ws(chr(9), node, CAST(i AS BIGINT), CAST(o AS BIGINT)) AS line FROM d""",
        "triangle_answer_text": f"""WITH {_SUPPLY}, t AS (SELECT count(*) // 3 AS n FROM {_WALKS})
SELECT CAST(n AS VARCHAR) AS answer, CAST(n AS VARCHAR) AS stored FROM t""",
        "degrees_stored": graph["degrees"],
        "two_paths_stored": graph["two_paths"],
        "edges_clustered_truncated": f"""WITH {_SUPPLY}, {_BOUNDED}
SELECT follower, followee, count(*) AS n FROM t GROUP BY follower, followee""",
    }
