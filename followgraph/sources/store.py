"""Stored layouts of an edge frame, so that later questions move and read less of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from followgraph.functions.columns import repeat_rows
from followgraph.operators.edges import collapse
from followgraph.operators.paths import CELL_ROWS, grid_paths, hot_middles
from followgraph.plans.skew import MAX_HOT_KEYS

BUCKETS = 200
ROW_GROUP_BYTES = 32 << 20


def write_clustered(edges: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write distinct edges with their copies as Parquet, clustered for id bounds.

    Columns are follower, followee, n and ``top``, the larger of the two ids,
    by which files and row groups are ranges. Edges with both ids below a
    bound are those with ``top`` below it, so ``read_clustered`` reads them and at
    most the rest of one row group in a file. Repeats of an edge are one row.
    Edges with a missing end are dropped; an empty frame gives an empty table.
    """
    rows = collapse(edges).withColumn("top", F.greatest("follower", "followee"))
    # The ids after it part the edges of a hub, which share its id as their top.
    order = ("top", "follower", "followee")
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    in_order.write.option("parquet.block.size", row_group_bytes).parquet(path)


def read_clustered(spark: SparkSession, path: str, max_id: int | None = None) -> DataFrame:
    """(follower, followee, n) of a clustered table: edges whose ids are both below ``max_id``."""
    rows = spark.read.schema("follower bigint, followee bigint, n bigint, top bigint").parquet(path)
    if max_id is not None:
        rows = rows.where(F.col("top") < max_id)
    return rows.select("follower", "followee", "n")


class EdgeStore:
    """Distinct edges with their copies, bucketed and sorted by each end.

    Two tables hold the edges of ordinary nodes: ``ins`` bucketed by followee,
    ``outs`` by follower. Both have the same buckets, so questions that group
    by a node, or join on it, need no shuffle, however often they are asked.
    Nodes with so many edges or paths that one bucket would weigh on its task
    are left out of them; their edges are in ``hot_ins`` and ``hot_outs``,
    which are spread by both ends, and there are few such nodes (``hot``).
    """

    PARTS = ("ins", "outs", "hot_ins", "hot_outs", "hot")

    def __init__(self, spark: SparkSession, name: str, cell_rows: int = CELL_ROWS):
        self.spark, self.name, self.cell_rows = spark, name, cell_rows

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    @classmethod
    def write(
        cls,
        edges: DataFrame,
        name: str,
        path: str,
        buckets: int = BUCKETS,
        cell_rows: int = CELL_ROWS,
        max_hot: int = MAX_HOT_KEYS,
    ) -> EdgeStore:
        """Write the tables below the folder ``path`` and register them as ``name``_ins and so on."""
        spark = edges.sparkSession
        pairs = collapse(edges)

        def save(df: DataFrame, part: str, by: str | None = None) -> None:
            writer = df.write.format("parquet").option("path", f"{path}/{part}")
            if by:
                # One task writes one bucket, so a bucket is one file.
                writer = df.repartition(buckets, by).write.format("parquet").option("path", f"{path}/{part}")
                writer = writer.bucketBy(buckets, by).sortBy(by)
            writer.saveAsTable(f"{name}_{part}")

        save(hot_middles(pairs, cell_rows, max_hot), "hot")
        hot = F.broadcast(spark.table(f"{name}_hot").select("_hot"))
        for part, end in (("ins", "followee"), ("outs", "follower")):
            same = F.expr(f"{end} = _hot")
            save(pairs.join(hot, same, "left_anti"), part, end)
            save(pairs.join(hot, same, "left_semi"), f"hot_{part}")
        return cls(spark, name, cell_rows)

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for part in self.PARTS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def degrees(self) -> DataFrame:
        """In- and out-degree of every node that has an edge, as ``degrees`` of the edges.

        Ordinary nodes are grouped and joined bucket by bucket; a hot node
        costs one row per task.
        """

        def side(ins: str, outs: str) -> DataFrame:
            into = self.table(ins).groupBy(F.col("followee").alias("node")).agg(F.sum("n").alias("i"))
            out = self.table(outs).groupBy(F.col("follower").alias("node")).agg(F.sum("n").alias("o"))
            return into.join(out, "node", "full_outer").selectExpr(
                "node", "coalesce(i, 0L) AS in_degree", "coalesce(o, 0L) AS out_degree"
            )

        return side("ins", "outs").unionAll(side("hot_ins", "hot_outs"))

    def two_paths(self) -> DataFrame:
        """All two-paths as rows (src, mid, dst), as ``two_paths`` of the edges.

        Ordinary middle nodes are joined bucket by bucket, without a shuffle;
        hot ones on their grids.
        """
        first = self.table("ins").selectExpr("followee AS mid", "follower AS src", "n AS _n1")
        second = self.table("outs").selectExpr("follower AS mid", "followee AS dst", "n AS _n2")
        cold = first.join(second.hint("merge"), "mid").selectExpr("src", "mid", "dst", "_n1 * _n2 AS _copies")
        hot = grid_paths(self.table("hot_ins"), self.table("hot_outs"), self.table("hot"), self.cell_rows)
        # Copies are counted, so their product may be laid out in many tasks.
        return repeat_rows(cold, "_copies").unionAll(hot)
