"""Edge frames over the warehouse tables (Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from followgraph.operators.edges import known


def supply_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier -> part, one edge per line item."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    return known(
        items.select(
            F.col("l_suppkey").cast("bigint").alias("follower"),
            F.col("l_partkey").cast("bigint").alias("followee"),
        )
    )


def purchase_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Customer -> supplier, one edge per line item of the customer's orders."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    return known(
        orders.join(items, orders.o_orderkey == items.l_orderkey).select(
            F.col("o_custkey").cast("bigint").alias("follower"),
            F.col("l_suppkey").cast("bigint").alias("followee"),
        )
    )
