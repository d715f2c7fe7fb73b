"""Row operators on edge frames. All are narrow except ``collapse``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDPOINTS = ("follower", "followee")


def check_endpoint(endpoint: str) -> str:
    """The endpoint itself, or an error if it is not a column of an edge frame."""
    if endpoint not in ENDPOINTS:
        raise ValueError(f"endpoint must be one of {ENDPOINTS}, not {endpoint!r}")
    return endpoint


def other_endpoint(endpoint: str) -> str:
    """The opposite end of an edge."""
    return "follower" if check_endpoint(endpoint) == "followee" else "followee"


def known(edges: DataFrame) -> DataFrame:
    """Edges that have both ends."""
    return edges.where(F.col("follower").isNotNull() & F.col("followee").isNotNull())


def truncate(edges: DataFrame, max_id: int) -> DataFrame:
    """Edges of the subgraph of nodes with id < max_id (strict, both ends)."""
    return edges.where((F.col("follower") < max_id) & (F.col("followee") < max_id))


def where_multiple(edges: DataFrame, endpoint: str, modulus: int) -> DataFrame:
    """Edges whose endpoint id is a multiple of ``modulus``."""
    return edges.where(F.col(check_endpoint(endpoint)) % modulus == 0)


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge turned around."""
    return edges.select(
        F.col("followee").alias("follower"), F.col("follower").alias("followee")
    )


def tag_endpoints(edges: DataFrame) -> DataFrame:
    """Two rows per edge: one for its source (side S), one for its target (D)."""
    ends = F.array(
        F.struct(F.col("follower").alias("node"), F.lit("S").alias("side")),
        F.struct(F.col("followee").alias("node"), F.lit("D").alias("side")),
    )
    return edges.select(F.explode(ends).alias("end"), "follower", "followee").select(
        "end.node", "end.side", "follower", "followee"
    )


def collapse(edges: DataFrame) -> DataFrame:
    """Distinct edges with their number of copies, ``n``.

    The count is partial before the shuffle, so a pair that holds a large part
    of all rows costs one row per task. Edges with a missing end are dropped
    here: the joins would drop them, and stating it once gives every branch of
    a plan the same scan, so that all branches share one shuffle.
    """
    return known(edges).groupBy("follower", "followee").agg(F.count(F.lit(1)).alias("n"))
