"""Sizes: what is expected, and the number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Largest edge frame, by the estimate in its plan, that is replicated unasked.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Size that the optimizer expects, from file sizes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(df: DataFrame) -> int:
    """Partitions of a shuffle in the frame's session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning by ``keys`` into exactly the session's shuffle partitions.

    For steps whose output is far larger than their input: adaptive execution
    merges partitions by input size, and would put such a step into few tasks.
    """
    return df.repartition(shuffle_partitions(df), *keys)
