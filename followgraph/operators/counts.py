"""Edge counts, and follower counts in five physical styles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from followgraph.functions.columns import row_block, slice_of
from followgraph.operators.edges import check_endpoint, other_endpoint, where_multiple
from followgraph.plans.sizing import shuffle_partitions

Merge = Callable[[Column, Column], Column]

# Merges that Spark has as an aggregate, and as a function of two values.
AGGREGATES: dict[str, tuple[Callable[[Column], Column], Merge]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "bit_and": (F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "bit_or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "bool_and": (F.bool_and, lambda a, b: a & b),
    "bool_or": (F.bool_or, lambda a, b: a | b),
}

# Input tasks whose folded values of a key are folded together.
TASKS_PER_FOLD = 1_000


def edge_count(edges: DataFrame) -> DataFrame:
    """One row: the number of edges."""
    return edges.agg(F.count(F.lit(1)).alias("edge_count"))


def reduce_by_key(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` per key: partial sums, one shuffle, final sums."""
    return df.groupBy(key).agg(F.sum(value).alias(out))


def group_count_by_key(
    df: DataFrame, key: str, by: str, out: str, slices: int | None = None
) -> DataFrame:
    """Size of each key's group after shuffling every row, without combining first.

    A group is shuffled in slices, by default as many as there are shuffle
    partitions. They are chosen by the column ``by`` and by the block of rows
    of the task that read the row. A group is counted as it streams by: none
    is collected, and neither a hot key nor copies of a single row meet in
    one task, even if all of them come from one input split.
    """
    slices = slices or shuffle_partitions(df)
    part = slice_of(slices, by, "spark_partition_id()", row_block())
    return (
        df.selectExpr(key, f"{part} AS _slice")
        .repartition(key, "_slice")
        .groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(key)
        .agg(F.sum("_n").alias(out))
    )


def fold_by_key(
    df: DataFrame, key: str, value: Column, zero: Column, merge: Merge | str, out: str
) -> DataFrame:
    """Fold of ``value`` per key with any associative, commutative ``merge``, ``zero`` being neutral for it.

    A merge that is named, one of AGGREGATES, is combined in every task before
    the one shuffle, which then has a row per key and task. It passes over
    nulls; a key of nulls alone gives ``zero``.

    Any other merge is a function of two columns, which Spark can't combine as
    it reads. All values are then shipped, and folded in steps: blocks of rows of an input task, blocks of a task, groups of tasks,
    and these. A collected array therefore holds at most ROWS_PER_BLOCK
    values, the blocks of one input split, TASKS_PER_FOLD values, or one for
    each group of tasks, however hot the key is.
    """
    if isinstance(merge, str):
        if merge not in AGGREGATES:
            raise ValueError(f"merge must be a function or one of {sorted(AGGREGATES)}, not {merge!r}")
        combined, pair = AGGREGATES[merge]
        total = combined(F.col("_v"))
        return (
            df.select(key, value.alias("_v"))
            .groupBy(key)
            .agg(F.when(total.isNull(), zero).otherwise(pair(zero, total)).alias(out))
        )
    folded = F.reduce(F.collect_list("_v"), zero, merge)
    parts = df.select(
        key, value.alias("_v"), F.spark_partition_id().alias("_task"), F.expr(row_block()).alias("_block")
    )
    parts = parts.groupBy(key, "_task", "_block").agg(folded.alias("_v"))
    parts = parts.groupBy(key, "_task").agg(folded.alias("_v"))
    group = F.expr(f"_task div {TASKS_PER_FOLD}").alias("_tasks")
    parts = parts.groupBy(key, group).agg(folded.alias("_v"))
    return parts.groupBy(key).agg(folded.alias(out))


def aggregate_by_key(
    df: DataFrame,
    key: str,
    by: str,
    within: Column,
    across: Callable[[Column], Column],
    out: str,
    slices: int | None = None,
) -> DataFrame:
    """Two-stage aggregation: ``within`` each slice of a key, then ``across`` slices.

    Slices, by default as many as there are shuffle partitions, come from the
    values of ``by``, so reruns of a task agree.
    """
    slices = slices or shuffle_partitions(df)
    return (
        df.selectExpr("*", f"{slice_of(slices, by)} AS _slice")
        .groupBy(key, "_slice")
        .agg(within.alias("_partial"))
        .groupBy(key)
        .agg(across(F.col("_partial")).alias(out))
    )


STRATEGIES = ("reduce", "group", "fold", "aggregate", "dataset")


def follower_count(
    edges: DataFrame,
    strategy: str = "reduce",
    endpoint: str = "followee",
    modulus: int | None = None,
    out: str = "followers",
) -> DataFrame:
    """Number of edges per ``endpoint`` node, for all nodes or multiples of ``modulus``.

    All strategies return the same rows: ``reduce`` and ``dataset`` combine
    before one shuffle, ``fold`` too, by a named merge; ``aggregate`` combines
    in two salted stages; ``group`` ships every row.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    key = check_endpoint(endpoint)
    other = other_endpoint(endpoint)
    if modulus is not None:
        edges = where_multiple(edges, key, modulus)
    one = F.lit(1).cast("bigint")
    if strategy == "reduce":
        return reduce_by_key(edges, key, one, out)
    if strategy == "group":
        return group_count_by_key(edges, key, other, out)
    if strategy == "fold":
        return fold_by_key(edges, key, one, F.lit(0).cast("bigint"), "sum", out)
    if strategy == "aggregate":
        return aggregate_by_key(edges, key, other, F.count(F.lit(1)), F.sum, out)
    return edges.groupBy(key).count().withColumnRenamed("count", out)
