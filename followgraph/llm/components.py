"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from followgraph.llm.scratch import stored

MAX_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    pair = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return links.select(F.inline(pair))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour instead."""
    ways = _both_ways(links)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return ways.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("m").alias("a"), "b")
    own = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps until the links are stars; the
    number of rounds grows with the logarithm of the longest chain. A hub's
    neighbours are never collected: its minimum is a partial aggregate. Links
    of a node to itself and repeated links change nothing; no links, no rows.
    """
    now = stored(links.where("a != b").select("a", "b").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            roots = now.select(F.col("a").alias("node"), F.col("a").alias("component"))
            leaves = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            return leaves.unionAll(roots.distinct())
        seen = mark
    raise RuntimeError("components did not settle")
