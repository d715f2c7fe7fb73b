"""Finding the few keys that would unbalance a plan.

The frame of hot keys is broadcast, so its size must not follow the data. It
cannot: if every kept key weighs at least total / max_keys, then at most
max_keys keys are kept, whatever the data look like. Keys below the bar hold
less than that share each and stay on the ordinary path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Proven ceiling on a broadcast hot-key frame.
MAX_HOT_KEYS = 100_000


def is_hot(
    weights: DataFrame,
    weight: str,
    at_least: float,
    max_keys: int = MAX_HOT_KEYS,
) -> Column:
    """Predicate on ``weights``, a frame with one row per key: split this key?

    True for weights >= max(at_least, total / max_keys), which at most
    ``max_keys`` keys can reach. The total is a scalar subquery of the same
    plan, so nothing is collected.
    """
    share = f"coalesce(sum(cast({weight} as double)), 0D) / {float(max_keys)}D"
    bar = weights.selectExpr(f"greatest({float(at_least)}D, {share}) AS bar")
    return F.expr(f"cast({weight} as double)") >= bar.scalar()


def slices_for(rows: str, rows_per_slice: int, most: int) -> str:
    """How many slices to cut ``rows`` into, between 1 and ``most``.

    ``most`` is the session's number of shuffle partitions: more slices would
    not reach more tasks.
    """
    return f"greatest(1L, least({most}L, ceil({rows} / {rows_per_slice}L)))"
