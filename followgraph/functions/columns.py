"""SQL expressions shared by the operators.

The helpers take and return expression text for ``selectExpr`` and ``F.expr``:
a plan is then built with one call per step instead of one per operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from followgraph.plans.sizing import deal_out

# Exact counts can pass 2^63 (in-degree x out-degree of one hub, the cube of a
# repeated self-loop), so totals are decimals with room for 38 digits.
WIDE = "decimal(38,0)"

# One exploded array never holds more copies than this.
COPIES_PER_BLOCK = 65_536

# Rows of one input task that share a block: a run of equal rows in a single
# split is cut at this length.
ROWS_PER_BLOCK = 65_536


def wide_product(*factors: str) -> str:
    """Product of bigints that cannot wrap: exact up to 38 digits, else an error."""
    return " * ".join(f"cast({f} as decimal(19,0))" for f in factors)


def wide_sum(value: str) -> str:
    """Exact sum, 0 for no rows."""
    return f"cast(coalesce(sum({value}), 0) as {WIDE})"


def third(value: str) -> str:
    """Floor division by three of a non-negative wide integer."""
    return f"cast(({value} - {value} % 3) / 3 as {WIDE})"


def slice_of(slices: int | str, *by: str) -> str:
    """Slice in [0, slices) that depends on nothing but the values in ``by``."""
    return f"pmod(xxhash64({', '.join(by)}), {slices})"


def page_of(neighbour: str, pages: str) -> str:
    """Page in [0, pages) of a neighbour: the first 32 bits of the MD5 hash of its id, as text.

    All bits of the id count, and the SQL checks can repeat it.
    """
    spread = f"conv(substring(md5(cast({neighbour} AS string)), 1, 8), 16, 10)"
    return f"IF({pages} = 1, 0L, cast({spread} AS bigint) % {pages})"


def row_block() -> str:
    """Number of the block of ROWS_PER_BLOCK rows that a row is in, within its input task."""
    return f"(monotonically_increasing_id() & {(1 << 33) - 1}L) div {ROWS_PER_BLOCK}L"


def each(count: str) -> str:
    """Generator of 0 .. count - 1; ``count`` must be at least 1. Most often it is 1, for which a constant is quicker."""
    return f"explode(if({count} = 1L, array(0L), sequence(0L, {count} - 1L)))"


def share_of(total: str, part: str, parts: str) -> str:
    """Size of share ``part`` when ``total`` copies are cut into ``parts``."""
    return f"{total} div {parts} + if({part} < {total} % {parts}, 1L, 0L)"


def repeat_rows(df: DataFrame, copies: str, spread: bool = False) -> DataFrame:
    """Each row ``copies`` times; the column is dropped.

    The copies of a row are laid out in blocks, so no array grows with them.
    With ``spread`` the blocks are dealt out to all tasks first, so one row
    with very many copies does not end up in a single task.
    """
    size = COPIES_PER_BLOCK
    kept = [c for c in df.columns if c != copies]
    blocks = df.selectExpr("*", each(f"(({copies} - 1) div {size}L + 1)") + " AS _block")
    if spread:
        blocks = deal_out(blocks, *kept, "_block")
    rest = f"least({size}L, {copies} - _block * {size}L)"
    return blocks.selectExpr(*kept, each(rest) + " AS _copy").drop("_copy")
