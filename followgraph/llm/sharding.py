"""Shards of near equal bytes: a k-d tree over document metadata, split at weighted medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from followgraph.llm.scratch import stored

SHARDS = 40
# Bytes that a document takes besides its text.
OVERHEAD = 16
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
# Parts of a node's current interval that one pass over the metadata weighs.
BUCKETS = 512
# Coordinates are whole numbers below this; the low half of a key is a hash of the text.
GRID = (1 << 31) - 1
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Cut:
    """Rows go left whose key in the dimension is below ``key``, or equal with an id below ``row``."""

    dimension: str
    key: int
    row: int


@dataclass
class Node:
    """A box of the tree: a range of shards, and the cut of an inner one."""

    first: int
    shards: int
    cut: Cut | None = None
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.cut is None else [*self.left.leaves(), *self.right.leaves()]


def _first_shard(node: Node) -> str:
    """SQL for the first shard of the leaf that a metadata row falls into."""
    if node.cut is None:
        return str(node.first)
    key, cut = f"_k_{node.cut.dimension}", node.cut
    inside = f"{key} < {_long(cut.key)} OR ({key} = {_long(cut.key)} AND _row < {_long(cut.row)})"
    return f"IF({inside}, {_first_shard(node.left)}, {_first_shard(node.right)})"


def _long(value: int) -> str:
    """A bigint literal; the least one can't be written as a minus sign and its digits."""
    return f"({value + 1}L - 1L)" if value == LOW else f"{value}L"


def _coordinates(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """A coordinate from 0 to GRID for each dimension, ``_c_<name>``; a missing value is 0.

    Numbers lie on a scale from the least to the largest of all rows, words at
    the place that their hash gives.
    """
    kinds = dict(rows.dtypes)
    numbers = [d for d in dimensions if kinds[d] != "string"]
    ends = [f(F.col(d).cast("double")).alias(f"{n}_{d}") for d in numbers for n, f in (("low", F.min), ("high", F.max))]
    found = rows.agg(*ends).first() if numbers else {}
    places = {}
    for d in dimensions:
        if d in numbers:
            low, high = found[f"low_{d}"], found[f"high_{d}"]
            width = (high - low) if low is not None else 0.0
            place = f"cast({GRID} * ((cast({d} AS double) - {low!r}D) / {width!r}D) AS bigint)" if width > 0 else "0L"
        else:
            place = f"pmod(xxhash64({d}), {GRID}L) + 1L"
        places[f"_c_{d}"] = F.expr(f"IF({d} IS NULL, 0L, {place})")
    return rows.withColumns(places)


def metadata(documents: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, with_text: bool = False) -> DataFrame:
    """One stored row per document: _row, doc_id, size, text_crc32 and its key in every dimension.

    ``_row`` is unique and, once written, the same in every later pass: the
    number of the writing task and of the row in it. A key is the coordinate,
    then the checksum of the text, so that equal texts of one place are side
    by side.
    """
    missing = [d for d in dimensions if d not in documents.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    columns = dict.fromkeys(["doc_id", *dimensions])
    text = "encode(coalesce(text, ''), 'utf-8')"
    rows = documents.select(
        *[F.col(c).cast("bigint") if c == "doc_id" else F.col(c) for c in columns],
        F.expr(f"cast(octet_length({text}) AS bigint) + {OVERHEAD}L AS _size"),
        F.expr(f"crc32({text}) AS _crc32"),
        F.monotonically_increasing_id().alias("_row"),
        *([F.col("text").alias("_text")] if with_text else []),
    )
    placed = _coordinates(stored(rows), dimensions)
    keys = [F.expr(f"shiftleft(_c_{d}, 32) | _crc32").alias(f"_k_{d}") for d in dimensions]
    kept = ["_row", "doc_id", "_size", "_crc32", *(["_text"] if with_text else [])]
    return placed.select(*kept, *[F.col(f"_c_{d}") for d in dimensions], *keys)


@dataclass
class _Search:
    """The weighted median of a node: an interval of keys, then of row ids that share one key."""

    node: Node
    dimension: str
    goal: float
    low: int
    high: int
    key: int | None = None

    def step(self) -> int:
        return (self.high - self.low) // BUCKETS + 1


def _cuts(rows: DataFrame, searches: list[_Search], dimensions: tuple[str, ...]) -> None:
    """Give every node its cut: the place in its order nearest to the goal in bytes.

    All nodes of a level are searched at once. A pass sums the bytes of up to
    BUCKETS parts of each node's interval and goes on in the part that holds
    the goal, until that is a single row; so it is exact, and its passes grow
    with the logarithm of the rows. Only sums reach the driver.
    """
    keys = "array(" + ", ".join(f"_k_{d}" for d in dimensions) + ")"
    while searches:
        table = [(s.node.first, dimensions.index(s.dimension), s.key, s.low, s.high, s.step()) for s in searches]
        # One row per node of a level, so never more than half as many as shards.
        wanted = rows.sparkSession.createDataFrame(
            table, "_node int, dimension int, key bigint, low bigint, high bigint, step bigint"
        )
        parts = (
            rows.join(F.broadcast(wanted), "_node")
            .selectExpr("_node", "_size", "_row", f"get({keys}, dimension) AS _k", "key", "low", "high", "step")
            .where("key IS NULL OR _k = key")
            .selectExpr("_node", "_size", "IF(key IS NULL, _k, _row) AS _v", "low", "high", "step")
            .where("_v BETWEEN low AND high")
            .groupBy("_node", F.expr("(_v - low) div step").alias("bucket"))
            .agg(F.sum("_size").alias("bytes"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        )
        found: dict[int, list] = {}
        for r in parts.collect():
            found.setdefault(r["_node"], []).append((r["bucket"], r["bytes"], r["low"], r["high"]))
        going = []
        for s in searches:
            held, before = sorted(found[s.node.first]), 0
            for bucket, weight, low_, high_ in held:
                if before + weight >= s.goal or bucket == held[-1][0]:
                    break
                before += weight
            s.goal -= before
            s.low, s.high = low_, high_
            if low_ < high_:
                going.append(s)
            elif s.key is None:
                # One key is left: its rows are told apart by their ids.
                s.key, s.low, s.high = low_, 0, HIGH
                going.append(s)
            else:
                # One row is left: it goes to the side that is nearer to the goal.
                s.node.cut = Cut(s.dimension, s.key, s.low + (1 if s.goal >= weight - s.goal else 0))
        searches = going


def tree(rows: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> Node:
    """A k-d tree with ``shards`` leaves over stored ``metadata`` rows.

    A node of m shards is cut along the dimension in which its rows lie widest
    apart (the first of equal ones), at the weighted median: half of its bytes
    go left, or the share of m div 2 shards if m is odd. Cutting ends where a
    leaf has the target, the bytes of one shard. A node that has fewer rows
    than shards leaves some of them empty.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    root = Node(0, shards)
    while True:
        todo = {n.first: n for n in root.leaves() if n.shards > 1}
        if not todo:
            return root
        at = rows.withColumn("_node", F.expr(_first_shard(root)))
        ends = [f(f"_c_{d}").alias(f"{n}_{d}") for d in dimensions for n, f in (("low", F.min), ("high", F.max))]
        held = {r["_node"]: r for r in at.groupBy("_node").agg(F.sum("_size").alias("bytes"), *ends).collect()}
        searches = []
        for first, node in todo.items():
            if first not in held:
                node.shards = 1
                continue
            r = held[first]
            widest = max(dimensions, key=lambda d: r[f"high_{d}"] - r[f"low_{d}"])
            low, high = (r[f"{n}_{widest}"] << 32 for n in ("low", "high"))
            goal = r["bytes"] * (node.shards // 2) / node.shards
            searches.append(_Search(node, widest, goal, low, high | 0xFFFFFFFF))
        _cuts(at, searches, dimensions)
        for s in searches:
            half = s.node.shards // 2
            s.node.left = Node(s.node.first, half)
            s.node.right = Node(s.node.first + half, s.node.shards - half)


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers within every shard, in the order of ``_row``.

    Rows are numbered within the stored part that they come from; how many a
    shard has in the parts before is one row per part and shard. No shard is
    sorted whole.
    """
    parted = rows.withColumn("_part", F.expr("shiftright(_row, 33)"))
    counts = parted.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part")
    before = counts.select("_part", "shard", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_row"))
    numbered = parted.withColumn("_at", inside)
    return numbered.join(before, ["_part", "shard"]).withColumn("slot", F.expr("_before + _at - 1"))


def sharded(
    documents: DataFrame,
    shards: int = SHARDS,
    dimensions: tuple[str, ...] = DIMENSIONS,
    with_text: bool = True,
) -> DataFrame:
    """(doc_id, [text,] size, text_crc32, law, shard, slot, grown_shard) of every row.

    The law is ``bytes``: leaves of ``tree`` have sizes that differ by little
    more than the largest document. ``size`` is the UTF-8 bytes of the text
    plus OVERHEAD; a null text has none and stays null. Rows of one text and
    place stand side by side in the order of a cut, and are parted only where
    a cut falls between them, so a hot source, or copies that make up a third
    of all rows, are split by weight like others. Rows without doc_id, or with
    nulls in any dimension, have the coordinate 0; repeated rows are all
    placed. An empty table gives no rows. Columns other than these and the
    dimensions are ignored. Runs the passes of the tree when called.
    """
    rows = metadata(documents, dimensions, with_text)
    root = tree(rows, shards, dimensions)
    placed = rows.select(
        "_row", "doc_id", "_size", "_crc32", *(["_text"] if with_text else []),
        F.expr(f"cast({_first_shard(root)} AS int)").alias("shard"),
    )
    return _slots(placed).select(
        "doc_id",
        *([F.col("_text").alias("text")] if with_text else []),
        F.col("_size").alias("size"),
        F.col("_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(documents: DataFrame, place: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Write (doc_id, text, size, text_crc32, slot) to one subfolder ``shard=k`` of ``place`` per shard.

    A shard's files are written by several tasks, each with the rows of some
    slots in order, so that a shard of any size fits.
    """
    rows = sharded(documents, shards, dimensions).drop("law", "grown_shard")
    spread = F.expr("slot div 65536")
    rows.repartition("shard", spread).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(place)
