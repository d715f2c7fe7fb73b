"""The prefix trie of conversations: sorted shards, and the skeleton of nodes that they share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from followgraph.llm.scratch import stored

# A conversation borrows its first turns from the one of the next lower multiple of this.
FAMILY = 100
BORROWED = 6
# Bytes of a turn's digest in a path, and ids in one piece of a skeleton node's list.
TURN = 16
IDS = 50_000
FLUSH = 20_000
# Bound of the broadcast trie.
SKELETON_BYTES = 64 << 20

NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
# What a shard gives: whole nodes (kind 0), parts of skeleton nodes (1), pieces of their lists of ends (2).
FOUND = f"kind int, {NODE}, key binary, parent binary, place bigint, ids string"
NAMES = [part.split()[0] for part in FOUND.split(", ")]
NODES = [part.split()[0] for part in NODE.split(", ")]
KINDS = [pa.int32()] + [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars) of every conversation, with turns borrowed from the head of its family.

    A path holds the MD5 digest of each turn's role and text; ``chars`` their
    code points. Turns are ordered by number, missing ones first, then role
    and digest. The first h turns of a conversation c, with h = crc32(c) % 6,
    are those of conversation c - c % 100.
    """
    turns = conversations.where("conv_id IS NOT NULL").selectExpr(
        "cast(conv_id AS bigint) AS conv_id",
        "cast(turn AS bigint) AS turn",
        "coalesce(role, '') AS role",
        "coalesce(text, '') AS text",
    )
    digest = "unhex(md5(encode(concat(length(role), ':', role, text), 'utf-8')))"
    turn = F.expr(f"struct(turn, role, {digest} AS digest, length(text) AS chars)")
    own = (
        turns.select("conv_id", turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .selectExpr("conv_id", "transform(turns, t -> struct(t.digest, t.chars)) AS turns")
    )
    head = F.expr(f"slice(turns, 1, {BORROWED - 1})")
    heads = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("_head"), head.alias("_first"))
    h = f"cast(crc32(encode(cast(conv_id AS string), 'utf-8')) % {BORROWED} AS int)"
    whole = (
        own.join(heads, F.expr(f"conv_id - conv_id % {FAMILY} = _head"), "left")
        .selectExpr("conv_id", "turns", "coalesce(_first, array()) AS _first", f"{h} AS _h")
        .selectExpr("conv_id", "concat(slice(_first, 1, _h), slice(turns, _h + 1, size(turns))) AS turns")
    )
    return whole.selectExpr(
        "conv_id",
        "unhex(array_join(transform(turns, t -> hex(t.digest)), '')) AS path",
        "transform(turns, t -> t.chars) AS chars",
    )


def _common(one: bytes, two: bytes) -> int:
    """Turns that two paths have in common at their start."""
    low, high = 0, min(len(one), len(two)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if one[low * TURN : middle * TURN] == two[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class _Open:
    """A node on the path that is being read, with the sums of what is done of its subtree."""

    key: bytes | None
    chars: int
    owned: bool
    goes_on: bool
    first: int
    n: int = 0
    parent_of: int = 0
    children: int = 0
    leaves: int = 0
    # Code points of all members at this node and below, and of the distinct nodes there.
    read: int = 0
    distinct: int = 0
    ends: int = 0
    digest: object = None
    ids: list[str] = field(default_factory=list)
    waiting: list[tuple] = field(default_factory=list)


class _Shard:
    """Builds the nodes of one sorted shard from its paths, one after the other.

    ``left`` and ``right`` are the stretches of path that it shares with the
    shards before and after, None at the ends of the order. Nodes on them, and
    the root, belong to the skeleton: they are given out in parts to be added
    up. That works as all sums are over members, or over nodes that a shard
    owns (it is the first to hold them); a leaf is told by its last shard. All
    other nodes are finished here. A node waits until its parent is done, for
    the parent's smallest member.
    """

    def __init__(self, number: int, left: bytes | None, right: bytes | None):
        self.number, self.left, self.right = number, left, right
        self.stack: list[_Open] = []
        self.path = b""
        self.rows: list[tuple] = []

    def add(self, conv: int, path: bytes, chars: list[int]) -> None:
        shared = _common(self.path, path) if self.stack else -1
        while len(self.stack) > shared + 1:
            self._close()
        self.path = path
        before = -1 if self.left is None else _common(self.left, path)
        after = -1 if self.right is None else _common(self.right, path)
        for d in range(len(self.stack), len(chars) + 1):
            key = hashlib.md5(path[: d * TURN]).digest() if d <= max(before, after, 0) else None
            self.stack.append(_Open(key, chars[d - 1] if d else 0, d > before, d <= after, conv))
        # Counted at its last node; the nodes above get the counts as they close.
        node = self.stack[-1]
        node.n += 1
        node.first = min(node.first, conv)
        if node.key is None:
            node.digest = node.digest or hashlib.sha256()
            node.digest.update((b"," if node.ends else b"") + b"%d" % conv)
            node.ends += 1
        else:
            node.ids.append(str(conv))
            if len(node.ids) >= IDS:
                self._give(node)

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack) - 1
        parent = self.stack[-1] if self.stack else None
        node.leaves += not node.parent_of and not node.goes_on
        node.read += node.n * node.chars
        node.distinct += node.chars * node.owned
        if parent:
            parent.n += node.n
            parent.first = min(parent.first, node.first)
            parent.parent_of += 1
            parent.children += node.owned
            parent.leaves += node.leaves
            parent.read += node.read
            parent.distinct += node.distinct
        sums = (node.first, depth + 1, None, node.n, node.children, node.leaves, node.read - node.distinct)
        if node.key is not None:
            self._give(node)
            self.rows.append((1, *sums, None, node.key, parent.key if parent else None, None, None))
            return
        row = (*sums, (node.digest or hashlib.sha256()).hexdigest())
        if parent.key is None:
            parent.waiting.append(row)
        else:
            self.rows.append((0, *row, None, parent.key, None, None))
        for child in node.waiting:
            self.rows.append((0, *child[:2], node.first, *child[3:], None, None, None, None))

    def _give(self, node: _Open) -> None:
        """A piece of a skeleton node's list of ends, with its place in the order."""
        if node.ids:
            place = self.number << 32 | node.ends
            self.rows.append((2, *[None] * 8, node.key, None, place, ",".join(node.ids)))
            node.ends += 1
            node.ids = []

    def end(self) -> None:
        while self.stack:
            self._close()

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def _local(borders: dict[int, tuple[bytes | None, bytes | None]]):
    """All nodes of sorted shards (part, conv_id, path, chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for part, conv, path, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None or shard.number != part:
                    if shard:
                        shard.end()
                        yield shard.flush()
                    shard = _Shard(part, *borders[part])
                shard.add(conv, path, chars)
                if len(shard.rows) >= FLUSH:
                    yield shard.flush()
        if shard:
            shard.end()
            yield shard.flush()

    return run


def _skeleton(sorted_parts: DataFrame) -> tuple[dict[int, int], dict[int, tuple[bytes | None, bytes | None]]]:
    """The shard of each range partition, and the trie of the paths at which shards meet.

    The trie is given as the stretch of path that each two neighbours share:
    a splitter's path, cut where nothing goes on across it. Equal stretches
    are one object, sent once. Where the trie takes more than SKELETON_BYTES,
    neighbouring partitions become one shard until it does not.
    """
    ends = sorted_parts.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    parts = [(r["part"], bytes(r["low"]), bytes(r["high"])) for r in ends.orderBy("part").collect()]
    each = 1
    while True:
        groups = [parts[i : i + each] for i in range(0, len(parts), each)]
        held: dict[bytes, bytes] = {}
        meet: list[bytes | None] = [None]
        for one, two in zip(groups, groups[1:], strict=False):
            path = one[-1][2]
            shared = path[: TURN * _common(path, two[0][1])]
            meet.append(held.setdefault(shared, shared))
        meet.append(None)
        if sum(map(len, held)) <= SKELETON_BYTES or len(groups) < 2:
            shard = {part: i for i, group in enumerate(groups) for part, _, _ in group}
            return shard, {i: (meet[i], meet[i + 1]) for i in range(len(groups))}
        each *= 2


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's list, its pieces read one after the other."""
    key, digest, keys, found = None, None, [], []
    for batch in batches:
        for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now != key:
                if digest:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = now, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest:
        keys.append(key)
        found.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "digest"])


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of stored ``paths`` (conv_id, path, chars), as NODE says.

    1. A range partition by (path, conv_id) cuts the order into shards; many
       equal paths are cut by conv_id.
    2. The paths at which shards meet make a small trie, which is broadcast.
       Its nodes, the skeleton, are all those that two shards can share.
    3. Each shard, sorted, is read once with one open path: it finishes all
       other nodes and gives its parts of skeleton nodes.
    4. Parts of a skeleton node are summed by key. The list that its hash
       covers comes in pieces, in order, and is never held whole.
    """
    ranged = stored(paths.repartitionByRange("path", "conv_id").withColumn("part", F.spark_partition_id()))
    shard, borders = _skeleton(ranged)
    if not borders:
        return paths.sparkSession.createDataFrame([], NODE)
    if any(part != number for part, number in shard.items()):
        numbers = paths.sparkSession.createDataFrame(list(shard.items()), "part int, shard int")
        ranged = ranged.join(F.broadcast(numbers), "part").withColumn("part", F.col("shard"))
    inner = ranged.select("part", "conv_id", "path", "chars")
    inner = inner.repartition("part").sortWithinPartitions("part", "path", "conv_id")
    found = stored(inner.mapInArrow(_local(borders), FOUND))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = (
        found.where("kind = 1")
        .groupBy("key")
        .agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent").alias("parent"), *sums)
    )
    pieces = found.where("kind = 2").select("key", "ids", "place")
    ends = (
        pieces.repartition("key")
        .sortWithinPartitions("key", "place")
        .select("key", "ids")
        .mapInArrow(_digests, "key binary, digest string")
    )
    none = hashlib.sha256().hexdigest()
    skeleton = shared.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(none)))
    names = shared.select(F.col("key").alias("_parent"), F.col("conv_id").alias("_conv"))
    open_ = found.where("kind = 0 AND parent IS NOT NULL").select(*NODES, "parent")
    both = open_.drop("parent_conv_id").unionByName(skeleton.select(*open_.drop("parent_conv_id").columns))
    named = both.join(names, F.expr("parent = _parent"), "left").withColumn("parent_conv_id", F.col("_conv"))
    return found.where("kind = 0 AND parent IS NULL").select(*NODES).unionByName(named.select(*NODES))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of rebuilt conversations, from the empty one on, as NODE says.

    ``rebuilt`` tells how conversations are rebuilt. A node is a sequence of
    the first ``depth`` turns; ``conv_id`` is the smallest of its ``n_convs``
    members and ``parent_conv_id`` its parent's. ``n_leaves`` counts childless
    nodes of the subtree and ``saved_tokens`` sums (members - 1) times the
    code points of the last text over it. ``ends_sha256`` covers the members
    that end there. Null roles and texts are empty; turns of one number are in
    the order of role and digest, repeated rows stay repeated turns. Rows
    without conv_id take no part; an empty table gives no rows; other columns
    are ignored. A path takes 16 bytes a turn, whatever the length of a text,
    so one conversation must fit a row in that form.
    """
    return trie(rebuilt(conversations))
