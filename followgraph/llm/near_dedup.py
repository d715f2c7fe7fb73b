"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from followgraph.llm.components import components
from followgraph.llm.scratch import stored
from followgraph.llm.shingles import mix, shingles, words
from followgraph.llm.worker import once, slices, text_buffer

# 32 bands of 4: a pair at the threshold is missed with probability 5e-6.
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 22
SEED = 20240229
CHUNK = 2048

# Similarity in hundredths.
PERCENT = 75

# Members of one bucket that are checked against its leader in one task.
SALT_ROWS = 512


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The two permutations; the second as all its windows of BANDS * ROWS values.

    Window p holds the second permutation shifted to p: one value for each
    signature coordinate.
    """
    rng = np.random.default_rng(SEED)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    size = BANDS * ROWS
    around = np.concatenate([second, second[: size - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(around, size)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes."""
    first, shifted = once("near_dedup.permutations", _permutations)
    at = first[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    parts = [shifted[at[i : i + CHUNK]].min(axis=0) for i in range(0, len(at), CHUNK)]
    return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.broadcast_to(keys, parts.shape[:2])
    for r in range(ROWS):
        keys = mix(keys ^ parts[:, :, r])
    return keys.view(np.int64)


def _digest(own: np.ndarray) -> tuple[int, int]:
    """Two order-free hashes of a set."""
    return int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()), int(mix(own * np.uint64(3)).sum())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        data, offsets = text_buffer(part.column(1))
        hashes, bounds = shingles(words(data, offsets))
        n = len(bounds) - 1
        sizes = np.zeros(n, np.int64)
        keys = np.zeros((2, n), np.uint64)
        signed = np.zeros((n, BANDS * ROWS), np.int32)
        for i in range(n):
            own = np.unique(hashes[bounds[i] : bounds[i + 1]])
            if len(own):
                sizes[i] = len(own)
                keys[:, i] = _digest(own)
                signed[i] = signature(own)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands(signed).ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(sizes),
                pa.array(keys[0].view(np.int64)),
                pa.array(keys[1].view(np.int64)),
                lists,
            ],
            ["doc_id", "n", "k1", "k2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        data, offsets = text_buffer(part.column(1))
        hashes, bounds = shingles(words(data, offsets))
        own = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        flat = np.concatenate(own) if own else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
            ["doc_id", "grams"],
        )


def _verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, salt) whose full sets are similar enough, as links (a, b).

    The set of a leader ``b`` is sent once to each of its salts, so its members
    are spread over tasks.
    """
    first = pairs.join(grams.withColumnRenamed("doc_id", "a"), "a")
    spread = pairs.select("b", "salt").distinct()
    second = spread.join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("others")), "b")
    met = first.join(second, ["b", "salt"]).select(
        "a",
        "b",
        F.size("grams").alias("x"),
        F.size("others").alias("y"),
        F.size(F.array_intersect("grams", "others")).alias("both"),
    )
    return met.where(f"100L * both >= {percent}L * (x + y - both)").select("a", "b").distinct()


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that span several components, with the bucket's largest component."""
    placed = members.join(classes, F.col("doc_id") == F.col("node"), "left").selectExpr(
        "bucket", "m", "doc_id", "n", "at", "coalesce(component, doc_id) AS component"
    )
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    most = (
        parts.groupBy("bucket")
        .agg(F.count("*").alias("classes"), F.max(F.struct("size", "component")).alias("top"))
        .where("classes > 1")
        .selectExpr("bucket", "top.component AS largest")
    )
    return placed.join(most, "bucket")


def _stars(classes: DataFrame) -> DataFrame:
    return classes.selectExpr("node AS a", "component AS b")


def _prefixes(grams: DataFrame, percent: int) -> DataFrame:
    """(bucket, m, doc_id, n, at): the shingles by which similar sets must meet.

    With the shingles of all sets in one order, rarest first, two sets of the
    required similarity share one among the first n - ceil(t * n) + 1 of each.
    ``at`` is its place from 0; ``m`` the number of sets that hold it at all.
    """
    each = grams.select("doc_id", F.size("grams").cast("bigint").alias("n"), F.explode("grams").alias("bucket"))
    known = each.groupBy("bucket").agg(F.count("*").alias("m"))
    ordered = (
        each.join(known, "bucket")
        .groupBy("doc_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("m", "bucket"))).alias("grams"))
    )
    first = F.expr(f"slice(grams, 1, cast(n - ({percent}L * n + 99L) div 100L + 1L AS int))")
    return ordered.select("doc_id", "n", F.posexplode(first).alias("at", "gram")).selectExpr(
        "doc_id", "n", "at", "gram.m", "gram.bucket"
    ).where("m > 1")


def near_duplicates(
    documents: DataFrame, percent: int = PERCENT, salt_rows: int = SALT_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``documents``.

    Documents are linked when the Jaccard similarity of their sets of 5-word
    shingles is at least ``percent`` hundredths. ``component_id`` is the
    smallest doc_id reachable over links; ``kept`` marks that document.

    1. Every text becomes a circulant MinHash signature; equal sets become one
       node, so copies cost no pairs.
    2. Nodes that share a band meet in a bucket. Each is checked against a
       leader that the bucket draws: as many pairs as members. Buckets draw
       differently, so a group of near copies has many leaders.
    3. Members of buckets that still span several components are compared
       exactly: by the rarest shingles of each set, one of which similar sets
       must share, and only across components. So no link that a bucket shows
       is lost, and a large group of copies is not squared.

    Sets are compared as full sets of 64-bit hashes, once per candidate pair.
    A null text is empty; an empty text has n_shingles 0 and is its own
    component. Rows that share a doc_id are one document. A row without
    doc_id is linked with nothing: component_id null, kept true. An empty
    table gives no rows; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"
    sketches = stored(docs.mapInArrow(_sketches, sketch))
    linked = sketches.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stored(
        linked.groupBy("k1", "k2", "n")
        .agg(F.min(F.struct("doc_id", "bands")).alias("one"))
        .select("k1", "k2", "n", "one.doc_id", "one.bands")
    )
    rows = nodes.select(F.explode("bands").alias("bucket"), "doc_id", "n")
    shared = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.expr("min(struct(xxhash64(bucket, doc_id) AS draw, doc_id, n)) AS head"))
        .where("m > 1")
    )
    members = stored(
        rows.join(shared, "bucket").selectExpr("bucket", "m", "doc_id", "n", "head.doc_id AS head", "head.n AS head_n")
    )
    ids = members.select("doc_id").distinct()
    grams = stored(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, grams array<bigint>"))

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, n_a, b, n_b, m), each pair checked once.

        A pair is dealt to one of the shares of the largest bucket it comes from.
        """
        slot = F.expr(f"pmod(xxhash64(a), (max(m) + {salt_rows - 1}L) div {salt_rows}L)")
        sized = pairs.where(f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)")
        return stored(_verified(stored(sized.groupBy("a", "b").agg(slot.alias("salt"))), grams, percent))

    stars = members.where("doc_id != head").selectExpr(
        "doc_id AS a", "n AS n_a", "head AS b", "head_n AS n_b", "m"
    )
    classes = stored(components(checked(stars)))
    unsettled = _open(members.withColumn("at", F.lit(0)), classes).select("doc_id").distinct()
    rest = grams.join(unsettled, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rare = stored(_open(_prefixes(rest, percent), classes))
    left = rare.where("component != largest").selectExpr(
        "bucket", "doc_id AS a", "n AS n_a", "at AS at_a", "component AS c_a"
    )
    right = rare.selectExpr(
        "bucket",
        "m",
        "doc_id AS b",
        "n AS n_b",
        "at AS at_b",
        "component AS c_b",
        "component != largest AS outside",
    )
    # At the first shingle that a pair shares, enough must be left for the required overlap.
    enough = f"{100 + percent}L * least(n_a - at_a, n_b - at_b) >= {percent}L * (n_a + n_b)"
    across = left.join(right, "bucket").where(f"c_a != c_b AND (NOT outside OR a > b) AND {enough}")
    late = checked(across.drop("bucket"))
    twins = linked.join(
        nodes.select("k1", "k2", "n", F.col("doc_id").alias("b")), ["k1", "k2", "n"]
    ).select(F.col("doc_id").alias("a"), "b")
    final = components(_stars(classes).unionAll(late).unionAll(twins.where("a != b")))
    return sketches.join(final, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.expr("doc_id IS NULL OR coalesce(component, doc_id) = doc_id").alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents of which each is the first of its group; same columns.

    Of rows that share a doc_id, one stays: the one with the smallest text.
    Rows without a doc_id all stay.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    gone = near_duplicates(documents, percent).where("NOT kept").select("doc_id").distinct()
    named = documents.where("doc_id IS NOT NULL")
    rest = named.join(gone, named["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    first = rest.withColumn("_followgraph_row", order).where("_followgraph_row = 1")
    return first.select(*columns).unionAll(documents.where("doc_id IS NULL").select(*columns))
