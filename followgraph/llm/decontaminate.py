"""Benchmark passages in documents: SimHash windows, multi-index blocks, rare shingles, exact checks."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from followgraph.llm.shingles import SHINGLE_WORDS, Words, shingles, words
from followgraph.llm.worker import slices, text_buffer

# Items that are sent to all tasks at once; more items take more passes.
BLOCK_ITEMS = 5_000

BITS, BLOCKS = 64, 4
RADIUS = 11
PERCENT = 75

# Window sizes grow by this factor; an item is searched by its first and by its
# last words, as many as the largest window that it holds.
GROWTH = 1.25
# Windows start at every size // 16 words.
STRIDE_PART = 16
CHUNK_WORDS = 16_384
MOST_WEIGHT = 12
# Bits of a shingle's hash by which most that are in no item are turned away.
FILTER_BITS = 22

FOUND = (
    "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, distance int, similarity double"
)


_NONE = np.empty(0, np.uint64)


def weights(lengths: np.ndarray) -> np.ndarray:
    """Weight of a word: its length in bytes, at most MOST_WEIGHT. Short words are common ones."""
    return np.minimum(lengths, MOST_WEIGHT).astype(np.int64)


def signed(hashes: np.ndarray, weight: np.ndarray, kind: type = np.int16) -> np.ndarray:
    """A row of BITS numbers for each word: plus or minus its weight, by the bits of its hash."""
    # Flat, as a row is whole bytes: numpy is slow on many short rows.
    bits = np.unpackbits(hashes.view(np.uint8)).view(np.int8).reshape(-1, BITS).astype(kind)
    bits *= 2
    bits -= 1
    bits *= weight.astype(kind)[:, None]
    return bits


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: the signs of the sums."""
    return np.packbits((sums > 0).ravel()).view(np.uint64)


def _neighbours(distance: int) -> np.ndarray:
    """All 16-bit masks with at most ``distance`` bits."""
    places = itertools.chain.from_iterable(itertools.combinations(range(16), d) for d in range(distance + 1))
    return np.array([sum(1 << p for p in some) for some in places], np.uint16)


@dataclass
class _Size:
    """What is searched by windows of one size: fingerprints, their items, and the index.

    Of two fingerprints within RADIUS, some 16-bit block is within
    RADIUS // BLOCKS bits. For each block, ``offsets`` and ``entries`` list
    the fingerprints near each of its 65,536 values; ``taken`` tells where any is.
    """

    size: int
    stride: int
    prints: np.ndarray
    items: np.ndarray
    offsets: list[np.ndarray]
    entries: list[np.ndarray]
    taken: list[np.ndarray]


@dataclass
class _Item:
    item_id: int
    words: int
    grams: dict[int, int]
    total: int
    hashes: np.ndarray
    print: np.ndarray


@dataclass
class Index:
    """A block of benchmark items, ready to be searched for.

    ``rare`` has, in order, the rarest shingles of every item, so many that no
    passage without any of them is similar enough; ``owners`` has their items.
    """

    items: list[_Item]
    sizes: list[_Size]
    longest: int
    rare: np.ndarray
    owners: np.ndarray
    known: np.ndarray


def _grams(held: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, their weights (sum of their words'), and bounds of each text's own."""
    hashes, bounds = shingles(held)
    weight = np.append(weights(held.ends - held.starts), np.zeros(SHINGLE_WORDS, np.int64))
    sums = np.convolve(weight, np.ones(SHINGLE_WORDS, np.int64), "full")[SHINGLE_WORDS - 1 :]
    out = np.zeros(len(hashes), np.int64)
    for i in range(len(bounds) - 1):
        n, first = bounds[i + 1] - bounds[i], held.first[i]
        if held.first[i + 1] - first >= SHINGLE_WORDS:
            out[bounds[i] : bounds[i + 1]] = sums[first : first + n]
        elif n:
            out[bounds[i]] = weight[first : held.first[i + 1]].sum()
    return hashes, out, bounds


def _bag(hashes: np.ndarray, weight: np.ndarray) -> dict[int, int]:
    """Total weight of each shingle: repeated ones count as often as they occur."""
    out: dict[int, int] = {}
    for h, w in zip(hashes.tolist(), weight.tolist(), strict=True):
        out[h] = out.get(h, 0) + w
    return out


def build(items: list[tuple[int, str]]) -> Index:
    """Index items (item_id, text). Items of fewer than five words have no shingle and are left out."""
    data, offsets = text_buffer(pa.array([text or "" for _, text in items], pa.large_string()))
    held = words(data, offsets)
    counts = held.counts()
    hashes, weight, bounds = _grams(held)
    kept = [i for i in range(len(items)) if counts[i] >= SHINGLE_WORDS]
    word_weight = weights(held.ends - held.starts)
    known = []
    for i in kept:
        bag = _bag(hashes[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]])
        own = slice(held.first[i], held.first[i + 1])
        whole = signed(held.hashes[own], word_weight[own], np.int64).sum(axis=0)
        grams = np.array(sorted(bag), np.uint64)
        known.append(_Item(items[i][0], int(counts[i]), bag, sum(bag.values()), grams, packed(whole[None, :])))
    sizes = [SHINGLE_WORDS]
    while sizes[-1] < max((x.words for x in known), default=0):
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * GROWTH)))
    by_size: dict[int, list[tuple[int, int]]] = {}
    for number, (i, item) in enumerate(zip(kept, known, strict=True)):
        size = max(s for s in sizes if s <= item.words)
        first = held.first[i]
        by_size.setdefault(size, []).append((number, first))
        if size < item.words:
            by_size[size].append((number, first + item.words - size))
    near = _neighbours(RADIUS // BLOCKS)
    out = []
    for size, places in sorted(by_size.items()):
        sums = [
            signed(held.hashes[at : at + size], word_weight[at : at + size], np.int64).sum(axis=0)
            for _, at in places
        ]
        prints = packed(np.array(sums))
        parts = prints.view(np.uint16).reshape(-1, BLOCKS)
        listed, entries = [], []
        for b in range(BLOCKS):
            values = (parts[:, b, None] ^ near).ravel()
            order = np.argsort(values, kind="stable")
            listed.append(np.searchsorted(values[order], np.arange((1 << 16) + 1)))
            entries.append(np.repeat(np.arange(len(prints)), len(near))[order].astype(np.int32))
        stride = max(1, size // STRIDE_PART)
        numbers = np.array([number for number, _ in places])
        taken = [np.diff(offsets) > 0 for offsets in listed]
        out.append(_Size(size, stride, prints, numbers, listed, entries, taken))
    rare, owners = _rarest(known)
    marks = np.zeros(1 << FILTER_BITS, bool)
    marks[rare >> np.uint64(64 - FILTER_BITS)] = True
    return Index(known, out, max((x.words for x in known), default=0), rare, owners, marks)


def _rarest(items: list[_Item]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and the items of whose weight they are the rarest part.

    A similar passage shares PERCENT hundredths of an item's weight at least,
    hence one of any shingles that weigh more than the rest of the hundred.
    """
    held = Counter(h for item in items for h in item.grams)
    rare: list[int] = []
    owners: list[int] = []
    for number, item in enumerate(items):
        left = item.total
        for h in sorted(item.grams, key=lambda h: (held[h], h)):
            if 100 * left < PERCENT * item.total:
                break
            left -= item.grams[h]
            rare.append(h)
            owners.append(number)
    order = np.argsort(np.array(rare, np.uint64), kind="stable")
    return np.array(rare, np.uint64)[order], np.array(owners, np.int64)[order]


def places(
    hashes: np.ndarray, weight: np.ndarray, bounds: np.ndarray, index: Index
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, first words within the text) of all passages that may be similar enough; none is left out."""
    at = np.flatnonzero(index.known[hashes >> np.uint64(64 - FILTER_BITS)])
    low = np.searchsorted(index.rare, hashes[at], "left")
    n = np.searchsorted(index.rare, hashes[at], "right") - low
    at, low, n = at[n > 0], low[n > 0], n[n > 0]
    entries = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else low
    texts = np.searchsorted(bounds, np.repeat(at, n), "right") - 1
    for code in np.unique(texts * len(index.items) + index.owners[entries]).tolist():
        text, number = divmod(code, len(index.items))
        item = index.items[number]
        own, heavy = hashes[bounds[text] : bounds[text + 1]], weight[bounds[text] : bounds[text + 1]]
        shared = np.where(np.isin(own, item.hashes), heavy, 0)
        if 100 * shared.sum() < PERCENT * item.total:
            continue
        span = min(item.words - SHINGLE_WORDS + 1, len(own))
        both, all_of_it = (
            sums[span:] - sums[:-span] for sums in (np.concatenate([[0], np.cumsum(x)]) for x in (shared, heavy))
        )
        both = np.minimum(both, item.total)
        yield text, number, np.flatnonzero(100 * both >= PERCENT * (item.total + all_of_it - both))


def _near(prints: np.ndarray, kind: _Size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows and fingerprints of items within RADIUS of each other, with their distance."""
    parts = np.ascontiguousarray(prints.view(np.uint16).reshape(-1, BLOCKS).T)
    windows, others = [], []
    for b in range(BLOCKS):
        values = parts[b]
        hit = np.flatnonzero(kind.taken[b].take(values))
        if len(hit):
            values = values[hit].astype(np.int64)
            low = kind.offsets[b][values]
            n = kind.offsets[b][values + 1] - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            windows.append(np.repeat(hit, n))
            others.append(kind.entries[b][at])
    if not windows:
        none = np.empty(0, np.int64)
        return none, none, none
    w, e = np.concatenate(windows), np.concatenate(others)
    far = np.bitwise_count(prints[w] ^ kind.prints[e])
    good = np.flatnonzero(far <= RADIUS)
    return w[good], e[good], far[good].astype(np.int64)


def candidates(held: Words, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first word, size, distance) of windows whose fingerprint is near an item's."""
    n = len(held.hashes)
    if not n or not index.sizes:
        return
    text_of = np.repeat(np.arange(len(held.first) - 1), held.counts())
    last = held.first[text_of + 1]
    weight = weights(held.ends - held.starts)
    widest = index.sizes[-1].size
    kind = np.int16 if widest * MOST_WEIGHT < 1 << 15 else np.int64
    for low in range(0, n, max(CHUNK_WORDS, widest)):
        # Windows that start in this chunk; they may end in the next.
        high = min(n, low + max(CHUNK_WORDS, widest))
        end = min(n, high + widest)
        rows = np.zeros((end - low + 1, BITS), kind)
        np.cumsum(signed(held.hashes[low:end], weight[low:end], kind), axis=0, out=rows[1:])
        # Windows lie on a grid over each text, from its first word on.
        own_text = text_of[low:high]
        within, room = np.arange(low, high) - held.first[own_text], last[low:high] - np.arange(low, high)
        some = np.flatnonzero((held.first[1:] > low) & (held.first[:-1] < high))
        for size in index.sizes:
            step = size.stride
            fits = room >= size.size
            if step == 1:
                # Nearly all places: neighbours are subtracted as they lie, and few of the prints dropped.
                n_here = min(high - low, len(rows) - size.size)
                at = np.flatnonzero(fits)
                prints = packed(rows[size.size : size.size + n_here] - rows[:n_here])[at] if len(at) else _NONE
            else:
                at = np.flatnonzero(fits & (within % step == 0))
                prints = packed(rows.take(at + size.size, axis=0) - rows.take(at, axis=0))
            parts = [(at + low, at + low + size.size, prints)]
            # The last window of a text, where steps pass it by, and texts somewhat shorter than a window.
            a, b = held.first[some], held.first[some + 1]
            at = np.maximum(a, b - size.size)
            own = (at >= low) & (at < high) & (100 * (b - a) >= PERCENT * size.size)
            own &= (step > 1) | (b - a < size.size)
            if own.any():
                at, b = at[own], b[own]
                parts.append((at, b, packed(rows[b - low] - rows[at - low])))
            for starts, ends, prints in parts:
                w, e, far = _near(prints, size)
                inside = ends[w] <= last[starts[w]]
                for i, j, d in zip(w[inside], e[inside], far[inside], strict=True):
                    start = int(starts[i])
                    yield int(text_of[start]), int(size.items[j]), start, int(ends[i]) - start, int(d)


def similarity(one: dict[int, int], two: dict[int, int], total_two: int) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    both = sum(min(w, two.get(h, 0)) for h, w in one.items())
    return both / max(1, sum(one.values()) + total_two - both)


def search(texts: pa.Array, index: Index) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """Best match (similarity, distance, start, end in words) of each (text, item) that is similar enough.

    A candidate is checked at all places where a passage of the item's length
    may lie, given the window's size and stride; so is every place that shares
    enough shingles, whatever its fingerprint.
    """
    data, offsets = text_buffer(texts)
    held = words(data, offsets)
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    hashes, weight, bounds = _grams(held)
    word_weight = weights(held.ends - held.starts)

    def check(text: int, number: int, start: int) -> None:
        item = index.items[number]
        first, last = int(held.first[text]), int(held.first[text + 1])
        end = min(start + item.words, last)
        if (text, number, start) in tried or end - start < SHINGLE_WORDS:
            return
        tried.add((text, number, start))
        low = int(bounds[text]) + start - first
        high = low + end - start - SHINGLE_WORDS + 1
        value = similarity(_bag(hashes[low:high], weight[low:high]), item.grams, item.total)
        if 100 * value >= PERCENT:
            whole = signed(held.hashes[start:end], word_weight[start:end], np.int64).sum(axis=0)
            far = int(np.bitwise_count(packed(whole[None, :]) ^ item.print)[0])
            match = (value, far, start - first, end - first)
            key = (text, number)
            if key not in best or (-match[0], *match[1:]) < (-best[key][0], *best[key][1:]):
                best[key] = match

    for text, number, at, size, _ in candidates(held, index):
        item = index.items[number]
        first, last = int(held.first[text]), int(held.first[text + 1])
        slack = item.words - size + max(1, item.words // STRIDE_PART)
        for start in range(max(first, at - slack), min(at + slack, max(first, last - item.words)) + 1):
            check(text, number, start)
    if len(index.rare):
        for text, number, starts in places(hashes, weight, bounds, index):
            for start in starts.tolist():
                check(text, number, int(held.first[text]) + start)
    return best


def _indexes(benchmark: DataFrame, block_items: int) -> Iterator[Index]:
    """The benchmark as indexes of about ``block_items`` items each, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    ).distinct()
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = build([tuple(r) for r in part.orderBy("item_id", "text").collect()])
        if index.items:
            yield index


def _finder(index: Index, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names = part.column(0)
            rows = [
                (names[text].as_py(), index.items[number].item_id, start, end, far, value)
                for (text, number), (value, far, start, end) in sorted(search(part.column(at), index).items())
            ]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(FIELDS.names, row, strict=True)) for row in rows], schema=FIELDS
            )

    return run


FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("start_word", pa.int64()),
        ("end_word", pa.int64()),
        ("distance", pa.int32()),
        ("similarity", pa.float64()),
    ]
)


def contamination(documents: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, similarity): one row per document and item found.

    A passage of a document is a match if the weighted Jaccard similarity of
    its 5-word shingles to those of a whole item is at least 0.75; a shingle
    weighs as much as its words are long, as often as it occurs. The best
    place is returned, with the bits in which the SimHash of its words differs
    from the item's. Candidates are windows of the item's size whose 64-bit
    SimHash is within RADIUS bits of the item's, and all passages that share
    enough of an item's shingles; so none that is similar enough is left out.

    All documents are read once per ``block_items`` items, which is all that
    is sent to the tasks. Nothing is shuffled. Items or texts without five
    words, or null, match nothing. Items with one text are all found; repeated
    rows of a document give repeated rows. Empty tables give no rows; other
    columns are ignored.
    """
    rows = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    found = [rows.mapInArrow(_finder(index, 1), FOUND) for index in _indexes(benchmark, block_items)]
    out = found[0] if found else documents.sparkSession.createDataFrame([], FOUND)
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``documents`` without a match in ``benchmark``; same columns."""
    at = documents.columns.index("text")

    def cleaner(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                bad = {text for text, _ in search(part.column(at), index)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

        return run

    out = documents
    for index in _indexes(benchmark, block_items):
        out = out.mapInArrow(cleaner(index), documents.schema)
    return out
