"""Secrets in text: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from followgraph.llm.shingles import mix
from followgraph.llm.worker import once, slices, text_buffer

BASE = ("assign", "access", "hex")
ADDED = "crf"
KINDS = (*BASE, ADDED)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Whole runs only, so a long run of other letters takes linear time.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# The same patterns for choosing sample rows; they need not agree to the letter.
SAMPLE_PATTERN = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

# Bounds of the sample that a model is fitted on: rows with a base span and as many
# without, characters of a row, tokens around a span, spans of a row.
SAMPLE_ROWS = 300
SAMPLE_CHARS = 20_000
WINDOW = 40
SPANS_PER_TEXT = 4
# Bytes of text, and tokens, whose features and scores are made at once.
PIECE = 1 << 17
CHUNK = 1 << 13
STEPS = 120
RATE = 0.25
DECAY = 2e-3
NONE = -1e9
LEAST_CHARS = 8

OUT, BEGIN, INSIDE = 0, 1, 2
WORD_SLOTS = 4096

LOWER, UPPER, DIGIT, SIGN, FOREIGN, SPACE, MARK = range(7)


def _byte_classes() -> np.ndarray:
    """Class of every byte: letters, digits, + / _ . -, non-ASCII, white space, other marks."""
    kind = np.full(256, MARK, np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = LOWER, UPPER, DIGIT
    kind[[ord(c) for c in "+/_.-"]] = SIGN
    kind[128:] = FOREIGN
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    return kind


# Name and number of values of each feature. Neighbours' words are hashed.
FEATURES = (
    ("length", 16),
    ("classes", 64),
    ("digit share", 12),
    ("alternations", 16),
    ("hexadecimal by length", 34),
    ("word", WORD_SLOTS),
    ("word before", WORD_SLOTS),
    ("second word before", WORD_SLOTS),
    ("third word before", WORD_SLOTS),
    ("word after", WORD_SLOTS),
    ("classes before", 64),
    ("classes after", 64),
    ("size of the file", 24),
    ("digits in the file", 8),
)
OFFSETS = np.cumsum([0, *(n for _, n in FEATURES)])


@dataclass
class Tokens:
    """Tokens of consecutive texts, in 15 bytes each: start and end byte, own features, word.

    ``first`` is the first token of each text and the number of all; ``size``
    and ``rate`` are features of the texts. Features of neighbours are looked
    up when asked for.
    """

    starts: np.ndarray
    ends: np.ndarray
    own: np.ndarray
    word: np.ndarray
    first: np.ndarray
    size: np.ndarray
    rate: np.ndarray

    def features(self, low: int, high: int) -> np.ndarray:
        """One row per token from number ``low`` to ``high``, with places in the weight table."""
        here = np.arange(low, high)
        text = np.searchsorted(self.first, here, "right") - 1
        begin, end = self.first[text], self.first[text + 1]

        def moved(values: np.ndarray, by: int) -> np.ndarray:
            """The value of the token ``by`` places on in the same text, else 0."""
            there = here + by
            inside = (there >= begin) & (there < end)
            return np.where(inside, values[np.where(inside, there, low)], 0)

        classes = self.own[:, 1]
        columns = [
            *self.own[low:high].T,
            self.word[low:high],
            moved(self.word, -1),
            moved(self.word, -2),
            moved(self.word, -3),
            moved(self.word, 1),
            moved(classes, -1),
            moved(classes, 1),
            self.size[text],
            self.rate[text],
        ]
        return np.stack([c.astype(np.int32) + o for c, o in zip(columns, OFFSETS[:-1], strict=True)], axis=1)


def _bucket(x: np.ndarray, most: int) -> np.ndarray:
    """Size on a scale of half powers of two."""
    return np.minimum(np.floor(2 * np.log2(x + 1)).astype(np.int32), most)


def _own(length: np.ndarray, held: list[np.ndarray], turns: np.ndarray, hexes: np.ndarray, sums: np.ndarray):
    """Own features and word of tokens, from counts of their bytes' classes."""
    digits = held[DIGIT]
    columns = [
        _bucket(length, 15),
        sum((h > 0).astype(np.int32) << i for i, h in enumerate(held)),
        np.where(digits > 0, 1 + np.minimum(10 * digits // length, 10), 0),
        np.minimum(turns, 15),
        np.where(hexes == length, 17 + _bucket(length, 16), _bucket(hexes, 16)),
    ]
    word = (mix(sums + length.astype(np.uint64)) % np.uint64(WORD_SLOTS - 2)).astype(np.uint16) + np.uint16(2)
    return np.stack(columns, axis=1).astype(np.uint8), word


# The order of ``held``; a mark comes last there, and digits at their own number.
HELD = (LOWER, UPPER, DIGIT, SIGN, FOREIGN, MARK)


def _piece(data: np.ndarray, kind: np.ndarray, change: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Own features, words and digits of all tokens of a piece, by running sums."""

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] - sums[starts]

    held = [count(kind == k) for k in HELD]
    turns = np.zeros(len(data), bool)
    turns[1:] = (kind[1:] != kind[:-1]) & ~change[1:]
    hexes = count((kind == DIGIT) | ((data >= 97) & (data <= 102)))
    marks = mix(np.where(kind == UPPER, data + 32, data).astype(np.uint64) + np.uint64(1))
    place = np.arange(len(data), dtype=np.uint64)
    # A word's hash depends on its bytes and on their places in the word.
    sums, plain = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    np.cumsum(marks * (np.uint64(2) * place + np.uint64(1)), out=sums[1:])
    np.cumsum(marks, out=plain[1:])
    here = sums[ends] - sums[starts] - (plain[ends] - plain[starts]) * (np.uint64(2) * starts.astype(np.uint64))
    return *_own(ends - starts, held, count(turns), hexes, here), held[DIGIT]


def _long_token(data: np.ndarray):
    """The same of a single token of any length, block by block."""
    table = once("secrets.classes", _byte_classes)
    counts, turns, hexes, before = np.zeros(7, np.int64), 0, 0, None
    sums = np.zeros(1, np.uint64)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE]
        kind = table[part]
        counts += np.bincount(kind, minlength=7)
        turns += int((kind[1:] != kind[:-1]).sum()) + (before is not None and kind[0] != before)
        hexes += int(((kind == DIGIT) | ((part >= 97) & (part <= 102))).sum())
        marks = mix(np.where(kind == UPPER, part + 32, part).astype(np.uint64) + np.uint64(1))
        place = np.arange(at, at + len(part), dtype=np.uint64)
        sums += (marks * (np.uint64(2) * place + np.uint64(1))).sum(dtype=np.uint64)
        before = kind[-1]
    held = [counts[k : k + 1] for k in HELD]
    return *_own(np.array([len(data)]), held, np.array([turns]), np.array([hexes]), sums), held[DIGIT]


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of word bytes and runs of marks, with their features. Nothing crosses a text.

    The bytes are gone through in pieces of PIECE, cut between runs, so only
    the compact result grows with a text. The result does not depend on PIECE.
    """
    table = once("secrets.classes", _byte_classes)
    texts, total = len(offsets) - 1, len(data)
    parts: list[tuple] = []
    digits = np.zeros(texts, np.int64)
    low = 0
    while low < total:
        high = min(low + PIECE, total)
        kind = table[data[low:high]]
        coarse = np.where(kind == SPACE, 0, np.where(kind == MARK, 2, 1)).astype(np.uint8)
        change = np.ones(high - low, bool)
        change[1:] = coarse[1:] != coarse[:-1]
        cuts = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high)]
        change[cuts - low] = True
        runs = np.flatnonzero(change)
        if high < total and len(runs) > 1:
            # The last run may go on: it opens the next piece.
            runs, high = runs[:-1], low + int(runs[-1])
        elif high < total:
            limit = int(offsets[np.searchsorted(offsets, low, "right")])
            while high < limit:
                more = table[data[high : min(high + PIECE, limit)]]
                other = np.flatnonzero(np.where(more == SPACE, 0, np.where(more == MARK, 2, 1)) != coarse[0])
                high += int(other[0]) if len(other) else len(more)
                if len(other):
                    break
        ends = np.append(runs[1:], high - low)
        solid = coarse[runs] > 0
        starts, ends = runs[solid], ends[solid]
        if len(starts):
            size = high - low
            if size > PIECE:
                found = _long_token(data[low:high])
            else:
                found = _piece(data[low:high], kind[:size], change[:size], starts, ends)
            text = np.searchsorted(offsets, starts + low, "right") - 1
            digits += np.bincount(text, weights=found[2], minlength=texts).astype(np.int64)
            parts.append(((starts + low).astype(np.int32), (ends + low).astype(np.int32), *found[:2]))
        low = high
    if not parts:
        none = np.empty(0, np.int32)
        parts = [(none, none, np.empty((0, 5), np.uint8), np.empty(0, np.uint16))]
    starts, ends, own, word = (np.concatenate(column) for column in zip(*parts, strict=True))
    first = np.searchsorted(starts, offsets)
    size = np.diff(first)
    rate = np.where(size > 0, digits / np.maximum(size, 1), 0)
    return Tokens(
        starts, ends, own, word, first,
        _bucket(size, 23).astype(np.uint8), np.minimum((8 * rate).astype(np.int64), 7).astype(np.uint8),
    )


@dataclass
class Model:
    """Weights of features (one column per tag) and of tag pairs; ``start`` of a first tag."""

    weights: np.ndarray
    pairs: np.ndarray
    start: np.ndarray


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """What is ruled out: a text or a stretch outside is not followed by an inside tag."""
    pairs, start = np.zeros((3, 3)), np.zeros(3)
    pairs[OUT, INSIDE] = start[INSIDE] = NONE
    return pairs, start


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(windows: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Maximum conditional likelihood, by adaptive gradient steps over all windows.

    A window is (features, tags) of consecutive tokens. Shorter windows are
    padded at their end with tokens outside that have no features.
    """
    size = max(len(t) for _, t in windows)
    empty = int(OFFSETS[-1])
    features = np.full((len(windows), size, len(FEATURES)), empty, np.int64)
    tags = np.zeros((len(windows), size), np.int64)
    for i, (f, t) in enumerate(windows):
        features[i, : len(t)], tags[i, : len(t)] = f, t
    ruled, ruled_start = _allowed()
    weights, pairs, start = np.zeros((empty + 1, 3)), np.zeros((3, 3)), np.zeros(3)
    seen = [np.full_like(w, 1e-6) for w in (weights, pairs, start)]
    gold = np.eye(3)[tags]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    flat = features.reshape(-1)
    for _ in range(STEPS):
        weights[empty] = 0
        scores = weights[features].sum(axis=2)
        steps = pairs + ruled
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + start + ruled_start
        for t in range(1, size):
            forward[:, t] = scores[:, t] + _log_sum(forward[:, t - 1, :, None] + steps, 1)
        for t in range(size - 2, -1, -1):
            backward[:, t] = _log_sum(steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = _log_sum(forward[:, -1], 1)[:, None, None]
        chance = np.exp(forward + backward - total)
        joint = np.exp(
            forward[:, :-1, :, None] + steps + (scores + backward)[:, 1:, None, :] - total[..., None]
        ).sum(axis=(0, 1))
        off = (gold - chance).reshape(-1, 3)
        slope = np.empty_like(weights)
        for tag in range(3):
            slope[:, tag] = np.bincount(flat, np.repeat(off[:, tag], len(FEATURES)), empty + 1)
        slopes = (slope, gold_pairs - joint, (gold - chance)[:, 0].sum(axis=0))
        for w, g, s in zip((weights, pairs, start), slopes, seen, strict=True):
            g = g / len(windows) - DECAY * w
            s += g * g
            w += RATE * g / np.sqrt(s)
    weights[empty] = 0
    return Model(weights.astype(np.float32), pairs + ruled, start + ruled_start)


def best_path(chunks: Iterable[np.ndarray], model: Model) -> bytearray:
    """The best tags of one text, whose scores come in chunks; of equal paths the one of smaller tags, from the end.

    Kept per token is one byte, the best tag before each of its three.
    """
    (p00, p01, p02), (p10, p11, p12), (p20, p21, p22) = model.pairs.tolist()
    back = bytearray()
    best = None
    for chunk in chunks:
        for s0, s1, s2 in chunk.tolist():
            if best is None:
                best = [s + a for s, a in zip((s0, s1, s2), model.start.tolist(), strict=True)]
                back.append(0)
                continue
            b0, b1, b2 = best
            x, y, z = b0 + p00, b1 + p10, b2 + p20
            f0, n0 = ((0, x) if x >= z else (2, z)) if x >= y else ((1, y) if y >= z else (2, z))
            x, y, z = b0 + p01, b1 + p11, b2 + p21
            f1, n1 = ((0, x) if x >= z else (2, z)) if x >= y else ((1, y) if y >= z else (2, z))
            x, y, z = b0 + p02, b1 + p12, b2 + p22
            f2, n2 = ((0, x) if x >= z else (2, z)) if x >= y else ((1, y) if y >= z else (2, z))
            back.append(f0 | f1 << 2 | f2 << 4)
            best = [n0 + s0, n1 + s1, n2 + s2]
    if best is None:
        return back
    tag = best.index(max(best))
    for at in range(len(back) - 1, -1, -1):
        back[at], tag = tag, back[at] >> 2 * tag & 3
    return back


def viterbi(scores: np.ndarray, model: Model) -> list[int]:
    """The best tags of one text."""
    return list(best_path([scores], model))


def _scored(held: Tokens, model: Model, low: int, high: int) -> Iterator[np.ndarray]:
    """Scores of the three tags of tokens ``low`` to ``high``, a chunk at a time."""
    for at in range(low, high, CHUNK):
        features = held.features(at, min(at + CHUNK, high))
        scores = np.zeros((len(features), 3), np.float32)
        for column in features.T:
            scores += model.weights[column]
        yield scores


def _hopeful(scores: np.ndarray, model: Model) -> np.ndarray:
    """Tokens without which no text is tagged otherwise than outside throughout.

    A stretch of tagged tokens gains at most the sum of these terms over its
    tokens; where none is positive, the path outside is the best.
    """
    stay = model.pairs[OUT, OUT]
    enter = max(model.start[BEGIN] - model.start[OUT], (model.pairs[:, 1:] - stay).max())
    leave = max(0.0, (model.pairs[1:, OUT] - stay).max())
    return scores[:, 1:].max(axis=1) - scores[:, OUT] + enter + leave > 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _silver(text: str) -> list[tuple[int, int]]:
    """The secret parts of base spans, in bytes."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    found += [(s, e) for kind, s, e in base_spans(text) if kind != "assign"]
    return [(len(text[:s].encode()), len(text[:e].encode())) for s, e in found]


def train(
    documents: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    spans_per_text: int = SPANS_PER_TEXT,
    window: int = WINDOW,
) -> Model | None:
    """A model fitted to what the base patterns find; None where they find nothing.

    The sample is bounded by its parameters: at most ``sample_rows`` texts
    with a base span and as many without, of at most ``sample_chars``
    characters, those of smallest hash. Of a text at most ``spans_per_text``
    base spans count, chosen by a hash of their place, each with the
    ``window`` tokens around it. In every other window the neighbouring words
    are hidden, so that shape alone tells too.
    """
    texts = documents.select("text").where(F.length("text").between(1, sample_chars))
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    chosen: list[int] = []
    for found in (True, False):
        some = hashed.where(F.col("text").rlike(SAMPLE_PATTERN) == F.lit(found))
        # Hashes alone are sorted and sent: every task sends its smallest ones.
        chosen += [r[0] for r in some.select("hash").distinct().orderBy("hash").limit(sample_rows).collect()]
    rows = hashed.where(F.col("hash").isin(chosen)).groupBy("hash").agg(F.min("text")).orderBy("hash")
    rows = [(r[1],) for r in rows.collect()] if chosen else []
    windows = []
    words = [i for i, (name, _) in enumerate(FEATURES) if "word" in name]
    for row in rows:
        data = np.frombuffer(row[0].encode(), np.uint8)
        held = tokens(data, np.array([0, len(data)]))
        tags = np.zeros(len(held.starts), np.int64)
        secret = _silver(row[0])
        for start, end in secret:
            own = np.flatnonzero((held.starts < end) & (held.ends > start))
            own = own[tags[own] == OUT]
            tags[own] = INSIDE
            tags[own[:1]] = BEGIN
        marked = np.flatnonzero(tags == BEGIN)
        marked = np.sort(marked[np.argsort(mix(marked.astype(np.uint64)))[:spans_per_text]])
        for at in marked if len(marked) else (len(tags) // 3, 2 * len(tags) // 3):
            low = max(0, int(at) - window // 2)
            part = held.features(low, min(low + window, len(tags)))
            if len(part):
                if len(windows) % 2:
                    part[:, words] = OFFSETS[:-1][words]
                windows.append((part, tags[low : low + window]))
    return fit(windows) if any(t.any() for _, t in windows) else None


def _stretches(tags: bytearray) -> Iterator[tuple[int, int]]:
    """(first, end) of every tagged stretch."""
    at = tags.find(BEGIN)
    while at >= 0:
        stop = at + 1
        while stop < len(tags) and tags[stop] == INSIDE:
            stop += 1
        yield at, stop
        at = tags.find(BEGIN, stop)


def _characters(raw: np.ndarray) -> int:
    """Code points of UTF-8 bytes, counted in blocks."""
    return sum(int(((raw[at : at + PIECE] & 0xC0) != 0x80).sum()) for at in range(0, len(raw), PIECE))


def find(texts: list[str], model: Model | None) -> list[list[tuple[str, int, int]]]:
    """All spans of every text: base spans, and those the model adds clear of them.

    Besides the texts, some 20 bytes a token are held and what a piece or a
    chunk takes, also of a very long text.
    """
    spans = [base_spans(text) for text in texts]
    if model is None or not texts:
        return spans
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    held = tokens(data, offsets)
    at, hopeful = 0, []
    for scores in _scored(held, model, 0, len(held.starts)):
        some = np.flatnonzero(_hopeful(scores, model)) + at
        hopeful.append(np.unique(np.searchsorted(held.first, some, "right") - 1))
        at += len(scores)
    for i in np.unique(np.concatenate(hopeful)) if hopeful else ():
        a, b = int(held.first[i]), int(held.first[i + 1])
        raw = data[offsets[i] : offsets[i + 1]]
        covered = sorted((s, e) for _, s, e in spans[i])
        starts = [s for s, _ in covered]
        reach = list(accumulate((e for _, e in covered), max))
        byte = place = 0
        for one, two in _stretches(best_path(_scored(held, model, a, b), model)):
            low, high = int(held.starts[a + one] - offsets[i]), int(held.ends[a + two - 1] - offsets[i])
            start = place + _characters(raw[byte:low])
            end = start + _characters(raw[low:high])
            byte, place = high, end
            # Of base spans that start before its end, the one that reaches farthest must end before it.
            known = bisect_left(starts, end)
            if end - start >= LEAST_CHARS and (not known or reach[known - 1] <= start):
                spans[i].append((ADDED, start, end))
        spans[i].sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, counts of base kinds, base_sha256, spans) per row of ``documents``.

    ``spans`` lists all spans as ``joined`` does; ``base_sha256`` is the hash
    of the base ones alone. A null or empty text has none. Repeated rows and
    rows without a doc_id are scanned like any other; an empty table gives no
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = find([text or "" for text in part.column(1).to_pylist()], model)
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                    pa.array([joined(s) for s in found], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, schema)


PLACEHOLDER = "[SECRET]"


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every stretch covered by spans replaced by a placeholder."""
    out, done = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= done:
            out += [text[done:start], PLACEHOLDER]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(documents: DataFrame, model: Model | None) -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced; ``n_chars`` follows if it is there.

    A null text stays null.
    """
    columns = documents.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            found = find([text or "" for text in texts], model)
            clean = [t if not s else masked(t, s) for t, s in zip(texts, found, strict=True)]
            arrays = list(part.columns)
            arrays[at] = pa.array(clean, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

    done = documents.mapInArrow(run, documents.schema)
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return done
