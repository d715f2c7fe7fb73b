"""Byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from followgraph.llm.worker import once, slices

# Entries of one memo; a full memo is emptied, so memory is bounded.
MEMO = 200_000
NEVER = 1 << 62
# A mark that ends a word is a match of its own.
MARKS = tuple(".,;:!?")


class Vocabulary:
    """Ranks of byte strings, and which two tokens may stand side by side.

    A token's history is the tree of merges that makes it from single bytes.
    Two tokens are compatible if merging their joint bytes gives just the two:
    no merge across the border comes before both of its sides are used up.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.memo: dict[int, bool] = {}
        # A token that merging does not make is never part of an encoding.
        self.made = {token: rank for token, rank in ranks.items() if self.makes(token)}
        self.finder = ahocorasick.Automaton()
        for token, rank in self.made.items():
            self.finder.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.finder.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A file of lines ``base64-bytes rank``."""
        with open(path, "rb") as lines:
            rows = (line.split() for line in lines)
            return cls({base64.b64decode(row[0]): int(row[1]) for row in rows if row})

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; None if merging does not make it."""
        if token not in self.halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                found = [(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(found)
                if rank == NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def makes(self, token: bytes) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def _edge(self, rank: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at one edge of a token over time: (part, rank of the merge that ends it)."""
        key = (rank, right)
        if key not in self.edges:
            part, until, path = self.tokens[rank], NEVER, []
            while True:
                path.append((part, until))
                if len(part) == 1:
                    break
                until = self.ranks[part]
                part = self.split(part)[right]
            self.edges[key] = path[::-1]
        return self.edges[key]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank_of = self.ranks.get
        if rank_of(self.tokens[left] + self.tokens[right]) is not None:
            return False
        ours = self.edges.get((left, True)) or self._edge(left, True)
        theirs = self.edges.get((right, False)) or self._edge(right, False)
        i = j = 0
        a, a_until = ours[0]
        b, b_until = theirs[0]
        while a_until != NEVER or b_until != NEVER:
            merge = rank_of(a + b)
            # Of equal merges the leftmost comes first.
            if merge is not None and merge < a_until and merge <= b_until:
                return False
            if a_until <= b_until:
                i += 1
                a, a_until = ours[i]
            else:
                j += 1
                b, b_until = theirs[j]
        return True


class PrefixTable:
    """A byte string with the last token of the encoding of each of its prefixes.

    That token is unique: the one that ends there, fits the last token of the
    prefix before it, and so on. Appending extends the table; replacing bytes
    recomputes entries until as many as a token can be long agree with the old
    ones again, from where the rest of the old table holds.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = [-1]
        self.append(data)

    def _entry(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        made, memo = v.made.get, v.memo.get
        for start in range(max(0, end - v.longest), end):
            rank = made(data[start:end])
            if rank is None:
                continue
            if not start:
                return rank
            fits = memo(last[start] << 32 | rank)
            if fits or (fits is None and v.compatible(last[start], rank)):
                return rank
        raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> None:
        first = len(self.data) + 1
        self.data = self.data + data if self.data else data
        if first == 1:
            self._fill()
            return
        for end in range(first, len(self.data) + 1):
            self.last.append(self._entry(end))

    def _fill(self) -> None:
        """All entries, from one pass that finds the tokens that end at each byte, longest first."""
        v, last = self.vocabulary, self.last
        memo, add, done = v.memo.get, last.append, -1
        for end, (rank, back) in v.finder.iter(self.data.decode("latin-1")):
            if end == done:
                continue
            if back != end:
                before = last[end - back]
                fits = memo(before << 32 | rank)
                if not (v.compatible(before, rank) if fits is None else fits):
                    continue
            add(rank)
            done = end
        if done != len(self.data) - 1 or len(last) != len(self.data) + 1:
            raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start to stop; the number of entries recomputed."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        agreed, end = 0, start
        while end < len(self.data):
            end += 1
            self.last.append(self._entry(end))
            same = end - shift > stop and old[end - shift] == self.last[end]
            agreed = agreed + 1 if same else 0
            if agreed >= self.vocabulary.longest:
                break
        self.last += old[end - shift + 1 :] if end < len(self.data) else []
        return end - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        last, sizes = self.last, self.vocabulary.sizes
        while end:
            rank = last[end]
            out.append(rank)
            end -= sizes[rank]
        out.reverse()
        return out


class _Memo(dict):
    """A bounded memo of a function from text to packed ids. A full memo is put aside, and what is asked for again returns."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make
        self.aside: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.aside.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO:
            self.aside = dict(self)
            self.clear()
        self[key] = value
        return value


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Texts to ids and back: each match of ``pattern`` is encoded on its own.

    Words repeat, so packed ids of matches are memoised, and many texts are
    encoded at once: what stands between two spaces is looked up once for all
    of them. Cutting at a space is exact where no white space follows it:
    ``pattern`` gives such a space to the next match, and what comes before it
    ends there.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.pieces = _Memo(self._piece)
        self.space_run = re.compile(r" \s")
        tokens = vocabulary.tokens
        self.table = pa.array([tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)], pa.large_binary())

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return pack([whole] if whole is not None else PrefixTable(self.vocabulary, data).ids())

    def _tail(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.pieces[" " + chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.pieces[" " + chunk[:-1]] + self.pieces[chunk[-1]]
        return self._matches(" " + chunk)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if self.space_run.search(text):
            return self._matches(text)
        head, *tails = text.split(" ")
        return self._matches(head) + b"".join(map(self._tail, tails))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text. A null is an empty text."""
        column = texts.cast(pa.large_string()).fill_null("")
        runs = pc.match_substring_regex(column, r" [\s\v\x1c-\x1f\x{85}\p{Z}]")
        whole = {i: self._matches(column[i].as_py()) for i in np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist()}
        split = pc.split_pattern(pc.if_else(runs, "", column), " ")
        firsts = split.offsets.to_numpy()
        chunks = split.flatten().dictionary_encode()
        # The first chunk of a text has no space before it.
        heads = split.flatten().take(pa.array(firsts[:-1])).to_pylist()
        tails = chunks.indices.to_numpy().copy()
        packed = [b""] * len(chunks.dictionary)
        known = np.ones(len(tails), bool)
        known[firsts[:-1]] = False
        wanted = np.flatnonzero(np.bincount(tails[known], minlength=len(packed)))
        for i, chunk in zip(wanted.tolist(), chunks.dictionary.take(pa.array(wanted)).to_pylist(), strict=True):
            packed[i] = self._tail(chunk)
        tails[firsts[:-1]] = len(packed) + np.arange(len(heads))
        ids = pa.array(packed + [self._matches(head) for head in heads], pa.large_binary()).take(pa.array(tails))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[firsts].tolist()
        flat = memoryview(ids.buffers()[2] or b"")
        return [whole.get(i) or bytes(flat[a:b]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]

    def extend(self, text: str, ids: bytes, more: str) -> bytes:
        """Packed ids of ``text + more`` from those of ``text``: only its last match is encoded anew."""
        start = 0
        for match in self.pattern.finditer(text):
            start = match.start()
        kept = len(ids) - len(self._matches(text[start:]))
        return ids[:kept] + self._matches(text[start:] + more)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return bytes(self.table.take(pa.array(np.frombuffer(ids, "<u4"))).buffers()[2] or b"")


def _coder(path: str, pattern: str) -> Encoder:
    return once(("bpe", path, pattern), lambda: Encoder(Vocabulary.read(path), pattern))


def encoded(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) per row of ``documents``.

    ``ids`` are packed as little-endian unsigned 32-bit integers;
    ``decoded_sha256`` is of the bytes got by decoding them. No special tokens.
    A null or empty text has no ids. Repeated rows and rows without a doc_id
    are encoded like any other; other columns are ignored. ``path`` names the
    rank file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for part in slices(batches):
            ids = coder.encode_all(part.column(1))
            hashes = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(hashes, pa.string()),
                    pa.array(decoded, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"
    rows = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return rows.mapInArrow(run, schema)
