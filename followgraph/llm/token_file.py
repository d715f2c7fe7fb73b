"""Token ids on disk: segments of a concatenated id array with coded boundaries."""

from __future__ import annotations

import os
import string
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from followgraph.llm import elias_fano
from followgraph.llm.scratch import shuffles_dropped
from followgraph.llm.worker import once, slices, text_buffer

MAGIC = b"FGTOKEN1"
HEAD = "<8sQQQqB7x"
END_ID = 2
SEGMENT_IDS = 1 << 20
MEMO = 1_000_000
# Text that is encoded at a time: words that come again in it are looked up once.
ENCODED_BYTES = 8 << 20
MARKS = string.punctuation
SEGMENTS = "part int, segment int, n_docs bigint, n_ids bigint, before bigint, payload binary"


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], wide: bool) -> bytes:
    """One segment: header, doc_ids and document ends as Elias-Fano, then all ids.

    ``doc_ids`` ascend, nulls first. Ids take two bytes each, or four if ``wide``.
    """
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    total = int(ends[-1]) if len(ends) else 0
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(doc_ids) - len(known), total, base, 4 if wide else 2)
    flat = np.concatenate(ids).astype("<u4" if wide else "<u2") if ids else np.empty(0, "<u2")
    names = elias_fano.encode(known.astype(np.uint64) - np.uint64(base & (2**64 - 1)))
    return head + names + elias_fano.encode(ends) + flat.tobytes()


class Segment:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_null, self.n_ids, self.base, width = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.names = elias_fano.EliasFano(data, struct.calcsize(HEAD))
        self.ends = elias_fano.EliasFano(data, self.names.end)
        self.ids = np.frombuffer(data, "<u4" if width == 4 else "<u2", self.n_ids, self.ends.end)

    def doc_ids(self) -> list[int | None]:
        names = self.names.selects(np.arange(self.names.n)) + np.uint64(self.base & (2**64 - 1))
        return [None] * self.n_null + names.view(np.int64).tolist()

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """First id and end of every document of this segment, by select."""
        ends = self.ends.selects(np.arange(self.n_docs)).view(np.int64)
        return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends

    def document(self, i: int) -> np.ndarray:
        """Ids of document number i of this segment: two selects and a slice."""
        start = self.ends.select(i - 1) if i else 0
        return self.ids[start : self.ends.select(i)]


class _Tokenizer:
    """A tokenizer of the tokenizers library, with a bounded memo of words.

    Its model drops white space and never looks across it, so what stands
    between spaces and line ends is encoded alone; so are a word and the ASCII
    marks that end it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.wide = self.model.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.code = "I" if self.wide else "H"
        self.words: dict[str, bytes] = {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(words, add_special_tokens=False)
        return [array(self.code, f.ids).tobytes() for f in found]

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.words)
        # A lower-case ASCII word passes the library's other steps unchanged.
        simple = [w for w in new if w.isascii() and w.isalpha() and w.islower()]
        tokens = self.model.model.tokenize
        for word in simple:
            self.words[word] = array(self.code, [t.id for t in tokens(word)]).tobytes()
        rest = list(new.difference(simple))
        self.words.update(zip(rest, self._encoded(rest), strict=True))

    def _packed(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks that all differ."""
        if len(self.words) > MEMO:
            self.words.clear()
        words = [c.rstrip(MARKS) for c in chunks]
        marks = [c[len(w) :] for c, w in zip(chunks, words, strict=True)]
        odd = []
        for i, word in enumerate(words):
            if word.isascii():
                if word.isalpha():
                    words[i] = word.lower()
                elif word:
                    odd.append(i)
            elif not unicodedata.normalize("NFC", word).lower().isalpha():
                odd.append(i)
        # Numbers, addresses and the like seldom come again.
        apart = self._encoded([chunks[i] for i in odd])
        for i in odd:
            words[i] = marks[i] = ""
        self._learn({*words, *marks})
        known = self.words
        out = [known[w] + known[m] for w, m in zip(words, marks, strict=True)]
        for i, ids in zip(odd, apart, strict=True):
            out[i] = ids
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Packed ids of every text. A chunk that stands often in these texts is looked up once."""
        data, offsets = text_buffer(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        spaced = np.where(data == ord("\n"), np.uint8(ord(" ")), data)
        column = pa.LargeStringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(spaced)
        )
        split = pc.split_pattern(column, " ")
        chunks = split.flatten().dictionary_encode()
        packed = self._packed(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(packed, pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        flat = memoryview(ids.buffers()[2] or b"")
        return [bytes(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def write_tokens(
    documents: DataFrame,
    place: str,
    tokenizer: str,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to the folder ``place``.

    Documents are in ascending order of doc_id: first without one, then by
    doc_id, equal ones by text. The folder is a Parquet table with one row per
    segment (part, segment, n_docs, n_ids, before, payload); ``before`` counts
    the ids of the part's earlier segments, payloads are the format
    of ``pack_segment``, of about ``segment_ids`` ids, so no task holds more
    than that and one document. Spark's commit protocol makes the write safe
    against lost executors and works on any file system.

    A null or empty text has the end id alone. Repeated rows are all written.
    An empty table gives no segment. Other columns are ignored.
    """
    rows = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "coalesce(text, '') AS text")
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(("tokenizer", tokenizer), lambda: _Tokenizer(tokenizer))
        end = np.array([end_id], coder.kind)
        part, number, size, before = TaskContext.get().partitionId(), 0, 0, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            payload = pack_segment(names, ids, coder.wide)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([len(names)], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([payload], pa.binary()),
                ],
                ["part", "segment", "n_docs", "n_ids", "before", "payload"],
            )

        for piece in slices(batches, size=ENCODED_BYTES):
            found = coder.encode(piece.column(1))
            for name, packed in zip(piece.column(0).to_pylist(), found, strict=True):
                own = np.concatenate([np.frombuffer(packed, coder.kind), end])
                if names and size + len(own) > segment_ids:
                    yield row()
                    names, ids, number, before, size = [], [], number + 1, before + size, 0
                names.append(name)
                ids.append(own)
                size += len(own)
        if names:
            yield row()

    with shuffles_dropped(documents.sparkSession):
        in_order.mapInArrow(run, SEGMENTS).write.parquet(place)


def read_tokens(spark: SparkSession, place: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the folder ``place``.

    ``start`` counts the ids of all documents before it; ``ids`` are packed as
    little-endian unsigned 32-bit integers, and the checksum is theirs.
    """
    files = spark.read.schema(SEGMENTS).parquet(place)
    # One row for each task that wrote, so the running sum over them is small, and may be broadcast.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = F.sum("ids").over(Window.orderBy("part")) - F.col("ids")
    bases = parts.select("part", earlier.alias("base"))
    placed = files.join(F.broadcast(bases), "part").selectExpr("base + before AS base", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(payload.as_py())
                starts, ends = segment.bounds()
                packed = [segment.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.doc_ids(), pa.int64()),
                        pa.array(starts + base),
                        pa.array(ends - starts),
                        pa.array([zlib.crc32(x) for x in packed], pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    return placed.mapInArrow(run, schema)
