"""Helpers for code that runs in Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

# Text that one step holds at a time; a longer text is a step of its own.
SLICE_BYTES = 2 << 20


# Values that a worker process keeps: as many as one task needs. Those of an earlier stage go.
KEPT = 2


def once(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, kept by the worker process until KEPT others have been asked for since."""
    kept = sys.modules.setdefault("_followgraph_worker", types.ModuleType("_followgraph_worker"))
    values = kept.__dict__.setdefault("values", {})
    value = values.pop(key) if key in values else make()
    values[key] = value
    while len(values) > KEPT:
        del values[next(iter(values))]
    return value


def release() -> None:
    """Give memory that is free in this process back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets. A null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text. Free memory is given back at the end."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_buffer(column)
        start, n = 0, batch.num_rows
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), n)
            yield batch.slice(start, stop - start)
            start = stop
    release()
