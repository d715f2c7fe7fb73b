"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and the control characters 9 to 13;
A-Z count as a-z. No Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from followgraph.llm.worker import once

SHINGLE_WORDS = 5
BLOCK_BYTES = 1 << 18
SPACES = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are spaces; a number per byte; powers of a factor and of its inverse."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    byte[65:91] = byte[97:123]
    factor = 0xD6E8FEB86659FD93
    inverse = pow(factor, -1, 1 << 64)
    steps = np.ones(BLOCK_BYTES, np.uint64)
    back = np.ones(BLOCK_BYTES, np.uint64)
    steps[1:], back[1:] = factor, inverse
    return space, byte, np.cumprod(steps), np.cumprod(back)


def _powers(table: np.ndarray, n: int) -> np.ndarray:
    """The table, longer where one word needs it."""
    if n <= len(table):
        return table
    steps = np.full(n, table[1], np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


@dataclass
class Words:
    """Words of consecutive texts: byte starts and ends, hashes, first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts that ``offsets`` cuts out of ``data``."""
    space, byte, power, back = once("shingles.tables", _tables)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    solid = ~space[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cut] |= solid[cut]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[cut - 1] |= solid[cut - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right"))
        stop = max(stop, at + 1)
        low, high = int(starts[at]), int(ends[stop - 1])
        span = high - low
        sums = np.empty(span + 1, np.uint64)
        sums[0] = 0
        np.cumsum(byte[data[low:high]] * _powers(power, span)[:span], out=sums[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        hashes[at:stop] = (sums[b] - sums[a]) * _powers(back, span)[a]
        at = stop
    lengths = (ends - starts).astype(np.uint64)
    return Words(starts, ends, mix(hashes + lengths), np.searchsorted(starts, offsets))


def shingles(found: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, in order, and the n + 1 bounds of each text's own.

    A text with fewer than ``size`` words has one shingle, its whole sequence;
    one without words has none.
    """
    w, first, n = found.hashes, found.first, found.counts()
    factors = [np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64)) for j in range(size)]
    own = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(own, out=bounds[1:])
    if not bounds[-1]:
        return np.empty(0, np.uint64), bounds
    padded = np.concatenate([w, np.zeros(size, np.uint64)])
    sums = np.zeros(len(w), np.uint64)
    for j, f in enumerate(factors):
        sums += padded[j : j + len(w)] * f
    keep = np.ones(len(w), bool)
    for j in range(1, size):
        late = first[1:][n >= size] - j
        keep[late] = False
    for t in np.flatnonzero((n > 0) & (n < size)):
        a, b = int(first[t]), int(first[t + 1])
        keep[a + 1 : b] = False
        sums[a] = (w[a:b] * np.array(factors[: b - a])).sum() + np.uint64(b - a)
    return mix(sums[keep]), bounds
