"""Non-decreasing whole numbers in Elias-Fano form, with select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = "<QQBxxxxxxxQQ"
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
# The place of the first, second, ... set bit of every byte.
NTH = np.array([([j for j in range(8) if b >> j & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


def encode(values: np.ndarray) -> bytes:
    """Values, each at least the one before, in n * (2 + log2(largest / n)) bits and a bit more.

    The low bits of all values lie side by side; the high bits are unary gaps.
    The place of every 256th value among the unary bits is kept for select.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(high[-1]) + 1 if n else 0, bool)
    unary[high] = True
    shifts = np.arange(width, dtype=np.uint64)
    low = ((values[:, None] >> shifts) & np.uint64(1)).astype(bool)
    lows = np.packbits(low.ravel(), bitorder="little").tobytes()
    highs = np.packbits(unary, bitorder="little").tobytes()
    samples = high[::SAMPLE].astype("<u8").tobytes()
    return struct.pack(HEAD, n, top, width, len(lows), len(highs)) + lows + highs + samples


class EliasFano:
    """Reader of ``encode``'s bytes; ``size`` is how many of them it takes."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.top, self.width, lows, highs = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.highs = np.frombuffer(data, np.uint8, highs, at + lows)
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u8", samples, at + lows + highs)
        self.end = at + lows + highs + 8 * samples

    def select(self, i: int) -> int:
        """Value number i, from 0, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if left:
            byte, skip = (place + 1) >> 3, (place + 1) & 7
            word = int(self.highs[byte]) >> skip << skip
            while ONES[word] < left:
                left -= int(ONES[word])
                byte += 1
                word = int(self.highs[byte])
            for _ in range(left - 1):
                word &= word - 1
            place = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for j in range(self.width):
            bit = i * self.width + j
            low |= (int(self.lows[bit >> 3]) >> (bit & 7) & 1) << j
        return (place - i) << self.width | low

    def selects(self, ranks: np.ndarray) -> np.ndarray:
        """Values of all these numbers, each found by select; nothing else is decoded.

        A rank's byte among the unary bits is looked up from their running
        counts, its bit in the byte in a table.
        """
        ranks = np.asarray(ranks, np.int64)
        counts = ONES[self.highs]
        reach = np.cumsum(counts, dtype=np.int64)
        byte = np.searchsorted(reach, ranks, "right")
        inside = ranks - reach[byte] + counts[byte]
        place = (byte << 3) + NTH[self.highs[byte], inside]
        out = (place - ranks).astype(np.uint64) << np.uint64(self.width)
        for j in range(self.width):
            bit = ranks * self.width + j
            out |= (self.lows[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1)).astype(np.uint64) << np.uint64(j)
        return out

    def all(self) -> np.ndarray:
        """All values."""
        unary = np.unpackbits(self.highs, bitorder="little")
        high = (np.flatnonzero(unary) - np.arange(self.n)).astype(np.uint64)
        out = high << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.lows, bitorder="little", count=self.n * self.width)
            for j, column in enumerate(bits.reshape(self.n, self.width).T):
                out |= column.astype(np.uint64) << np.uint64(j)
        return out
