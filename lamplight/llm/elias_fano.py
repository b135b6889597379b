"""Elias-Fano coding of a non-decreasing sequence, with a select structure over packed bits.

Each of n values up to u is cut into low bits, kept as they are, and high bits, kept as a bit set in which the i-th 1
stands at position high(i) + i: about 2 + log2(u / n) bits a value. Select finds the i-th 1 from the number of ones before
each SPAN bytes of the bit set, 32 bits each, then byte by byte: no bit set is unpacked and no table of 64-bit offsets made.
"""

from __future__ import annotations

import struct

import numpy as np

SPAN = 64
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)
#: The place of the k-th 1 of each byte.
_PLACE = np.array([[*(i for i in range(8) if b >> i & 1), *[0] * (8 - bin(b).count("1"))] for b in range(256)], dtype=np.uint8)


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._high = np.frombuffer(high + bytes(-len(high) % SPAN), np.uint8)
        counts = _ONES[self._high].reshape(-1, SPAN).sum(axis=1, dtype=np.uint32)
        self._before = np.cumsum(counts, dtype=np.uint32) - counts  # of a block of under 2^32 values

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        v = values.astype(np.uint64)
        top = int(v[-1]) if n else 0
        b = max(0, (top // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(b, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        high = np.zeros((top >> b) + n + 1, dtype=np.uint8)
        high[(v >> np.uint64(b)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, b, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The values of the given numbers."""
        span = np.searchsorted(self._before, at, side="right") - 1
        left = at - self._before[span].astype(np.int64)
        byte = span * SPAN
        ahead = np.ones(len(at), dtype=bool)
        for _ in range(SPAN - 1):
            ones = _ONES[self._high[byte]]
            ahead &= left >= ones
            if not ahead.any():
                break
            left -= np.where(ahead, ones, 0)
            byte += ahead
        return (byte * 8 + _PLACE[self._high[byte], left] - at << self.low_bits) | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.int64)
        raw = np.frombuffer(self.low, np.uint8)
        pos = at[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((raw[pos >> 3] >> (pos & 7) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def values(self) -> np.ndarray:
        return self.select_many(np.arange(self.n))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, b, low, high = struct.unpack_from("<QBQQ", data)
        return cls(n, b, data[25 : 25 + low], data[25 + low : 25 + low + high])
