"""A minimal perfect hash over 32-byte digests, in numpy.

Cascaded bit sets: at each level a key owns a bit if no other key of that level falls on it; the others go on to
the next. A key's slot is the rank of its bit over all levels, so n keys get exactly the slots 0..n-1, at about
three bits a key. Keys that were not built in may get any slot or none: the caller compares the stored digest.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 96


def words(digests: list[bytes]) -> np.ndarray:
    """n digests of 32 bytes as an (n, 4) array of unsigned 64-bit words."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    def __init__(self, n: int, bits: list[np.ndarray]):
        self.n, self.bits, self.ranks, base = n, bits, [], 0
        for b in bits:
            self.ranks.append(base + np.cumsum(b, dtype=np.int64) - b)
            base += int(b.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys must be distinct."""
        left, bits = keys, []
        while len(left):
            if len(bits) == MAX_LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(64, int(GAMMA * len(left)))
            at = _place(left, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(len(keys), bits)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that were not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(todo):
                break
            at = _place(keys[todo], level, len(bits))
            hit = bits[at] == 1
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<QI{len(self.bits)}Q", self.n, len(self.bits), *map(len, self.bits))
        return head + b"".join(np.packbits(b, bitorder="little").tobytes() for b in self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n, levels = struct.unpack_from("<QI", data)
        sizes = struct.unpack_from(f"<{levels}Q", data, 12)
        at, bits = 12 + 8 * levels, []
        for size in sizes:
            m = -(-size // 8)
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, m, at), count=size, bitorder="little"))
            at += m
        return cls(n, bits)
