"""Cuckoo filters over 64-bit keys in numpy: 4 slots a bucket, 16-bit fingerprints, look-ups for whole arrays."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MUL
    return x ^ (x >> np.uint64(29))


def places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and the two buckets of each key; buckets is a power of two, each bucket follows from the other."""
    mixed = _mix(keys.astype(np.uint64))
    prints = ((mixed >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    mask = np.uint64(buckets - 1)
    first = mixed & mask
    other = first ^ (_mix(prints.astype(np.uint64)) & mask)
    return prints, first.astype(np.int64), other.astype(np.int64)


class CuckooFilter:
    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds these distinct keys, at most 80 % full; larger where an insertion fails."""
        buckets = 1 << max(2, int(np.ceil(len(keys) / (SLOTS * 0.8))) - 1).bit_length()
        while True:
            made = cls(buckets)
            if made.insert(keys):
                return made
            buckets *= 2

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it must then be made anew from the exact table."""
        rng = np.random.default_rng(1)
        for fp, a, b in zip(*places(keys, self.buckets), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = fp
                    break
            else:
                at = (a, b)[rng.integers(2)]
                for _ in range(KICKS):
                    slot = rng.integers(SLOTS)
                    fp, self.table[at, slot] = self.table[at, slot], fp
                    at = int(at ^ int(_mix(np.array([fp], np.uint64))[0] & np.uint64(self.buckets - 1)))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for fp, a, b in zip(*places(keys, self.buckets), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == fp)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether the filter may hold it; never false for a key it holds."""
        prints, first, other = places(keys, self.buckets)
        return ((self.table[first] == prints[:, None]) | (self.table[other] == prints[:, None])).any(axis=1)
