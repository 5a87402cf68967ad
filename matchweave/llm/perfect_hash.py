"""A minimal perfect hash of byte strings: buckets with displacements, looked up for whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that displacements give different values
_MIX = np.uint64(0xD6E8FEB86659FD93)


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + displacement.astype(np.uint64) * _STEP
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Each of n distinct keys has its own slot in 0..n-1; a string that is no key gets any slot.

    Buckets of about four keys are placed from the largest on, each with the first displacement
    that sends its keys to free slots; a bucket of one key names its slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = max(1, len(keys) // 4)
        self.displacement = np.zeros(self.buckets, np.int64)
        h = hashes(keys)
        if len(np.unique(h)) < len(keys):
            raise ValueError("repeated keys, or two keys with one hash")
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(self.n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            members, start = h[order[ends[b] - sizes[b]:ends[b]]], 0
            while True:
                tries = np.arange(start, start + 64)
                slots = np.sort(_slots(members[None, :], tries[:, None], self.n), axis=1)
                fits = np.flatnonzero(free[slots].all(1) & (np.diff(slots, axis=1) > 0).all(1))
                if len(fits):
                    self.displacement[b] = tries[fits[0]]
                    free[slots[fits[0]]] = False
                    break
                start += 64
        alone = by_size[sizes[by_size] == 1]
        self.displacement[alone] = -1 - np.flatnonzero(free)[:len(alone)]

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slots of the strings with these hashes."""
        d = self.displacement[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), self.n))
