"""A cuckoo filter over 64-bit hashes, worked on whole arrays of them at a time."""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8  # of all slots, when a filter is made
FULL = 0.95  # of all slots: more do not fit
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # an odd number that spreads fingerprints over buckets


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots; each has two buckets it may stand in.

    ``has`` is never wrong about what is in it, and right about nearly all that is not. Only
    what was added may be removed, and nothing may be added twice: the exact table that a
    filter goes with sees to both.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter that holds ``hashes``, with room for some more."""
        buckets = 1
        while buckets * SLOTS * LOAD < len(hashes) + 1:
            buckets *= 2
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.add(hashes):
                return made
            buckets *= 2

    @classmethod
    def read(cls, value: bytes) -> CuckooFilter:
        return cls(np.frombuffer(value, "<u2").reshape(-1, SLOTS).astype(np.uint16))

    def write(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _mark(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, and the first bucket of each."""
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1  # 0 is a free slot
        return mark, (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = (mark.astype(np.uint64) * SPREAD) >> np.uint64(32)
        return bucket ^ (step & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, bucket = self._mark(hashes)
        found = (self.table[bucket] == mark[:, None]).any(axis=1)
        return found | (self.table[self._other(bucket, mark)] == mark[:, None]).any(axis=1)

    def add(self, hashes: np.ndarray, most_kicks: int = 500) -> bool:
        """False if there is no room: the filter is then void and a larger one is due."""
        if np.count_nonzero(self.table) + len(hashes) > FULL * self.table.size:
            return False
        mark, bucket = self._mark(hashes)
        for kick in range(most_kicks):
            if not len(mark):
                return True
            order = np.argsort(bucket, kind="stable")
            bucket, mark = bucket[order], mark[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)  # among those for one bucket
            free = self.table[bucket] == 0
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[bucket[fits], slot] = mark[fits]
            bucket, mark, rank = bucket[~fits], mark[~fits], rank[~fits]
            if kick:  # one of each bucket takes a place, and what stood there moves on
                leads = np.searchsorted(bucket, bucket) == np.arange(len(bucket))
                at = bucket[leads], (kick + bucket[leads]) % SLOTS
                moved = self.table[at]
                self.table[at] = mark[leads]
                mark[leads] = moved
            bucket = self._other(bucket, mark)
        return not len(mark)

    def remove(self, hashes: np.ndarray) -> None:
        mark, bucket = self._mark(hashes)
        for _ in range(2):
            key = bucket << 16 | mark
            order = np.argsort(key, kind="stable")
            bucket, mark, key = bucket[order], mark[order], key[order]
            rank = np.arange(len(key)) - np.searchsorted(key, key)  # among equal ones
            same = self.table[bucket] == mark[:, None]
            here = rank < same.sum(axis=1)
            slot = np.argsort(~same[here], axis=1, kind="stable")[np.arange(here.sum()), rank[here]]
            self.table[bucket[here], slot] = 0
            bucket, mark = bucket[~here], mark[~here]
            bucket = self._other(bucket, mark)
        if len(mark):
            raise ValueError("only what was added can be removed")
