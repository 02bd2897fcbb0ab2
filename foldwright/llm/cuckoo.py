"""A cuckoo filter over 64-bit hashes: membership with few false positives, insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Full(Exception):
    """No free slot was found; the owner rebuilds a larger filter from its exact table."""


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lives in one of two buckets, each derived from the other."""

    def __init__(self, table: np.ndarray):
        self.table = table  # uint16 [buckets, SLOTS], 0 is free; the number of buckets is a power of two

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (0.8 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        size = len(hashes)
        while True:
            made = cls.sized(size)
            try:
                for h in hashes.tolist():
                    made.insert(h)
                return made
            except Full:
                size *= 2

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(hashes, np.int64).view(np.uint64)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.table) - 1)
        first = h & mask
        return mark, first, first ^ self._jump(mark)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * _MIX) >> np.uint64(20)) & np.uint64(len(self.table) - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hashes)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, key: int) -> None:
        mark, a, b = (x[0] for x in self._places(np.array([key], np.int64)))
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        at = b
        for kick in range(KICKS):  # move a resident to its other bucket
            slot = (int(mark) + kick) % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = at ^ self._jump(np.array([mark]))[0]
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        raise Full

    def delete(self, key: int) -> bool:
        mark, a, b = (x[0] for x in self._places(np.array([key], np.int64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())
