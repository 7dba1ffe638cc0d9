"""A cuckoo filter over 128-bit keys: set membership with deletion, kept as bytes."""

from __future__ import annotations

import numpy as np

SLOTS = 4  # fingerprints in a bucket
KICKS = 500
LOAD = 0.8  # how full a new filter may be


def split(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of 16-byte keys: one chooses the bucket, one gives the fingerprint."""
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return both[:, 0], (both[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket: np.ndarray, mark: np.ndarray, mask: int) -> np.ndarray:
    return bucket ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995) & np.uint64(mask)).astype(np.int64)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key sits in one of two buckets.

    A key that was added is always found; another key is found with a chance of about 1 in 8,000. Every key
    may be added once and must be in the filter when it is removed.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1.0, n / (SLOTS * LOAD))))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: list[bytes]):
        where, mark = split(keys)
        mask = len(self.table) - 1
        first = (where & np.uint64(mask)).astype(np.int64)
        return first, _other(first, mark, mask), mark

    def add(self, keys: list[bytes]) -> bool:
        """False when a key finds no place; the filter is then to be built anew, larger."""
        if not keys:
            return True
        mask, table = len(self.table) - 1, self.table
        turn = 0
        for i, j, mark in zip(*self._places(keys)):
            for at in (i, j):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = mark
                    break
            else:
                for _ in range(KICKS):
                    turn = (turn + 1) % SLOTS
                    mark, table[j, turn] = table[j, turn], mark
                    j = _other(np.array([j]), np.array([mark]), mask)[0]
                    free = np.flatnonzero(table[j] == 0)
                    if len(free):
                        table[j, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, keys: list[bytes]) -> None:
        if keys:
            for i, j, mark in zip(*self._places(keys)):
                for at in (i, j):
                    hit = np.flatnonzero(self.table[at] == mark)
                    if len(hit):
                        self.table[at, hit[0]] = 0
                        break

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        i, j, mark = self._places(keys)
        mark = mark[:, None]
        return (self.table[i] == mark).any(axis=1) | (self.table[j] == mark).any(axis=1)
