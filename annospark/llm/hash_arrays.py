"""Sorted arrays of 64-bit hashes with aligned numbers, one file per shard and column, mapped into memory by tasks."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable
from urllib.parse import urlparse

import numpy as np
from pyspark import TaskContext
from pyspark.sql import SparkSession

from annospark.session import shared_dir


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a path that every machine can open."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"arrays are mapped into memory: spark.checkpoint.dir must be a mounted folder, not {url.scheme}:")
    path = f"{url.path}/annospark-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def write_array(path: str, values: np.ndarray) -> None:
    """Write one file. An attempt that runs twice leaves one whole file: each writes its own and renames it."""
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.npy"
    np.save(own, values)
    os.replace(own, f"{path}.npy")


def shard_cuts(ordered: np.ndarray, n: int) -> np.ndarray:
    """Where the shards of sorted hashes begin, and the end. Shards are ``n`` equal ranges, so they keep the order."""
    first = np.array([-(-(p << 32) // n) << 32 for p in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(ordered, first), [len(ordered)]))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as bytes: bytes of like weight side by side, which compresses well."""
    out = [struct.pack("<IB", len(columns[0]), len(columns))]
    for c in columns:
        width = max(1, (int(c.max()) if len(c) else 0).bit_length() + 7 >> 3)
        out += [bytes([width]), np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<IB", data)
    at, out = 5, []
    for _ in range(k):
        width = data[at]
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(full.view("<u8").reshape(n))
        at += 1 + n * width
    return out


def summed(keys: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct ``keys``, the sums of their ``counts``, and one of the equal values of the others."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(keys) else counts
    return keys[first], total, *[o[order[first]] for o in others]


class Gathered:
    """Sums over blocks of ``(key, count, others...)`` that arrive one after the other; ``HELD`` bounds what waits."""

    HELD = 8_000_000

    def __init__(self, width: int):
        self.parts, self.waiting = [tuple(np.empty(0, np.uint64) for _ in range(width))], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.waiting += len(columns[0])
        if self.waiting > self.HELD:
            self.parts, self.waiting = [self.all()], 0

    def all(self) -> tuple[np.ndarray, ...]:
        return summed(*[np.concatenate(c) for c in zip(*self.parts)])


class HashArrays:
    """Hashes by rank. ``sizes`` holds the number of hashes of each shard; files are mapped when they are asked for."""

    OPEN = 512  # files that stay mapped

    def __init__(self, folder: str, name: str, sizes: Iterable[int]):
        self.folder, self.name = folder, name
        self.ends = np.cumsum(np.array(list(sizes), np.int64))
        self.starts = self.ends - np.array(list(sizes), np.int64)
        self.open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    @property
    def n(self) -> int:
        return int(self.ends[-1])

    def path(self, column: str, shard: int) -> str:
        return f"{self.folder}/{self.name}-{column}-{shard}"

    def mapped(self, column: str, shard: int) -> np.ndarray:
        path = f"{self.path(column, shard)}.npy"
        if path not in self.open:
            if len(self.open) >= self.OPEN:
                self.open.clear()
            self.open[path] = np.load(path, mmap_mode="r")
        return self.open[path]

    def shard_of_rank(self, ranks: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.ends, ranks, side="right"), len(self.ends) - 1)

    def find(self, ordered: np.ndarray) -> np.ndarray:
        """The ranks of sorted hashes, -1 for those that are not there. One shard is mapped at a time."""
        ranks = np.full(len(ordered), -1, np.int64)
        cuts = shard_cuts(ordered, len(self.ends))
        for p in np.flatnonzero((np.diff(cuts) > 0) & (self.ends > self.starts)):
            asked, there = ordered[cuts[p] : cuts[p + 1]], self.mapped("hash", p)
            at = np.searchsorted(there, asked)
            hit = there[np.minimum(at, len(there) - 1)] == asked
            ranks[cuts[p] : cuts[p + 1]] = np.where(hit, at + self.starts[p], -1)
        return ranks

    def values(self, columns: tuple[str, ...], ranks: np.ndarray) -> list[np.ndarray]:
        """Columns at ascending ranks, as whole numbers; 0 for rank -1."""
        out = [np.zeros(len(ranks), np.int64) for _ in columns]
        known = np.flatnonzero(ranks >= 0)
        shards = self.shard_of_rank(ranks[known])
        for p in np.unique(shards):
            here = known[shards == p]
            for c, into in zip(columns, out):
                into[here] = self.mapped(c, p)[ranks[here] - self.starts[p]]
        return out
