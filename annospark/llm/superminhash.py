"""Word shingles as 64-bit hashes, and their SuperMinHash signatures, for one batch of texts inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
RANK_BITS = np.uint64(48)
UNSET = np.uint64(2**64 - 1)
ELEMENTS = 200_000  # shingles worked on at once


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word. The words met first are remembered while the task works, which the frequent ones are among."""

    LIMIT = 100_000

    def __missing__(self, word: bytes | str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


def shingles(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. A text with fewer words than a shingle is
    one shingle as a whole; a text without words has none.
    """
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    size = min(n, words)
    acc = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        acc = mixed((acc + STEP) ^ each[k : n - size + 1 + k])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` values for each set of hashes (no set may be empty).

    Every element walks through its own random order of the slots; at step j it offers the slot it comes to
    the value (j, random number), and each slot keeps the smallest value. Ranks of one element exclude each
    other, which makes estimates vary less than with independent hashes. A set is finished once all of its
    slots hold values of steps that are over: later ones are larger. Long sets finish after a step or two.
    """
    out = np.full((len(sets), slots), UNSET, np.uint64)
    if not sets:
        return out
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    flat, order = out.reshape(-1), None
    for j in range(slots):
        draw = mixed(elements + np.uint64((j + 1) * int(STEP) & (2**64 - 1)))
        at = ((draw & np.uint64(0xFFFF)) % np.uint64(slots - j)).astype(np.int64) + j
        if order is not None:  # one step of the shuffle of each element's order
            rows = np.arange(len(elements))
            slot = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, j]
        else:
            slot = at
        np.minimum.at(flat, owner * slots + slot, (np.uint64(j) << RANK_BITS) | (draw >> np.uint64(16)))
        waiting = (out >> RANK_BITS > np.uint64(j)).any(axis=1)
        if not waiting.any():
            break
        stays = waiting[owner]
        if order is None:  # the orders are written out for short sets only
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(stays.sum()), 1))
            slot = slot[stays]
            order[np.arange(len(slot)), slot] = 0
        else:
            order = order[stays]
        elements, owner = elements[stays], owner[stays]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each group of ``rows`` slots, different for each group's place."""
    parts = signature.reshape(len(signature), -1, rows)
    acc = np.tile(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * STEP, (len(signature), 1))
    for k in range(rows):
        acc = mixed((acc + STEP) ^ parts[:, :, k])
    return acc.view(np.int64)


def chunks(sets: list[np.ndarray]):
    """Index ranges of consecutive sets with about ``ELEMENTS`` elements together."""
    start = held = 0
    for i, s in enumerate(sets):
        if held and held + len(s) > ELEMENTS:
            yield start, i
            start, held = i, 0
        held += len(s)
    if start < len(sets):
        yield start, len(sets)
