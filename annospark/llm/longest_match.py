"""Counting word pieces with a linear longest-match automaton, inside tasks."""

from __future__ import annotations

from collections import deque

START = "▁"  # stands before every word, as in the vocabulary


class PieceCounter:
    """How many pieces greedy longest-match splitting gives a word, in one pass over its letters.

    The vocabulary is a trie. Each node has a failure link to the node that stands for what is left once the
    longest pieces of its prefix are split off, and the precomputed number of those pieces; following a link
    adds that number and no piece is ever built. A letter of the vocabulary that is no piece by itself, and any
    letter outside it, counts as many pieces as it has UTF-8 bytes, so every word can be split.
    """

    CACHED = 300_000  # words remembered by one task

    def __init__(self, pieces):
        pieces = {p for p in pieces if p}
        costs = {p: 1 for p in pieces}
        for letter in {c for p in pieces for c in p}:
            costs.setdefault(letter, len(letter.encode()))
        self.next: list[dict[str, int]] = [{}]
        cost = [0]
        for piece, c in costs.items():
            at = 0
            for letter in piece:
                to = self.next[at].get(letter)
                if to is None:
                    to = self.next[at][letter] = len(self.next)
                    self.next.append({})
                    cost.append(0)
                at = to
            cost[at] = c
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = deque((0, letter, to) for letter, to in self.next[0].items())
        while queue:
            parent, letter, node = queue.popleft()
            if cost[node]:
                self.link[node], self.popped[node] = 0, cost[node]
            else:  # every letter is a piece, so a link always leads on
                at, popped = self.link[parent], self.popped[parent]
                while letter not in self.next[at]:
                    popped += self.popped[at]
                    at = self.link[at]
                self.link[node], self.popped[node] = self.next[at][letter], popped
            queue.extend((node, c, to) for c, to in self.next[node].items())
        self.known: dict[str, int] = {}

    def pieces_in(self, word: str) -> int:
        """The number of pieces of one word, its start mark included."""
        at = n = 0
        for letter in START + word:
            to = self.next[at].get(letter)
            while to is None:
                if not at:
                    break
                n += self.popped[at]
                at = self.link[at]
                to = self.next[at].get(letter)
            if to is None:
                n += len(letter.encode())
            else:
                at = to
        while at:
            n += self.popped[at]
            at = self.link[at]
        return n

    def pieces_of(self, words: list[str]) -> int:
        """The number of pieces of all words together."""
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= self.CACHED:
                    known.clear()
                n = self.pieces_in(w)
                if len(w) <= 64:
                    known[w] = n
            total += n
        return total
