"""Question templates: texts whose numbers, names and units are replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

from annospark.llm.superminhash import STEP, mixed

# Unit words, in the languages of the built-in texts.
UNITS = frozenset(
    "mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years % percent degree degrees °c °f hz khz mhz w kw v kb mb gb tb usd eur dollar dollars euro euros cent cents $ € £ "
    "meter meters metre metres kilometer kilometers stunde stunden tag tage jahr jahre heure heures jour jours an ans hora horas día días año años".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"


LITERAL, NUMBER_LIKE, UNIT_LIKE, CAPITAL, CAPITAL_UNIT, NOTHING = range(6)


def mark_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Tokens(dict):
    """What a token may be: ``(word, its hash, class, ends a sentence, ends one or a heading)``.

    The tokens met first are remembered while a task works, which the frequent ones are among.
    """

    LIMIT = 300_000

    def __missing__(self, token: str) -> tuple[str, int, int, bool, bool]:
        bare = token[:-1] if token[-1] in ".,;:!?" else token
        if not bare or not (bare[0].isalnum() and bare[-1].isalnum()):  # most tokens need no closer look
            bare = EDGE.sub("", token)
        low = bare.lower()
        if not bare:
            kind = NOTHING
        elif (bare[0].isdigit() or bare[0] in "+-$€£") and NUMBER.match(bare):
            kind = NUMBER_LIKE
        elif low in UNITS:
            kind = CAPITAL_UNIT if bare[0].isupper() else UNIT_LIKE
        else:
            kind = CAPITAL if bare[0].isupper() else LITERAL
        found = (low, mark_of(low), kind, token[-1] in ".!?", token[-1] in ".!?:")
        if len(self) < self.LIMIT:
            self[token] = found
        return found


MARKS = {name: mark_of(name) for name in (NUM, NAME, UNIT)}


def template(text: str, known: Tokens) -> tuple[list[int], dict[int, str], list[int]]:
    """The hashes of a text's template words, by position what each placeholder stands for, with its type, and the
    hashes of those words themselves.

    Digits make a number, a unit word after a number a unit, and a capitalised word that does not begin a
    sentence a name. Everything else is the lower-cased word without punctuation at its ends.
    """
    marks: list[int] = []
    slots: dict[int, str] = {}
    words: list[int] = []
    push, number = marks.append, MARKS[NUM]
    for line in text.split("\n"):
        begins = True
        for low, mark, kind, stops, ends in map(known.__getitem__, line.split()):
            if kind:
                if kind == NOTHING:
                    begins = begins or stops
                    continue
                name = None
                if kind == NUMBER_LIKE:
                    name = NUM
                elif kind != CAPITAL and marks and marks[-1] == number:
                    name = UNIT
                elif kind != UNIT_LIKE and not begins:
                    name = NAME
                if name:
                    slots[len(marks)] = name + low
                    words.append(mark)
                    mark = MARKS[name]
            push(mark)
            begins = ends
    return marks, slots, words


EXACT = 1 << 32  # what sets the hashes of words apart from those of template words


def _rolled(each: np.ndarray, at: np.ndarray, size: int, start: int, first: np.ndarray | None = None) -> np.ndarray:
    acc = np.full(len(at), start, np.uint64)
    for k in range(size):
        acc = mixed((acc + STEP) ^ (first[at] if first is not None and k == 0 else each[at + k]))
    return acc.view(np.int64)


class TemplateWindows:
    """Hashes of the windows of a text's template words, in each of ``sizes``.

    A window with fewer than ``least`` words that are no placeholder is hashed by its words themselves. If it is
    the whole text, it has both hashes.
    """

    def __init__(self, sizes: list[int], least: int, inside: bool):
        """``inside``: a window that begins with a name or unit is also taken as the beginning of a sentence."""
        self.sizes, self.least, self.inside, self.tokens = sizes, least, inside, Tokens()

    def of(self, text: str, shorter: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
        """``(hashes, positions, size, words skipped by the slots, whether by words)`` of a text's windows.

        With ``shorter``, a text below the largest size is one window as a whole.
        """
        marks, self.values, words = template(text, self.tokens)
        n, places = len(marks), np.array(list(self.values), np.int64)
        each = np.array(marks, np.uint64)
        raw = each.copy()
        raw[places] = np.array(words, np.uint64)
        filled = np.zeros(n + 1, np.int64)
        filled[places + 1] = 1
        upto = filled.cumsum()
        for size in [min(n, max(self.sizes))] if shorter else self.sizes:
            if not 0 < size <= n:
                continue
            acc = np.full(n - size + 1, size, np.uint64)
            for k in range(size):
                acc = mixed((acc + STEP) ^ each[k : n - size + 1 + k])
            fixed = size - (upto[size:] - upto[: n - size + 1])
            enough = fixed >= self.least
            at = np.flatnonzero(enough | (n == size))
            yield acc.view(np.int64)[at], at, size, 0, False
            at = np.flatnonzero(~enough)
            if len(at):
                yield _rolled(raw, at, size, size + EXACT), at, size, size, True
            if self.inside and len(places):
                at = places[places <= n - size]
                at = at[(each[at] != MARKS[NUM]) & (fixed[at] + 1 >= self.least)]
                if len(at):
                    yield _rolled(each, at, size, size, raw), at, size, 1, False

    def slots(self, at: int, size: int, skipped: int) -> list[str]:
        """The placeholders of a window of the last text, each with its value."""
        values = self.values
        return [values[i] for i in range(at + skipped, at + size) if i in values]
