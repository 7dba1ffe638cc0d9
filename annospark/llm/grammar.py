"""A weighted finite-state grammar of abusive clauses, run inside tasks.

A clause passes through a cascade: the lexical transducer turns words into symbols, the negation, reported-speech
and target transducers rewrite symbols depending on what stands before them, and the scoring acceptor counts what is
left. Each transducer is a table ``(state, symbol) -> (state, symbol)`` where a missing entry means "stay and copy".
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash

# Closed word classes, in English, German, French and Spanish.
NEGATIONS = "not never no nobody neither nor don't isn't aren't nicht kein keine keinen nie pas jamais aucun ni nunca jamás".split()
REPORTS = (
    "said says say called calls quoted wrote claimed reported according accused sagte sagt nannte schrieb berichtete "
    "dit disait appelé écrit selon dijo dice llamó escribió según"
).split()
TARGETS = "you your you're yours u du dich dir dein deine ihr euch tu toi te vous ton votre tú usted ustedes vosotros tus".split()
THREATS = (
    "kill murder hurt beat shoot stab destroy burn hunt strangle töten umbringen schlagen tuer frapper détruire matar "
    "golpear destruir"
).split()
INSULTS = "idiot moron stupid loser trash scum pathetic worthless disgusting clown".split()

OTHER, INSULT, THREAT, TARGET, NOT, REPORT = "o", "i", "t", "y", "n", "r"
NEGATED, QUOTED, AIMED, AIMED_THREAT = "ni", "qi", "yi", "yt"
SIGNS = (INSULT, AIMED, NEGATED, QUOTED, THREAT, AIMED_THREAT)  # what the acceptor counts
SCOPE = 3  # words after a negation that it still reaches


def _negation() -> dict:
    table = {(0, NOT): (SCOPE, OTHER)}
    for left in range(1, SCOPE + 1):
        table |= {(left, s): (left - 1, s) for s in (OTHER, TARGET, REPORT)}
        table |= {(left, s): (0, NEGATED) for s in (INSULT, THREAT)} | {(left, NOT): (SCOPE, OTHER)}
    return table


def _reported() -> dict:
    return {(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER)} | {(1, s): (1, QUOTED) for s in (INSULT, THREAT)}


def _aimed() -> dict:
    seen = {(0, TARGET): (1, OTHER), (1, TARGET): (1, OTHER), (1, INSULT): (1, AIMED), (1, THREAT): (1, AIMED_THREAT)}
    late = {(0, INSULT): (2, INSULT), (2, TARGET): (1, AIMED), (0, THREAT): (3, THREAT), (3, TARGET): (1, AIMED_THREAT)}
    return seen | late


CASCADE = (_negation(), _reported(), _aimed())


def rewritten(symbols: list[str]) -> list[str]:
    """A clause's symbols after the whole cascade."""
    for table in CASCADE:
        state, out = 0, []
        for s in symbols:
            state, s = table.get((state, s), (state, s))
            out.append(s)
        symbols = out
    return symbols


BARE = re.compile(r"^[^\w]+|[^\w]+$")
ENDS = frozenset(".!?;:,\n")


@dataclass
class Grammar:
    """Lexicon and weights. ``stems`` are word beginnings, ``words`` whole words, each with its insult weight."""

    words: dict[str, float] = field(default_factory=lambda: {w: 1.0 for w in INSULTS})
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [3.0, 4.0, 0.5, 0.8, 1.5, 4.0])
    bias: float = -3.0

    def __post_init__(self):
        self.closed = {}
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NOT, NEGATIONS), (REPORT, REPORTS)):
            self.closed |= {w: (symbol, 1.0) for w in words}
        self.lengths = sorted({len(s) for s in self.stems})
        self.seen: dict[str, tuple] = {}

    def symbol(self, token: str) -> tuple[str, float, bool]:
        """The lexical transducer: symbol and weight of a lower-case token, and whether a clause ends with it."""
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            found = self.seen[token] = (*self._looked_up(BARE.sub("", token)), token[-1] in ENDS)
        return found

    def _looked_up(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in self.lengths:
            if len(word) >= n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return self.closed.get(word, (OTHER, 0.0))

    def clauses(self, text: str) -> list[tuple[list[str], float]]:
        """The rewritten symbols of every clause with an insult or a threat, and its largest lexical weight."""
        symbol, out = self.symbol, []
        for line in text.lower().split("\n"):
            marks = [symbol(t) for t in line.split()]
            if not any(m[0] in (INSULT, THREAT) for m in marks):
                continue
            clause: list[tuple] = []
            for m in [*marks, None]:
                if m is not None:
                    clause.append(m)
                if clause and (m is None or m[2]):
                    if any(c[0] in (INSULT, THREAT) for c in clause):
                        out.append((rewritten([c[0] for c in clause]), max(c[1] for c in clause)))
                    clause = []
        return out

    def features(self, text: str) -> list[float]:
        """How much of each sign the clauses hold, damped so that length does not decide."""
        total = Counter()
        for symbols, weight in self.clauses(text):
            for s in symbols:
                if s in SIGNS:
                    total[s] += weight
        return [math.log1p(total[s]) if total[s] else 0.0 for s in SIGNS]

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


LEAST, ODDS = 8, 30.0  # surroundings and toxic texts of a fragment, and how much oftener toxic texts have it


def fragments_of(text: str, toxic: int):
    """``(fragment, None)`` for every fragment of a text, and for toxic texts also with a hash of each pair of words around it."""
    tokens = [BARE.sub("", t) for t in text.lower().split()]
    met = {w: set(_fragments(w)) for w in set(tokens)}
    yield from ((f, None) for f in set().union(*met.values()))
    if toxic:
        for a, w, b in zip(["", *tokens], tokens, [*tokens[1:], ""]):
            around = xxhash.xxh3_64_intdigest(f"{a} {b}") - (1 << 63)
            yield from ((f, around) for f in met[w])


def lexicon(around: dict[str, int]) -> tuple[dict, dict]:
    """Words and word beginnings that stand in toxic texts and hardly in others, from clear fragments and their surroundings.

    A fragment counts once for each pair of words around it, not once per text, so the vocabulary of one text
    with many copies is not taken for abuse. The shortest beginning that is clear enough stands for all words with it.
    """
    clear = sorted(around, key=lambda f: (len(f), f))
    words, stems = {}, {}
    for f in clear:
        if any(f.startswith(s) for s in stems) or f.removesuffix("$") in words:
            continue
        # what nearly all words with this beginning go on with belongs to it
        longer = [g for g in clear if g.startswith(f) and around[g] >= 0.9 * around[f]]
        f = max(longer, key=len)
        if f.endswith("$"):
            words[f[:-1]] = 1.0
        else:
            stems[f] = 1.0
    return words, stems


def learned_lexicon(texts: list[str], toxic: list[int], least: int, odds: float) -> tuple[dict, dict]:
    """The ``lexicon`` of texts at hand."""
    around: dict[str, set] = {}
    found, totals = (Counter(), Counter()), Counter(toxic)
    for text, y in zip(texts, toxic):
        for f, place in fragments_of(text, y):
            if place is None:
                found[y][f] += 1
            else:
                around.setdefault(f, set()).add(place)
    often = lambda f: ((found[1][f] + 0.5) / (totals[1] + 1)) / ((found[0][f] + 0.5) / (totals[0] + 1)) >= odds
    return lexicon({f: len(s) for f, s in around.items() if len(s) >= least and found[1][f] >= least and often(f)})


def _fragments(word: str):
    if len(word) >= 3:
        yield word + "$"
        for n in range(4, min(len(word), 8)):
            yield word[:n]


def fitted(texts: list[str], toxic: list[int], least: int = LEAST, odds: float = ODDS) -> Grammar:
    """A grammar from labelled texts: lexicon by contrast, sign weights by logistic regression.

    Without texts of both kinds the grammar keeps its built-in lexicon and weights.
    """
    if len(set(toxic)) < 2:
        return Grammar()
    model = with_lexicon(*learned_lexicon(texts, toxic, least, odds))
    return weighted(model, [model.features(t) for t in texts], toxic, [1] * len(texts))


def with_lexicon(words: dict, stems: dict) -> Grammar:
    return Grammar({w: 1.0 for w in INSULTS} | words, stems)


def weighted(model: Grammar, features: list[list[float]], toxic: list[int], times: list[int]) -> Grammar:
    """``model`` with sign weights for the features of texts, each of which counts ``times``."""
    x = np.array([[*f, 1.0] for f in features])
    y, n = np.array(toxic, float), np.array(times, float)
    beta = np.array([*model.weights, model.bias])
    anchor, pull = beta * np.array([1.0] * len(SIGNS) + [0.0]), np.array([0.5] * len(SIGNS) + [0.01])
    for _ in range(50):  # Newton steps; the built-in weights are the prior
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (n * (y - p)) - pull * (beta - anchor))
        size = np.abs(step).max()
        beta += step / max(1.0, size / 4)
        if size < 1e-6:
            break
    model.weights, model.bias = [float(max(0.0, b)) for b in beta[:-1]], float(beta[-1])
    return model
