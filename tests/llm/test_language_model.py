"""The language model against a plain one, and its arrays."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from annospark.llm import hash_arrays as ha, language_model as lm
from tests.llm import edge

BEGIN, END = "<begin>", "<end>"


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [END]


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            tokens = words_of(t)
            self.words.update(tokens)
            self.pairs.update(zip([BEGIN, *tokens], tokens))
        self.before = Counter(w for _, w in self.pairs)
        kinds = lambda c: [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        self.off2, self.off1 = ([0, *lm.discounts(*kinds(c))] for c in (self.pairs, self.before))
        self.total, self.spare = Counter(), Counter()
        for (c, _), n in self.pairs.items():
            self.total[c] += n
            self.spare[c] += self.off2[min(n, 3)]
        self.left = sum(self.off1[min(v, 3)] for v in self.before.values())

    def p(self, context, word):
        n, own = len(self.pairs), 1 / (len(self.words) + 1)
        lower = own
        if n:
            lower = (max(self.before[word] - self.off1[min(self.before[word], 3)], 0) + self.left * own) / n
        if not self.total[context]:
            return lower
        count = self.pairs[context, word]
        return max(count - self.off2[min(count, 3)], 0) / self.total[context] + self.spare[context] / self.total[context] * lower

    def row(self, text):
        tokens, n = words_of(text), sum(self.words.values())
        base = sum(math.log10((self.words[w] + 0.1) / (n + 0.1 * (len(self.words) + 1))) for w in tokens)
        score = sum(math.log10(self.p(c, w)) for c, w in zip([BEGIN, *tokens], tokens))
        return (len(tokens), sum(w in self.words for w in tokens), n, base, score, 10 ** (-score / len(tokens)))


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


COLUMNS = ("stem", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def checked(spark, train, rows):
    plain = Plain([t for _, t in train])
    model = lm.fit_model(edge.files(spark, train))
    got = lm.score_files(edge.files(spark, rows), model)
    same(edge.collected(got, *COLUMNS), sorted([(s, *plain.row(t)) for s, t in rows], key=repr))
    return plain


def test_scores_are_those_of_a_plain_model(spark, monkeypatch):
    """Label lines of annotated images; small runs and pieces, so that texts are cut many times."""
    monkeypatch.setattr(lm, "TOKENS", 50)
    monkeypatch.setattr(lm, "PIECE", 100)
    r = random.Random(7)
    lines = lambda: "\n".join(f"{min(r.randrange(9), r.randrange(9))} 0.{r.randrange(30)} 0.{r.randrange(30)} 0.{r.choice('125')} 0.5" for _ in range(r.randrange(12)))
    rows = [(i, lines()) for i in range(120)]
    plain = checked(spark, rows[:90], rows)
    assert plain.off2[1] not in (0.5,)  # the counts of counts gave the discounts
    seen = [*plain.words, "never seen"]
    for context in [BEGIN, "0", "0.5", END, "never seen"]:
        assert sum(plain.p(context, w) for w in seen) == pytest.approx(1)


def test_awkward_files(spark):
    checked(spark, edge.ROWS, edge.ROWS)
    checked(spark, [], edge.ROWS[:6])
    checked(spark, [(1, None)], edge.ROWS[:6])
    assert lm.score_files(edge.empty(spark), lm.fit_model(edge.files(spark))).count() == 0


def test_label_files_on_disk(spark, tmp_path):
    """The model reads what the library's own label reader gives."""
    from annospark.sources.labels import read_label_texts

    for i in range(6):
        (tmp_path / f"img{i}.txt").write_text(f"0 0.5 0.5 0.1 0.{i}\n1 0.5 0.5 0.2 0.2\n" * i)
    files = read_label_texts(spark, str(tmp_path))
    plain = Plain([(tmp_path / f"img{i}.txt").read_text() for i in range(6)])
    got = lm.score_files(files, lm.fit_model(files))
    same(edge.collected(got, *COLUMNS), sorted([(f"img{i}", *plain.row((tmp_path / f"img{i}.txt").read_text())) for i in range(6)], key=repr))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**40)), max_size=60), st.integers(1, 9))
def test_blocks_and_shards(rows, shards):
    keys, values = (np.array([r[k] for r in rows], np.uint64) for k in (0, 1))
    assert all((a == b).all() for a, b in zip(ha.unpacked(ha.packed(keys, values)), (keys, values)))
    want = Counter()
    for k, v in rows:
        want[k] += v
    found, sums = ha.summed(keys, values)
    assert list(zip(found.tolist(), sums.tolist())) == sorted(want.items())
    cuts = ha.shard_cuts(found, shards)
    for p in range(shards):
        assert all((int(k) >> 32) * shards >> 32 == p for k in found[cuts[p] : cuts[p + 1]])


def test_arrays_are_found_by_rank(tmp_path):
    hashes = np.sort(np.array([3, 5, 1 << 63, 2**64 - 1, 7 << 40], np.uint64))
    cuts = ha.shard_cuts(hashes, 4)
    arrays = ha.HashArrays(str(tmp_path), "word", np.diff(cuts))
    for p in np.flatnonzero(np.diff(cuts)):
        ha.write_array(arrays.path("hash", p), hashes[cuts[p] : cuts[p + 1]])
        ha.write_array(arrays.path("count", p), ha.narrow(np.arange(cuts[p], cuts[p + 1]) * 10))
    asked = np.sort(np.append(hashes, np.array([4, 9 << 41], np.uint64)))
    ranks = arrays.find(asked)
    assert [int(r) for r in ranks if r >= 0] == [0, 1, 2, 3, 4] and (ranks < 0).sum() == 2
    assert arrays.values(("count",), np.array([-1, 0, 2, 4]))[0].tolist() == [0, 0, 20, 40]
