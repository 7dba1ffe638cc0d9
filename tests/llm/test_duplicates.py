"""Exact copies, near copies and common lines against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from annospark.llm import line_dedup as ld, near_dedup as nd
from annospark.llm.cuckoo import CuckooFilter
from annospark.llm.exact_dedup import exact_copies
from annospark.llm.groups import components
from annospark.llm.superminhash import WordHashes, bands, shingles, signatures
from tests.llm import edge


def test_exact_copies_match_the_plain_rule(spark):
    groups = defaultdict(list)
    for stem, text in edge.ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text or "")].append((-len(text or ""), stem is None, stem))
    want = []
    for stem, text in edge.ROWS:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text or "")
        want.append((stem, min(groups[body])[2], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()))
    got = exact_copies(edge.files(spark))
    assert edge.collected(got, "stem", "keep_stem", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = [r for r in got.collect() if r["kept"]]
    assert len(kept) == len(groups) and all(r["stem"] == r["keep_stem"] for r in kept)
    assert exact_copies(edge.empty(spark)).count() == 0


def test_exact_copies_do_not_depend_on_salts(spark):
    rows = [(i, "same text" if i % 3 else f"other {i % 7}") for i in range(500)]
    one, *more = (edge.collected(exact_copies(edge.files(spark, rows), salts=n)) for n in (1, 2, 10, 64))
    assert all(other == one for other in more)


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                root[top(i)] = top(j)
    members = defaultdict(list)
    for i, (stem, _) in enumerate(rows):
        members[top(i)].append(stem)
    least = {t: min((x for x in m if x is not None), default=None) for t, m in members.items()}
    return [(stem, len(s), least[top(i)] if s else stem) for i, ((stem, _), s) in enumerate(zip(rows, sets))]


def family(seed, n, words=120, edits=6):
    """Texts of one family: a base with some words changed, and a chain that drifts away from it."""
    r = random.Random(seed)
    base = [f"b{seed}w{r.randrange(10_000)}" for _ in range(words)]
    out, drifting = [], list(base)
    for k in range(n):
        own = list(base)
        for _ in range(r.randrange(edits)):
            own[r.randrange(words)] = f"e{r.randrange(10**9)}"
        drifting[r.randrange(words)] = f"d{k}"
        out += [" ".join(own), " ".join(drifting)]
    return out


@pytest.mark.parametrize("small,block", [(32, 256), (2, 4)])
def test_near_copies_match_all_pairs(spark, monkeypatch, small, block):
    """Both ways through a bucket, by listed pairs and by centre and blocks, give the exact components."""
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", block)
    texts = family(1, 25) + family(2, 12, words=30) + family(3, 8, words=5, edits=2)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(2000 + i, t) for i, t in enumerate(texts[:9])]
    got = nd.near_copies(edge.files(spark, rows), nd.Likeness(words=3, percent=85))
    assert edge.collected(got, "stem", "n_shingles", "component_stem") == sorted(brute_components(rows, 3, 85), key=repr)
    assert all(r["kept"] == (r["stem"] == r["component_stem"]) for r in got.collect())


def test_near_copies_of_awkward_files(spark):
    got = nd.near_copies(edge.files(spark), nd.Likeness(words=3, percent=85))
    assert edge.collected(got, "stem", "n_shingles", "component_stem") == sorted(brute_components(edge.ROWS, 3, 85), key=repr)
    assert nd.near_copies(edge.empty(spark), nd.Likeness()).count() == 0


def test_signatures_estimate_and_stop_early():
    r = random.Random(5)
    hashes = WordHashes()
    words = [f"w{i}" for i in range(400)]
    one = shingles(" ".join(words).encode(), 3, hashes)
    two = shingles(" ".join(words[:380] + [f"x{r.random()}" for _ in range(20)]).encode(), 3, hashes)
    share = len(set(one) & set(two)) / len(set(one) | set(two))
    sig = signatures([one, two, one[:1]], 512)
    assert abs((sig[0] == sig[1]).mean() - share) < 0.05
    assert len(set(sig[2])) == 512 and (bands(sig, 4)[0] == bands(sig, 4)[0]).all()


def test_components_of_a_long_chain(spark):
    pairs = [(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"x", b"y")]
    got = components(spark.createDataFrame(pairs, "a binary, b binary"))
    assert {bytes(r["node"]): bytes(r["root"]) for r in got.collect()} == {bytes([i]): bytes([0]) for i in range(61)} | {b"x": b"x", b"y": b"x"}


def brute_lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for stem, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least or not key(x)]
        out.append((stem, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shipped", [64 << 20, -1])
def test_common_lines_match_the_plain_rule(spark, monkeypatch, shipped):
    monkeypatch.setattr(ld, "SHIPPED", shipped)
    rows = edge.ROWS + [(100 + i, f"Line one\nown {i}\n\n  shared {i % 3}\x0b") for i in range(9)]
    df = edge.files(spark, rows)
    got = ld.LineIndex.of(df, min_files=3).drop_common(df)
    assert edge.collected(got) == brute_lines(rows, 3)
    nothing = ld.LineIndex.of(edge.empty(spark), min_files=3)
    assert nothing.drop_common(edge.empty(spark)).count() == 0
    assert edge.collected(nothing.drop_common(df)) == brute_lines(rows, 10**9)


def test_line_index_is_reversible(spark):
    """Taking files out again restores the counts and what is dropped; removing unknown files is an error."""
    base = [(i, f"common\nmid {i % 5}\nown {i}") for i in range(20)]
    late = [(100 + i, f"mid {i % 5}\nlate common\nlate {i}") for i in range(12)]
    a, b = edge.files(spark, base), edge.files(spark, late)
    index = ld.LineIndex.of(a, min_files=6)
    grown = index.insert(b)
    assert edge.collected(grown.drop_common(a.unionByName(b))) == brute_lines(base + late, 6)
    shrunk = grown.remove(b)
    assert edge.collected(shrunk.counts, "line_key", "n_files") == edge.collected(index.counts, "line_key", "n_files")
    assert edge.collected(shrunk.drop_common(a.unionByName(b))) != edge.collected(grown.drop_common(a.unionByName(b)))
    assert edge.collected(shrunk.drop_common(a)) == brute_lines(base, 6)
    with pytest.raises(Exception, match="not in the index"):
        shrunk.remove(b).counts.count()


def test_cuckoo_filter_keeps_and_forgets():
    r = random.Random(3)
    keys = [r.randbytes(16) for _ in range(5000)]
    made = CuckooFilter.for_keys(len(keys))
    assert made.add(keys) and made.has(keys).all()
    assert made.has([r.randbytes(16) for _ in range(20_000)]).mean() < 0.001
    again = CuckooFilter.of_bytes(made.to_bytes())
    again.remove(keys[:2500])
    assert again.has(keys[2500:]).all() and again.has(keys[:2500]).mean() < 0.001
    tiny = CuckooFilter.for_keys(4)
    assert not tiny.add(keys[:100])


def test_hot_group_of_copies_has_one_survivor(spark):
    df = edge.files(spark, [(i, "copy of one text with several words") for i in range(300)] + [(999, "something else entirely here")])
    assert [r["stem"] for r in exact_copies(df).where("kept").orderBy("stem").collect()] == [0, 999]
    assert [r["stem"] for r in nd.near_copies(df, nd.Likeness()).where("kept").orderBy("stem").collect()] == [0, 999]
    assert df.select(F.count("*")).first()[0] == 301
