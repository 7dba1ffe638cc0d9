"""Whitening against a plain eigendecomposition, and rank-one updates on their own."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from annospark.llm import queries, whitening
from annospark.llm.secular import Spectrum, rank_one

CROPS = "image_id string, box_id string, features array<double>"


def crops(spark, vectors):
    rows = [(f"img{i % 3}", f"box{i}", None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, CROPS).withColumns({c: F.lit("clash") for c in ("component", "n", "steps", "deviation", "part", "at", "value")})


def plain(vectors, components):
    """Per kept vector its deviation and whitened values, then the shares and the eigenvalues."""
    kept = [(i, v) for i, v in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    x = [[math.floor(64 * c) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:components], vecs[:, ::-1][:, :components]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    white = [[float(np.array([n * c - s for c, s in zip(v, sums)], float) / n @ vecs[:, k]) / math.sqrt(max(values[k], 1e-300)) for k in range(len(values))] for v in x]
    trace = float((centred * centred).sum() / n)
    return {f"box{i}": (dev, w) for (i, _), dev, w in zip(kept, deviation, white)}, values, trace, n


def checked(spark, vectors, components=16):
    want, values, trace, n = plain(vectors, components)
    got = whitening.whiten_features(crops(spark, vectors), components).collect()
    varies = values > 1e-9 * max(values[0], 1e-300)
    assert len(got) == len(want) * len(values)
    signs = {}
    for r in got:
        deviation, white = want[r["box_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
        if not varies[k]:
            assert r["whitened"] is None and r["explained"] in (0.0, None)
            continue
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9) and r["identity_error"] < 1e-9
        if abs(white[k]) > 1e-6:
            sign = signs.setdefault(k, 1 if r["whitened"] * white[k] > 0 else -1)
            assert r["whitened"] * sign == pytest.approx(white[k], rel=1e-6, abs=1e-7)
    return got


def features(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.geomspace(3, 0.1, d)).tolist()


def test_crop_features(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rows = features(1, 400, 24)
    checked(spark, rows + [rows[0]] * 150 + [None, [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23], components=10)


def test_refinement_reaches_the_pairs_from_a_poor_start(spark):
    x = np.floor(64 * np.array(features(2, 300, 20))).astype(int)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "steps array<long>")
    sums = [int(v) for v in x.sum(axis=0)]
    centred = x - x.mean(axis=0)
    want = np.linalg.eigvalsh(centred.T @ centred / 300)[::-1][:4]
    values, vectors, trace = whitening.refine(fit, 300, sums, np.eye(20)[:, 5:12], 4)
    assert values == pytest.approx(want, rel=1e-10) and trace == pytest.approx((centred**2).sum() / 300)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_awkward_features(spark):
    checked(spark, [[1.0, 2.0], [1.0, 2.0], [1.0], [], [3.0, -1.0]])  # short vectors end in zeros
    assert all(r["whitened"] is None and r["explained"] is None for r in whitening.whiten_features(crops(spark, [[1.0, 2.0]] * 3)).collect())
    checked(spark, [[float(i), 2.0 * i, 5.0] for i in range(6)])  # one direction only
    checked(spark, [[1e12 * i, float(i * i)] for i in range(40)], components=1)  # beyond the range of a long
    for none in ([], [None, [None]], [[], []]):
        assert whitening.whiten_features(crops(spark, none)).count() == 0


def test_query_on_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, values, trace, n = plain([r["embedding"] for r in table], 16)
    got = queries.op13_white_features(spark, sf).collect()
    ids = {r["vec_id"]: f"box{i}" for i, r in enumerate(table)}
    assert len(got) == 16 * len(table) and {r["n"] for r in got} == {n}
    for r in got:
        deviation, white = want[ids[r["vec_id"]]]
        k = r["component"] - 1
        assert r["deviation"] == deviation and abs(r["whitened"]) == pytest.approx(abs(white[k]), abs=1e-6)
        assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9) and r["identity_error"] < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7), st.lists(st.lists(st.integers(-3, 3), min_size=7, max_size=7), min_size=1, max_size=25), st.floats(1e-6, 1e6))
def test_updates_with_equal_values_and_repeated_vectors(d, rows, size):
    x = np.array(rows, float)[:, :d] * size
    cut = len(x) // 2
    one, two = Spectrum(d), Spectrum(d)
    for r in x[:cut]:
        one.add(r)
    for r in x[cut:]:
        two.add(r)
    one.merge(two)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    scale = max(np.abs(scatter).max(), size * size * 1e-3)
    assert one.n == len(x) and np.abs(one.mean - x.mean(axis=0)).max() <= 1e-12 * size
    assert np.abs(one.vectors.T @ one.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(scatter @ one.vectors - one.vectors * one.values).max() < 1e-11 * scale


def test_an_update_without_effect():
    values, vectors = rank_one(np.array([1.0, 2.0]), np.eye(2), np.zeros(2), 1.0)
    assert values.tolist() == [1, 2] and (vectors == np.eye(2)).all()
