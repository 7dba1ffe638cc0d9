import random
import statistics

import pytest
from pyspark.sql import functions as F

from annospark.operators import acceptance as ac, density, order_stats, status
from annospark.plans import automate, study


def scored(spark, rows):
    return spark.createDataFrame([(i, n, float(s)) for n, (i, s) in enumerate(rows)], "image_id string, box_ord long, score double")


def counts(spark, ns):
    return spark.createDataFrame([(f"i{k}", n) for k, n in enumerate(ns)], "image_id string, n long")


def density_row(spark, ns, images=1, boxes=1):
    return density.seed_density(counts(spark, ns), images, boxes).first()


def test_seed_density(spark):
    r = density_row(spark, [3, 3, 5])
    assert (r["n_images"], r["total_boxes"], r["median_count"], r["p90_count"], r["reliable"]) == (3, 11, 3.0, 5.0, True)
    assert r["mean_count"] == pytest.approx(11 / 3)
    assert density_row(spark, [3, 3], 3, 3)["reliable"] is False
    empty = density.seed_density(counts(spark, [1]).limit(0), 1, 1).first()
    assert (empty["n_images"], empty["mean_count"], empty["p90_count"], empty["reliable"]) == (0, 0.0, 0.0, False)


def test_p90_is_nearest_rank_half_even(spark):
    rng = random.Random(1)
    for n in (1, 2, 6, 11, 16):
        ns = [rng.randrange(9) for _ in range(n)]
        assert density_row(spark, ns)["p90_count"] == sorted(ns)[round(0.9 * (n - 1))]
        assert density_row(spark, ns)["median_count"] == statistics.median(ns)


def test_k_star_rounds_half_to_even():
    assert [density.k_star(m) for m in (2.5, 3.5, 0.0, 400)] == [2, 4, 1, 100]


def seed(make_boxes, boxes, images=4):
    return make_boxes([(*b, 0.9, 0, f"i{i}") for i in range(images) for b in boxes])


def test_adaptive_decision(make_boxes):
    dense = [(100 * k, 0, 100 * k + 50, 50) for k in range(6)]
    row = density.adaptive_decision(seed(make_boxes, dense)).first()
    assert row["containment"] is True and row["seed_mean"] == 6.0 and row["max_topk"] == 9
    assert density.adaptive_decision(seed(make_boxes, dense[:1])).first()["containment"] is False
    nested = [(0, 0, 800, 800), (300, 300, 450, 450), (900, 0, 950, 50), (900, 900, 950, 950)]
    row = density.adaptive_decision(seed(make_boxes, nested)).first()
    assert row["containment"] is False and row["nest_frac"] == pytest.approx(1 / 12, abs=1e-4)
    none = density.adaptive_decision(seed(make_boxes, dense).limit(0)).first()
    assert none["containment"] is True and none["max_topk"] is None


FIVE = [("a", 0.95), ("a", 0.75), ("a", 0.55), ("a", 0.35), ("a", 0.15)]


def test_threshold_and_adaptive(spark):
    df = scored(spark, FIVE)
    assert ac.fixed(df, 0.5)[0].count() == 3
    kept = ac.adaptive_k(df, ac.Seed(1.0, 1.0))[0].collect()
    assert [r["score"] for r in kept] == [0.95]


def test_topk_ties_keep_list_order(spark):
    df = scored(spark, [("a", 0.5), ("a", 0.5), ("a", 0.5), ("b", 0.01)])
    kept = ac.top_k(df, ac.Seed(2.0, 2.5))[0].collect()
    assert sorted(r["box_ord"] for r in kept) == [0, 1]


def test_unseen_image_gets_smallest_budget(spark):
    pool, mine = scored(spark, FIVE), scored(spark, [("new", 0.9), ("new", 0.8)])
    assert ac.adaptive_k(mine, ac.Seed(3.0, 3.0), pool=pool)[0].count() == 1


def test_global_tau_keeps_ties(spark):
    df = scored(spark, [("a", 0.9), ("a", 0.5), ("b", 0.5), ("b", 0.5), ("b", 0.1)])
    accepted, fit = ac.global_tau(df, ac.Seed(1.0, 1.0))
    assert fit.target_total == 2 and fit.tau == 0.5 and accepted.count() == 4
    assert ac.global_tau(df, ac.Seed(0.0, 0.0))[1].tau == 1.0
    assert ac.global_tau(df, ac.Seed(9.0, 9.0))[1].tau == 0.05
    assert ac.global_tau(df.limit(0), ac.Seed(2.0, 2.0))[1].tau == 1.0


def test_otsu(spark):
    assert ac.otsu_tau(scored(spark, [("a", 0.3)])) == 0.5
    nan = scored(spark, [("a", float("nan")), ("a", 0.2)])
    assert ac.otsu_tau(nan) == 0.5
    two = scored(spark, [("a", s) for s in (0.1, 0.12, 0.11, 0.9, 0.92)])
    tau = ac.otsu_tau(two)
    assert 0.12 < tau <= 0.9
    assert tau == 8 / 64  # upper edge of the first best bin
    assert ac.otsu_tau(scored(spark, [("a", -1.0), ("a", 2.0)])) == 1 / 64


def test_rate(spark):
    assert ac.rate(scored(spark, FIVE), 0.5)[0].count() == 2  # round(2.5) is 2
    assert ac.rate(scored(spark, FIVE), 0.0)[1].tau == 1.0
    assert ac.rate(scored(spark, FIVE), 0.01)[0].count() == 1


def test_fold_gate(spark):
    df = scored(spark, FIVE).withColumn("p_good", F.col("score"))
    assert sorted(r["score"] for r in ac.fold_gate(df, 0.4).collect()) == [0.55, 0.75, 0.95]
    assert ac.fold_gate(df, 0.0).count() == 5


def test_kth_largest_matches_sorting(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.choice([0.25, rng.random(), rng.gauss(0, 5)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    ordered = sorted(values, reverse=True)
    for fine in (10**6, 40, 1):
        monkeypatch.setattr(order_stats, "FINE_ENOUGH", fine)
        for k in (1, 2, 777, 1500, 2999, 3000):
            assert order_stats.kth_largest(df, "v", k) == ordered[k - 1]
        assert order_stats.kth_largest(df, "v", 3001) is None


@pytest.mark.parametrize("one_task", [10**6, 10])
def test_running_and_dense_ids(spark, monkeypatch, one_task):
    monkeypatch.setattr(order_stats, "ONE_TASK", one_task)
    rng = random.Random(4)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2])}", i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(6)
    got = {r["i"]: r["s"] for r in order_stats.running(df, ["i"], {"s": F.col("v")}, ["k"]).collect()}
    most = {r["i"]: r["m"] for r in order_stats.running(df, [F.desc("i")], {"m": F.col("v")}, ["k"], largest=True).collect()}
    sums = {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[i] == sums[k]
        assert most[i] == max(w for kk, j, w in rows if kk == k and j >= i)
    ids = order_stats.dense_ids(df, ["i"]).collect()
    assert all(r["id"] == r["i"] + 1 for r in ids)


def test_adaptive_collection_takes_first_level_with_a_box(spark):
    df = spark.createDataFrame(
        [("a", 0, 0.3), ("a", 1, 0.06), ("a", 2, 0.03), ("b", 0, 0.012), ("b", 1, 0.004), ("c", 0, 0.0001)],
        "image_id string, box_ord long, det_conf double",
    )
    got = {(r["image_id"], r["box_ord"]) for r in ac.adaptive_collection(df).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0)}


def test_histogram_counts_every_candidate(spark):
    df = spark.createDataFrame([(s, 1 - s) for s in (0.0, 0.005, 0.5, 0.999, 1.0)], "p_good double, det_conf double")
    h = status.score_histogram(df, 10)
    rows = h.orderBy("bin").collect()
    assert len(rows) == 10 and sum(r["n_p_good"] for r in rows) == sum(r["n_det_conf"] for r in rows) == 5
    assert rows[9]["n_p_good"] == 2 and rows[0]["n_p_good"] == 2
    last = None
    for t in (0.0, 0.3, 0.55, 0.95, 1.0):  # counts never rise with the threshold
        n = status.accepted_at(h, "n_p_good", t, 10).first()[0]
        assert last is None or n <= last
        last = n


def dataset(spark, make_boxes):
    images = spark.createDataFrame([(f"i{k}", 640, 480) for k in range(8)], "image_id string, width int, height int")
    rng = random.Random(9)
    rows = []
    for k in range(8):
        for j in range(6):
            x, y = 100 * j + rng.random(), rng.randrange(300)
            rows.append((x, y, x + 60, y + 60, round(rng.random(), 3), j % 2, f"i{k}"))
    raw = make_boxes(rows)
    owned = images.where("image_id in ('i0', 'i1')").select("image_id")
    human = make_boxes([(10 + 100 * j, 10, 60 + 100 * j, 60, 1.0, 0, f"i{k}") for k in range(2) for j in range(3)])
    return images, raw, owned, human


def test_single_image_agrees_with_batch(spark, make_boxes):
    images, raw, owned, human = dataset(spark, make_boxes)
    for method in ("count_guided", "conf50"):
        every = automate.automate_all(images, raw, owned, human, method)
        assert every.where("image_id in ('i0', 'i1')").count() == 0  # the seed is never overwritten
        one = automate.automate_image(images, raw, owned, human, "i5", method)
        key = lambda df: sorted((r["box_ord"], r["cls"], r["cx"]) for r in df.where("image_id = 'i5'").collect())
        assert key(every) == key(one)


def test_missing_seed_falls_back(spark, make_boxes):
    _, raw, _, human = dataset(spark, make_boxes)
    seed = automate.seed_figures(human.limit(0))
    _, fit, fell_back = automate.apply_method(raw, "count_guided", seed, automate.Decision.of(human.limit(0)))
    assert fell_back and fit.strategy == "auto_adaptive_otsu"


def test_thresholds_are_monotone(spark, make_boxes):
    images, raw, owned, human = dataset(spark, make_boxes)
    n = [automate.automate_all(images, raw, owned, human, m).count() for m in ("conf25", "conf50", "conf75", "conf90")]
    assert n == sorted(n, reverse=True)


def test_conditions(spark, make_boxes):
    _, raw, _, human = dataset(spark, make_boxes)
    few, enough = density.seed_counts(human).limit(1), density.seed_counts(human)
    assert study.run_condition("C1_manual", raw, enough)[0].count() == 0
    fixed = study.run_condition("C2_auto_fixed_conf", raw, enough)[0]
    accepted, fit = study.run_condition("C3_auto_count_guided", raw, few)
    assert fit.reliable is False and accepted.count() == fixed.count()
    accepted, fit = study.run_condition("C3_auto_count_guided", raw, enough)
    assert fit.k_star == 3 and accepted.groupBy("image_id").count().agg(F.max("count")).first()[0] <= 3
    with pytest.raises(ValueError):
        study.run_condition("C9", raw, enough)
