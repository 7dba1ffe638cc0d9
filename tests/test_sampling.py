import pytest
from pyspark.sql import functions as F

from annospark.operators import negatives as ng, sampling
from annospark.plans import training
from tests import plain

CENTRE = "image_id string, box_ord int, cls int, cx double, cy double, w double, h double"


def labelled(spark, classes):
    """``classes`` maps an image to its classes."""
    rows = [(i, k, c, 0.5, 0.5, 0.1, 0.1) for i, cs in classes.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, CENTRE)


def splits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["split"], set()).add(r["image_id"])
    return out


def test_quota(spark):
    boxes = labelled(spark, {f"i{k}": [0] + ([1] if k < 3 else []) for k in range(50)})
    classes = spark.createDataFrame([(0,), (1,), (2,)], "cls int")
    got = {r["cls"]: r["quota"] for r in sampling.seed_quota(boxes, classes, percent=5).collect()}
    assert got == {0: 2, 1: 1, 2: 0}  # 2.5 rounds to even, a rare class gets one, an absent one none


def test_draw_seed_equals_the_walk(spark):
    """Walking the images in hash order and taking what is still wanted gives the same set."""
    from annospark.functions.hashing import order_key

    classes = {f"i{k}": sorted({k % 3, (k * 7) % 5}) for k in range(60)}
    boxes = labelled(spark, classes)
    quota = spark.createDataFrame([(c, 4) for c in range(5)], "cls int, quota long")
    order = [r["image_id"] for r in boxes.select("image_id").distinct().orderBy(order_key(42, "image_id"), "image_id").collect()]
    have, walked = dict.fromkeys(range(5), 0), set()
    for image in order:
        if any(have[c] < 4 for c in classes[image]):
            walked.add(image)
            for c in classes[image]:
                have[c] += 1
    for small in (1000, 0):
        sampling.SMALL_QUOTA = small
        assert {r[0] for r in sampling.draw_seed(boxes, quota).collect()} == walked
    sampling.SMALL_QUOTA = 1000


def test_holdout_keeps_every_class_in_training(spark):
    classes = {f"i{k:02}": [k % 2] for k in range(20)} | {"r1": [7], "r2": [7, 8], "r3": [8]}
    for seed in range(6):
        s = splits(sampling.holdout_split(labelled(spark, classes), 0.5, seed))
        assert {c for i in s["train"] for c in classes[i]} == {0, 1, 7, 8}
        assert s["train"] | s["val"] == set(classes) and not s["train"] & s["val"]
    one = splits(sampling.holdout_split(labelled(spark, {"a": [0]})))
    assert one == {"train": {"a"}, "val": {"a"}}


def test_stratified_split(spark):
    rows = spark.createDataFrame([(f"k{i}", c) for i, c in enumerate([0] * 12 + [1] * 2 + [2])], "key string, cls int")
    got = sampling.stratified_split(rows, "key", "cls").groupBy("cls", "split").count().collect()
    assert {(r["cls"], r["split"]): r["count"] for r in got} == {(0, "val"): 2, (0, "train"): 10, (1, "val"): 1, (1, "train"): 1, (2, "train"): 1}
    singles = spark.createDataFrame([("a", 0), ("b", 1)], "key string, cls int")
    assert sorted(r["split"] for r in sampling.stratified_split(singles, "key", "cls").collect()) == ["train", "val"]


def test_random_split_is_exact(spark):
    rows = spark.range(103).withColumnRenamed("id", "key")
    a, b = sampling.random_split(rows, "key"), sampling.random_split(rows.repartition(9), "key")
    val = lambda df: {r["key"] for r in df.where("split = 'val'").collect()}
    assert len(val(a)) == 20 and val(a) == val(b)


def test_cap_crops(spark):
    rows = spark.createDataFrame([(f"i{k}", j) for k in range(5) for j in range(3)], "image_id string, crop_ord long")
    assert sampling.cap_crops(rows, 4).count() == 6
    assert sampling.cap_crops(rows, 4, trim=True).count() == 4


# -- negatives ----------------------------------------------------------------------------------
def gold(spark, boxes, images=30, size=(640, 480)):
    rows = [(f"i{i}", k, *map(float, b), *size) for i in range(images) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "image_id string, box_ord long, x1 double, y1 double, x2 double, y2 double, width int, height int")


GT = (200, 150, 300, 250)


def wanted(spark, n, images=30):
    return spark.createDataFrame([(f"i{i}", n, n) for i in range(images)], "image_id string, n_deviated long, n_empty long")


def boxes_of(df):
    return [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in df.collect()]


def shift_of(b):
    return (((b[0] + b[2]) / 2 - 250) ** 2 + ((b[1] + b[3]) / 2 - 200) ** 2) ** 0.5 / 100


def test_refined_displacement(spark):
    rule = ng.Rule("refined")
    made = boxes_of(ng.fabricate_deviated(gold(spark, [GT]), wanted(spark, 10), rule))
    shifts = [shift_of(b) for b in made]
    assert len(made) == 300 and sum(shifts) / len(shifts) == pytest.approx(0.80, abs=0.05)
    assert all(0.67 < s < 0.93 for s in shifts)
    assert all(plain.iou(b, GT) < 0.75 for b in made)
    far = [shift_of(b) for b in boxes_of(ng.fabricate_deviated(gold(spark, [GT]), wanted(spark, 10), ng.Rule()))]
    assert sum(far) / len(far) > sum(shifts) / len(shifts) + 0.3


def test_baseline_limit(spark):
    made = boxes_of(ng.fabricate_deviated(gold(spark, [GT]), wanted(spark, 10), ng.Rule()))
    assert made and all(plain.iou(b, GT) <= 0.25 for b in made)
    assert all(plain.area(b) >= 0.7 * plain.area(GT) - 1e-6 for b in made)


@pytest.mark.parametrize("limit", [2000, 0])
def test_empty_boxes(spark, limit):
    refined = boxes_of(ng.fabricate_empty(gold(spark, [GT]), wanted(spark, 5), ng.Rule("refined"), hot_limit=limit))
    assert len(refined) == 150 and all(plain.iou(b, GT) < 0.75 for b in refined)
    baseline = boxes_of(ng.fabricate_empty(gold(spark, [GT]), wanted(spark, 5), ng.Rule(), hot_limit=limit))
    assert len(baseline) == 150 and all(plain.iou(b, GT) <= 0.1 for b in baseline)
    assert all(0 <= b[0] < b[2] <= 640 and 0 <= b[1] < b[3] <= 480 for b in baseline + refined)


def test_large_images_draw_the_same(spark):
    g, w = gold(spark, [GT, (10, 10, 60, 80), (400, 300, 500, 420)], 4), wanted(spark, 6, 4)
    for rule in (ng.Rule(), ng.Rule("refined")):
        a = ng.fabricate_deviated(g, w, rule).collect()
        assert sorted(a) == sorted(ng.fabricate_deviated(g, w, rule, hot_limit=1).collect())
        b = ng.fabricate_empty(g, w, rule).collect()
        assert sorted(b) == sorted(ng.fabricate_empty(g, w, rule, hot_limit=1).collect())


def test_full_image_gets_no_background(spark):
    full = gold(spark, [(0, 0, 60, 60)], 2, size=(60, 60))  # any box of half the side overlaps by a fifth
    assert ng.fabricate_empty(full, wanted(spark, 3, 2), ng.Rule()).count() == 0


def test_jitter_stays_close(spark):
    moved = boxes_of(ng.jitter_boxes(gold(spark, [GT]), 0.05))
    assert all(plain.iou(b, GT) > 0.8 and b != GT for b in moved)
    assert boxes_of(ng.jitter_boxes(gold(spark, [GT]), 0.0)) == [GT] * 30


def test_counts_follow_the_ratios(spark):
    good = ng.good_boxes(gold(spark, [GT] * 5, 1))
    row = ng.negative_counts(good, ng.Rule()).first()
    assert (row["n_good"], row["n_empty"], row["n_deviated"]) == (5, 3, 4)
    assert ng.negative_counts(good, ng.APP_RULE).first()["n_deviated"] == 10


def test_rule_settings():
    r = ng.validate_rule({"good_crop_ratio": 2, "empty_crop_ratio": 1, "deviation_ratio": 1, "unknown": 3})
    assert (r.good_crop_ratio, r.empty_crop_ratio, r.deviation_ratio) == (0.5, 0.25, 0.25)
    assert ng.validate_rule({"deviation_shift": 9}).deviation_shift == 2.0
    assert ng.validate_rule({"deviation_shift": 0}).deviation_shift == 0.1
    assert ng.validate_rule({"deviation_per_image": 99}).deviation_per_image == 30
    assert ng.validate_rule({"negative_rule": "odd"}).negative_rule == "baseline"
    assert ng.shift_band(0.8) == pytest.approx((0.68, 0.92)) and ng.shift_band(0.1)[0] == 0.05
    with pytest.raises(ValueError):
        ng.Rule("odd")
    with pytest.raises(ValueError):
        ng.Rule(good_crop_ratio=0.9)


def test_training_set_and_model_crops(spark):
    made = training.fabricate_training_set(gold(spark, [GT, (10, 10, 90, 90)], 10), ng.Rule("refined"))
    n = {r["kind"]: r["count"] for r in made.groupBy("kind").count().collect()}
    assert n == {"good": 20, "empty": 10, "deviated": 10}  # int(2 * 0.6 / 0.4) is 2 in floating point
    scored = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.49,)], "score double")
    crops = ng.model_based_crops(scored)
    assert sorted((r["score"], r["y"]) for r in crops.collect()) == [(0.49, 0), (0.9, 1)]
    assert ng.has_both_classes(crops) and not ng.has_both_classes(crops.where("y = 1"))


def test_class_head_needs_two_classes(spark):
    images = spark.createDataFrame([("a", 100, 100)], "image_id string, width int, height int")
    crops = training.class_head_dataset(labelled(spark, {"a": [0, 0, 1, 1]}), images)
    assert crops.count() == 4 and training.class_head_ready(crops)
    assert not training.class_head_ready(crops.where("cls = 0"))


def test_cycle(spark):
    """Round one trains on the seed, later rounds on model labels too; only the last is not gated."""
    images = spark.createDataFrame([(f"i{k}", 640, 480) for k in range(6)], "image_id string, width int, height int")
    owned = images.where("image_id = 'i0'").select("image_id")
    seed = gold(spark, [GT, (10, 10, 90, 90), (400, 300, 500, 400)], 1).withColumn("label", F.lit(0)).drop("width", "height")
    raw = gold(spark, [GT, (10, 10, 90, 90), (400, 300, 500, 400)], 6).drop("width", "height").select(
        "*", F.lit(0).alias("label"), (0.9 - F.col("box_ord") / 10).alias("p_good"), F.lit(0.5).alias("det_conf")
    )
    trained_on = []

    def train(boxes):
        trained_on.append(boxes.count())
        return "model"

    saved, summary = training.self_training_cycle(images, owned, seed, train, lambda model: raw, rounds=2)
    rows = summary.orderBy("round").collect()
    assert [(r["scope"], r["auto_labeled"]) for r in rows] == [("human", 5), ("all", 5)]
    assert trained_on == [3, 3 + rows[0]["total_boxes"]]
    assert rows[0]["total_boxes"] < rows[1]["total_boxes"] == saved.count() == 15


def test_stopped_cycle_goes_on(spark, tmp_path):
    """A run that stops in its third round gives, taken up again, what an unbroken one gives, and trains no finished round again."""
    images = spark.createDataFrame([(f"i{k}", 640, 480) for k in range(5)], "image_id string, width int, height int")
    owned = images.where("image_id = 'i0'").select("image_id")
    seed = gold(spark, [GT, (10, 10, 90, 90), (400, 300, 500, 400)], 1).withColumn("label", F.lit(0)).drop("width", "height")
    raw = gold(spark, [GT, (10, 10, 90, 90), (400, 300, 500, 400)], 5).drop("width", "height").select(
        "*", F.lit(0).alias("label"), (0.9 - F.col("box_ord") / 10).alias("p_good"), F.lit(0.5).alias("det_conf")
    )
    trained = []

    def run(folder, stop=None, **more):
        def train(boxes):
            trained.append(boxes.count())
            if len(trained) == stop:
                raise RuntimeError("stopped")
            return trained[-1]

        # what a model finds depends on what it was trained on
        score = lambda model: raw.withColumn("p_good", F.col("p_good") - F.lit(model % 7) / 100)
        saved, summary = training.self_training_cycle(images, owned, seed, train, score, rounds=3, output=str(tmp_path / folder), measure=lambda m: {"map50": float(m)}, **more)
        return sorted(map(tuple, saved.collect())), sorted(map(tuple, summary.collect()))

    whole = run("whole")
    assert len(trained) == 3
    trained.clear()
    with pytest.raises(RuntimeError):
        run("parts", stop=3)
    trained.clear()
    assert run("parts", resume=True) == whole and len(trained) == 1
    trained.clear()
    assert run("parts", resume=True) == whole and not trained
    assert run("new", resume=True) == whole and len(trained) == 3
    with pytest.raises(ValueError):
        run("parts", resume=True, fold_share=0.1)


@pytest.mark.parametrize("name", ["baseline", "refined"])
def test_ordinary_images_make_their_attempts_in_one_row(spark, monkeypatch, name):
    """No attempt is written or dealt anew for them, and large images, which go by joins, get the same boxes."""
    from annospark.operators import negatives as ng

    rows = [(i, k, 5.0 + 40 * k, 7.0 + 30 * k, 60.0 + 45 * k + i, 70.0 + 33 * k) for i in range(12) for k in range(1 + i % 5)]
    gold = spark.createDataFrame(rows, "image_id long, box_ord long, x1 double, y1 double, x2 double, y2 double")
    gold = gold.withColumns({"width": F.lit(320), "height": F.lit(240)})
    wanted = gold.groupBy("image_id").agg((F.count("*") * 2).alias("n_empty"), (F.count("*") * 3).alias("n_deviated"))
    written = []
    cut = ng.cut_lineage
    monkeypatch.setattr(ng, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    for make in (ng.fabricate_empty, ng.fabricate_deviated):
        found = {limit: sorted(map(tuple, make(gold, wanted, ng.Rule(name), hot_limit=limit).collect())) for limit in (2000, 3, 0)}
        assert found[2000] and found[2000] == found[3] == found[0]
        written.clear()
        make(gold, wanted, ng.Rule(name))
        assert len(written) <= 1 and not any({"attempt", "slot", "next"} & set(c) for c in written)


def test_boxes_are_jittered_once(spark):
    """Neither a filter on the moved corners nor the counts that follow from them hash again, and the draws are those of the key."""
    from annospark.functions import hashing

    hashes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("md5(")
    g = gold(spark, [GT, (10, 10, 90, 90)], 4).withColumn("image_id", F.when(F.col("image_id") != "i3", F.col("image_id")))
    moved = ng.jitter_boxes(g, 0.05)
    assert moved.columns == g.columns and hashes(ng.negative_counts(ng.good_boxes(moved), ng.Rule("refined"))) == 1
    crops = training.fabricate_training_set(g, ng.Rule("refined"))
    assert crops._jdf.queryExecution().optimizedPlan().toString().count("jitter") == 1
    u = hashing.uniforms(42, F.lit("jitter"), "image_id", "box_ord")
    for n in (1, 2, 3, 4):
        again = hashing.draw(hashing.start(42, F.lit("jitter"), "image_id"), F.col("box_ord"), n, lambda v: F.array(*v))
        assert all(r["a"] == r["b"] and len(r["a"]) == n for r in g.select(F.array(*u[:n]).alias("a"), again.alias("b")).collect())
    by_hand = g.withColumn("u", F.array(*u)).collect()
    for b, m in zip(sorted(by_hand, key=str), sorted(moved.collect(), key=str)):
        wide, cx = b["x2"] - b["x1"], (b["x1"] + b["x2"]) / 2 + (b["u"][0] * 0.1 - 0.05) * (b["x2"] - b["x1"])
        assert (m["x1"] + m["x2"]) / 2 == pytest.approx(cx) and m["x2"] - m["x1"] == pytest.approx(wide * (0.95 + b["u"][2] * 0.1))


def test_results_are_rounded_as_round_does(spark):
    from annospark.registry import draws

    values = [0.0, -0.0, 1.0000005, 1.0000015, -1.0000005, 2.5e-7, 5e-7, -5e-7, 4.999999e-7, 123.4567895, 639.9999995, 0.1 + 0.2, -3.14159265, 1e15 + 0.3, 1e300]
    values += [k / 7 for k in range(-50, 50)] + [k / 2**21 for k in range(200)] + [float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    pairs = rows.select(draws._rounded(F.col("v")).alias("a"), F.round("v", 6).alias("b")).collect()
    assert [repr(r["a"]) for r in pairs] == [repr(r["b"]) for r in pairs]
