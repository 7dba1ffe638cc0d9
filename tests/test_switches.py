"""Both sides of every switch on size give one result, with null keys, NaN, ties and copies; refusals are errors."""

import pytest
from pyspark.sql import functions as F

from annospark.operators import acceptance as ac, order_stats as os_, sampling
from annospark.operators.overlap import LEAST_OVER, greedy
from annospark.plans import training
from annospark.session import shared_dir
from annospark.sinks import exports
from annospark.sources import labels, overlay
from annospark.streaming import events as ev


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


KEYED = [(None, 1, 2), (None, 2, 3), ("a", 1, 5), ("a", 1, 7), ("b", None, 1), ("a", 3, 1)]


@pytest.mark.parametrize("largest", [False, True])
def test_running_totals_with_null_keys(spark, monkeypatch, largest):
    df = spark.createDataFrame(KEYED, "k string, o int, v long")
    plain = rows_of(os_.running(df, ["o", "v"], {"t": F.col("v")}, ["k"], largest))
    monkeypatch.setattr(os_, "ONE_TASK", 0)
    assert rows_of(os_.running(df, ["o", "v"], {"t": F.col("v")}, ["k"], largest)) == plain
    assert len(plain) == len(KEYED)


def test_stratified_split_with_a_null_class(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "key long, cls int")
    plain = rows_of(sampling.stratified_split(df, "key", "cls"))
    monkeypatch.setattr(os_, "ONE_TASK", 0)
    assert rows_of(sampling.stratified_split(df, "key", "cls")) == plain and len(plain) == 60
    assert {r[2] for r in plain if r[1] is None} == {"train", "val"}


@pytest.fixture
def scored(spark):
    nan = float("nan")
    rows = [(f"i{i % 3}", i, [nan, None, 0.9, 0.2, 0.9, 0.7][i % 6]) for i in range(120)] + [(None, i, 0.5) for i in range(30)]
    return spark.createDataFrame(rows, "image_id string, box_ord long, score double").withColumns({"p_good": F.col("score"), "det_conf": F.col("score")})


@pytest.mark.parametrize("bound", [1, 4, 35])
def test_ranking_beyond_the_group_limit(scored, monkeypatch, bound):
    plain = rows_of(ac.ranked(scored, bound))
    monkeypatch.setattr(ac, "GROUP_LIMIT", 0)
    assert rows_of(ac.ranked(scored, bound)) == plain
    monkeypatch.setattr(os_, "ONE_TASK", 0)
    assert rows_of(ac.ranked(scored, bound)) == plain
    assert all(r[2] is not None and r[2] == r[2] for r in plain)


def test_broken_scores_are_never_accepted(scored):
    for got in (ac.at_least(scored, 0.0), ac.rate(scored, 1.0)[0], ac.fold_gate(scored, 0.1), ac.cap_per_image(scored, 500), ac.ranked(scored, 500)):
        assert got.where("score IS NULL OR isnan(score)").count() == 0 and got.count() > 0
    assert ac.rate(scored, 1.0)[0].count() == scored.where("score IS NOT NULL AND NOT isnan(score)").count()
    assert ac.score_mass(scored).where("isnan(mass)").count() == 0


@pytest.mark.parametrize("over", [0.1, 0.3, 0.45])
@pytest.mark.parametrize("contain", [False, True])
def test_low_overlap_limits_on_hot_images(spark, make_boxes, over, contain):
    rows = [((i * 37) % 200, (i * 53) % 150, (i * 37) % 200 + 20 + i % 60, (i * 53) % 150 + 20 + (i * 7) % 50, (i % 9) / 10) for i in range(60)]
    boxes = make_boxes(rows + rows[:5])
    rank = -F.col("p_good")
    small = rows_of(greedy(boxes, rank, over, contain, hot_limit=None).select("box_ord"))
    assert rows_of(greedy(boxes, rank, over, contain, hot_limit=0, block=7).select("box_ord")) == small
    for limit in (None, 0):
        with pytest.raises(ValueError):
            greedy(boxes, rank, LEAST_OVER / 2, contain, hot_limit=limit)


def test_scratch_space_must_be_shared():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_rounds_are_not_cut_in_silence(spark):
    with pytest.raises(ValueError, match="rounds"):
        training.self_training_cycle(None, None, None, None, None, rounds=11)


def test_label_files_round_trip_odd_names(spark, tmp_path):
    stems = ["a#1", "50%", "x=1", "q:2", "b c", "p+q", "ü", "100%25"]
    df = spark.createDataFrame([(s, 0, 1, 0.5, 0.5, 0.25, 0.25) for s in stems], "stem string, box_ord int, cls int, cx double, cy double, w double, h double")
    images = df.select(F.concat("stem", F.lit(".jpg")).alias("image_id"), "stem")
    exports.write_labels(images, df, str(tmp_path / "out"))
    back = labels.read_labels(spark, str(tmp_path / "out"))
    assert sorted(r["stem"] for r in back.collect()) == sorted(stems)
    assert sorted(r["stem"] for r in labels.label_files(spark, str(tmp_path / "out")).collect()) == sorted(stems)


@pytest.mark.parametrize("text,owners", [("not json\n{broken\n", 2), ("", 0), ('{"image_id": "a.jpg"}\nnot json\n', 1)])
def test_unreadable_ownership_protects_every_label(spark, tmp_path, text, owners):
    (tmp_path / "own.json").write_text(text)
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "image_id string")
    files = spark.createDataFrame([("a",), ("b",)], "stem string")
    assert labels.read_ownership(spark, str(tmp_path / "own.json"), images, files, "lines").count() == owners


def test_malformed_events_keep_their_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.jsonl").write_text('{"ts_ms": 5, "session_id": "s", "event_type": "undo"}\n\n{"ts_ms": broken\n{"ts_ms": 6, "event_type": "dance"}\n')
    rows = overlay.read_events(spark, str(tmp_path / "in")).cache()  # a file scan of the broken text alone is not allowed
    assert ev.valid(rows).count() == 1 and ev.quarantined(rows).count() == 2
    ev.log_events(ev.stream_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    kept = spark.read.json(str(tmp_path / "out" / "quarantine"))
    assert {r["line"] for r in kept.collect()} == {None, '{"ts_ms": broken'}
    assert spark.read.json(str(tmp_path / "out" / "valid")).count() == 1


def test_rounds_on_a_large_image_stay_few(spark, monkeypatch):
    """3,000 overlapping boxes with 1,000 copies among them: the rounds follow chains of better boxes, not the boxes."""
    from annospark.operators import overlap

    rounds = []
    plain = overlap.cut_lineage
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    place = lambda i: ((i * 7919) % 1900, (i * 104729) % 1400)
    rows = [(1, i, *map(float, (*place(i % 2000), place(i % 2000)[0] + 60 + i % 2000 % 40, place(i % 2000)[1] + 60)), 0, (i * 6151 % 997) / 997) for i in range(3000)]
    boxes = spark.createDataFrame(rows, "image_id long, box_ord long, x1 double, y1 double, x2 double, y2 double, label int, p_good double")
    got = rows_of(greedy(boxes, -F.col("p_good"), 0.45, False, hot_limit=100).select("box_ord"))
    assert len(rounds) <= 40
    assert got == rows_of(greedy(boxes, -F.col("p_good"), 0.45, False, hot_limit=None).select("box_ord"))


def test_a_box_is_entered_in_few_cells(spark):
    """Tiny boxes among boxes of the whole image, and large boxes only: few rows for each box, and the same pairs."""
    from annospark.operators import hot_images
    from annospark.operators.overlap import self_pairs
    from annospark.functions.geometry import box, iou

    tiny = [(1, i, float(i % 50 * 20), float(i // 50 * 20), i % 50 * 20 + 15.0, i // 50 * 20 + 15.0) for i in range(1500)]
    whole = [(1, 1500 + i, 0.0, float(i), 1000.0, 600.0 + i) for i in range(6)]
    large = [(2, i, float(i % 7), float(i % 11), 900.0 + i % 5, 500.0 + i % 3) for i in range(200)]
    df = spark.createDataFrame(tiny + whole + large, "image_id long, box_ord long, x1 double, y1 double, x2 double, y2 double")
    hot = hot_images.find(df, 50)
    for side in ("a", "b"):
        assert hot_images.cells(df, hot, side).count() <= 30 * df.count()
    over = iou(box("a"), box("b")) > 0.0001
    names = [F.col("a.box_ord").alias("p"), F.col("b.box_ord").alias("q")]
    assert rows_of(self_pairs(df, over, names, False, 50)) == rows_of(self_pairs(df, over, names, False, None))
