import random

import pytest
from pyspark.sql import functions as F

from annospark.functions.geometry import box, containment, iou, nested
from annospark.operators import hot_images, matching, overlap
from tests import plain


def values(df, expr):
    return df.select(expr.alias("v")).first()["v"]


def pair(spark, a, b):
    row = tuple(map(float, (*a, *b)))
    names = [f"{c}_{s}" for s in "ab" for c in ("x1", "y1", "x2", "y2")]
    df = spark.createDataFrame([row], names)
    return df, box(suffix="_a"), box(suffix="_b")


def test_iou_and_containment(spark):
    df, a, b = pair(spark, (0, 0, 10, 10), (5, 0, 15, 10))
    assert values(df, iou(a, b)) == pytest.approx(50 / 150)
    df, a, b = pair(spark, (4, 4, 6, 6), (0, 0, 10, 10))
    assert values(df, containment(a, b)) == 1.0
    assert values(df, containment(b, a)) == pytest.approx(0.04)
    assert values(df, nested(b, a)) is True
    df, a, b = pair(spark, (1, 1, 1, 1), (1, 1, 1, 1))
    assert values(df, iou(a, b)) == 0.0


def kept(df):
    return {r["box_ord"] for r in df.collect()}


def test_nms_keeps_better_box(make_boxes):
    rows = [(0, 0, 100, 100, 0.5), (2, 2, 102, 102, 0.9)]
    assert kept(overlap.nms(make_boxes(rows), True)) == {1}


def test_nms_keeps_larger_of_nested(make_boxes):
    rows = [(40, 40, 60, 60, 0.95), (0, 0, 100, 100, 0.6)]
    assert kept(overlap.nms(make_boxes(rows), True)) == {1}
    assert kept(overlap.nms(make_boxes(rows), False)) == {0, 1}


def test_dedup_follows_decision(make_boxes):
    rows = [(0, 0, 100, 100), (40, 40, 60, 60), (1, 1, 101, 101)]
    assert kept(overlap.dedup(make_boxes(rows), True)) == {0}
    assert kept(overlap.dedup(make_boxes(rows), False)) == {0, 1}


def test_equal_scores_keep_list_order(make_boxes):
    rows = [(0, 0, 10, 10, 0.5), (0, 0, 10, 10, 0.5), (0, 0, 10, 10, 0.5)]
    assert kept(overlap.nms(make_boxes(rows), False)) == {0}


def test_containment_is_judged_at_once(make_boxes):
    """The middle box goes because of the outer one, the inner one because of both."""
    rows = [(0, 0, 100, 100), (0, 0, 60, 60), (0, 0, 30, 30)]
    assert kept(overlap.drop_contained(make_boxes(rows))) == {0}


def test_human_boxes_do_not_suppress(make_boxes):
    df = make_boxes([(0, 0, 100, 100), (40, 40, 60, 60)])
    assert kept(overlap.drop_contained(df, F.col("box_ord") == 1)) == {0, 1}


def test_merge_skips_taken_and_earlier(make_boxes):
    new = make_boxes([(0, 0, 10, 10), (50, 50, 60, 60), (50, 50, 60, 61), (90, 90, 99, 99)])
    assert kept(overlap.merge_proposals(make_boxes([(0, 0, 10, 11)]), new)) == {1, 3}


def crowd(seed, n, images=2):
    """Many boxes of mixed sizes in a small frame, with exact copies."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, y, s = rng.uniform(0, 120), rng.uniform(0, 120), rng.choice([8, 15, 30, 60])
        rows.append((x, y, x + s * rng.uniform(0.7, 1.3), y + s * rng.uniform(0.7, 1.3), rng.choice([0.2, rng.random()]), rng.randrange(2), f"i{rng.randrange(images)}"))
    return rows + rng.choices(rows, k=n // 3)


def by_image(rows):
    images = {}
    for i, r in enumerate(rows):
        images.setdefault(r[6], []).append((i, r))
    return images


@pytest.mark.parametrize("contain", [False, True])
@pytest.mark.parametrize("limit", [10**9, 20])
def test_nms_equals_plain_rule(make_boxes, contain, limit):
    """The array fold, and the block form for large images, against the rule in plain Python."""
    rows = crowd(7, 150)
    expected, evictions = set(), 0
    for group in by_image(rows).values():
        ordered = [(i, r[:4]) for i, r in sorted(group, key=lambda x: (-x[1][4], x[0]))]
        alive, gone = plain.suppressed(ordered, 0.45, contain)
        expected |= alive
        evictions += gone
    assert not contain or evictions > 10
    got = overlap.greedy(make_boxes(rows), -F.col("p_good"), 0.45, contain, hot_limit=limit, block=12)
    assert kept(got) == expected


def test_freed_boxes_in_large_images(make_boxes, monkeypatch):
    """An eviction frees a box that comes later but before the end of the block."""
    rows = [(0, 0, 20, 20, 0.9), (0, 0, 100, 19, 0.8), (1, 1, 22, 29, 0.7)] + [(200 + 30 * i, 0, 220 + 30 * i, 20, 0.6 - i / 100) for i in range(12)]
    ordered = [(i, r[:4]) for i, r in enumerate(rows)]
    expected, evictions = plain.suppressed(ordered, 0.45, True)
    assert evictions == 1 and 2 in expected
    for block in (1, 2, 5, 100):
        got = overlap.greedy(make_boxes(rows), -F.col("p_good"), 0.45, True, hot_limit=5, block=block)
        assert kept(got) == expected


def test_copies_in_large_images(make_boxes):
    rows = [(0, 0, 10, 10, 0.5)] * 400 + [(100, 100, 130, 130, 0.4)] * 300
    assert kept(overlap.greedy(make_boxes(rows), -F.col("p_good"), 0.45, False, hot_limit=50, block=20)) == {0, 400}


def test_grid_finds_the_same_pairs(make_boxes):
    df = make_boxes(crowd(3, 120))
    columns = [F.col("a.box_ord").alias("p"), F.col("b.box_ord").alias("q")]
    condition = iou(box("a"), box("b")) > 0.2
    small = overlap.self_pairs(df, condition, columns, hot_limit=10**9)
    grid = overlap.self_pairs(df, condition, columns, hot_limit=10)
    assert small.count() > 50
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, grid.collect()))
    for limit in (10**9, 10):
        gone = kept(df) - kept(overlap.drop_contained(df, hot_limit=limit))
        rows = crowd(3, 120)
        expected = {
            i for g in by_image(rows).values() for i, a in g if any(plain.area(b) > plain.area(a) and plain.inside(a, b) >= 0.8 for _, b in g)
        }
        assert gone == expected


@pytest.mark.parametrize("limit", [10**9, 5])
def test_match_equals_plain_rule(make_boxes, limit):
    pred, gold = crowd(11, 80), crowd(12, 80)
    got = matching.match_boxes(make_boxes(pred), make_boxes(gold), 0.1, hot_limit=limit)
    expected, groups = set(), by_image(gold)
    for image, group in by_image(pred).items():
        p = {i: r[:4] for i, r in group}
        g = {i: r[:4] for i, r in groups.get(image, [])}
        expected |= plain.matched(p, g, 0.1)
    assert {(r["pi"], r["gi"]) for r in got.collect()} == expected


def test_many_copies_on_both_sides(make_boxes):
    """Copies pair up from the last position down; groups, not copies, are paired."""
    pred = make_boxes([(0, 0, 10, 10)] * 300 + [(0, 0, 10, 9)] * 50)
    gold = make_boxes([(0, 0, 10, 10)] * 280 + [(50, 50, 60, 60)] * 5)
    got = {(r["pi"], r["gi"]) for r in matching.match_boxes(pred, gold, 0.5, hot_limit=10).collect()}
    assert got == {(299 - k, 279 - k) for k in range(280)}


@pytest.mark.parametrize("class_aware", [False, True])
def test_cuts_and_limits_in_large_images(make_boxes, class_aware):
    pred = make_boxes(crowd(21, 40)).withColumn("score", F.col("p_good"))
    gold = make_boxes(crowd(22, 40))
    if class_aware:
        both = [matching.match_at_limits(pred, gold, (0.1, 0.3), hot_limit=n) for n in (10**9, 5)]
    else:
        both = [matching.match_at_cuts(pred, gold, (0.1, 0.6), 0.1, hot_limit=n) for n in (10**9, 5)]
    a, b = (sorted(tuple(r) for r in df.select(*sorted(both[0].columns)).collect()) for df in both)
    assert a and a == b


def test_match_ties_fall_to_later_positions(make_boxes):
    pred = make_boxes([(0, 0, 10, 10), (0, 0, 10, 10)])
    gold = make_boxes([(0, 0, 10, 10), (0, 0, 10, 10), (0, 0, 10, 10)])
    for limit in (100, 1):
        got = matching.match_boxes(pred, gold, 0.5, hot_limit=limit)
        assert {(r["pi"], r["gi"]) for r in got.collect()} == {(1, 2), (0, 1)}


def test_result_does_not_depend_on_partitions(spark, make_boxes):
    rows = crowd(5, 100, images=9)
    a, b = make_boxes(rows).repartition(13), make_boxes(rows).coalesce(1)
    assert kept(overlap.nms(a, True)) == kept(overlap.nms(b, True))


def test_hot_images_are_found_by_count(make_boxes):
    df = make_boxes(crowd(2, 40, images=2))
    assert hot_images.find(df, 10**6) is None
    assert hot_images.find(df, 5).count() == 2


@pytest.mark.parametrize("contain", [False, True])
def test_sliding_boxes_take_few_rounds(make_boxes, monkeypatch, contain):
    """Every box waits for the one before it; the chain is followed tile by tile, not box by box."""
    rows = [(3 * i, i % 3, 3 * i + 10, 10 + i % 3, 0.9) for i in range(5000)]
    written, cut = [], overlap.cut_lineage
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: written.append(1) or cut(df))
    got = kept(overlap.greedy(make_boxes(rows), F.lit(0.0), 0.45, contain))
    alive = []
    for i, r in enumerate(rows):  # a box meets only its near neighbours
        if not any(plain.iou(r[:4], rows[k][:4]) > 0.45 for k in alive[-4:]):
            alive.append(i)
    assert got == set(alive) and 1000 < len(got) < 4000
    assert len(written) <= 20


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_boxes_across_tiles(make_boxes, seed):
    """Small boxes in large ones of later rank: evictions reach from tile to tile and undo what blocked others."""
    rng = random.Random(seed)
    rows = []
    for _ in range(90):
        x, y, s = rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([4, 6, 9, 14, 22, 35])
        rows.append((x, y, x + s, y + s * rng.uniform(0.8, 1.2), rng.random() / s))
    ordered = sorted(((i, r[:4]) for i, r in enumerate(rows)), key=lambda x: (-rows[x[0]][4], x[0]))
    expected, evictions = plain.suppressed(ordered, 0.3, True)
    assert evictions > 5
    for block in (3, 9):
        got = overlap.greedy(make_boxes(rows), -F.col("p_good"), 0.3, True, hot_limit=5, block=block)
        assert kept(got) == expected


def test_tied_groups_are_matched_at_once(make_boxes, monkeypatch):
    """A thousand copies tie with two groups: the k-th goes with the k-th, whatever group that is of."""
    from annospark.operators import match_copies, order_stats

    pred = [(0, 0, 10, 10)] * 1000
    gold = [(0, 0, 10, 8), (0, 2, 10, 10), (0, 2, 10, 10)] * 200
    written = []
    for module in (match_copies, order_stats, hot_images):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: written.append(1) or cut(df))
    got = matching.match_boxes(make_boxes(pred), make_boxes(gold), 0.5, hot_limit=10)
    assert {(r["pi"], r["gi"]) for r in got.collect()} == {(999 - k, 599 - k) for k in range(600)}
    assert len(written) <= 12


@pytest.mark.parametrize("seed", [3, 4])
def test_plateaus_with_and_without_gaps(make_boxes, seed):
    """Copies of a few boxes on a grid, where many overlaps are equal."""
    rng = random.Random(seed)
    some = lambda n: [(x, y, x + 4, y + 4) for x, y in ((rng.choice([0, 1, 2, 3]), rng.choice([0, 1, 20])) for _ in range(n))]
    pred, gold = some(40), some(40)
    got = matching.match_boxes(make_boxes(pred), make_boxes(gold), 0.2, hot_limit=3)
    assert {(r["pi"], r["gi"]) for r in got.collect()} == plain.matched(dict(enumerate(pred)), dict(enumerate(gold)), 0.2)
