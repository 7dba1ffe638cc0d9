"""Training crops for the proposal validator, made from ground-truth boxes.

Positives are slightly jittered ground truth. Negatives are background boxes (``empty``) and displaced
ground truth (``deviated``). An ordinary image, or a slot of it, is one row with the image's ground truth, so attempts are
made and judged where they arise, and no more of them than needed. For large images rejection sampling runs as joins: attempts are rows, an attempt that
overlaps ground truth too much is removed by an anti join, and only open slots go to the next wave.
"""

from __future__ import annotations

import functools
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.functions.geometry import Box, between, box, clip_to, iou, named, touches
from annospark.functions.hashing import attempts, digest, draw, halves, let, spread, start, uniforms, words
from annospark.functions.scores import crop_label
from annospark.operators import hot_images
from annospark.operators.order_stats import numbered
from annospark.operators.overlap import overlapping_on
from annospark.session import cut_lineage, spread_out

# Attempts, size jitter and limits of the negative rules.
EMPTY_ATTEMPTS, DEVIATED_ATTEMPTS = 50, 100
SIZE_JITTER = (0.7, 1.3)
EMPTY_MIN_SIDE, EMPTY_OVER, SIMILAR_SHARE = 50, 0.1, 0.5
FAR_SHIFT = (0.5, 2.0)
MIN_SIDE = 10
BAND, BAND_FLOOR = 0.12, 0.05
SHIFT_RANGE, COUNT_RANGE = (0.1, 2.0), (1, 30)

# attempts per wave; nearly all slots are filled by the first
WAVES = ((0, 1), (1, 4), (4, 20), (20, DEVIATED_ATTEMPTS))  # most slots are filled by their first attempt
EMPTY_WAVES = (4, 16, EMPTY_ATTEMPTS * 1_000_000)  # the last one is limited by the budget
ROW_WAVES = (1, 4, 16, EMPTY_ATTEMPTS)  # attempts per wanted box where an image is one row


# The settings that a rule starts from.
@dataclass(frozen=True)
class Rule:
    """How negatives are drawn. The defaults are those of the library; see ``APP_RULE`` for the app's."""

    negative_rule: str = "baseline"
    good_crop_ratio: float = 0.4
    empty_crop_ratio: float = 0.3
    deviation_ratio: float = 0.3
    good_crop_jitter: float = 0.05
    deviation_max_iou: float = 0.25
    deviation_min_area_ratio: float = 0.7
    negative_iou_reject: float = 0.75
    deviation_shift: float = 0.80
    deviation_per_image: int = 0

    def __post_init__(self):
        if self.negative_rule not in ("baseline", "refined"):
            raise ValueError(f"unknown negative rule: {self.negative_rule}")
        whole = self.good_crop_ratio + self.empty_crop_ratio + self.deviation_ratio
        if whole != 0 and abs(whole - 1.0) >= 0.01:
            raise ValueError("crop ratios must sum to 1, or all be 0")

    @property
    def refined(self) -> bool:
        return self.negative_rule == "refined"


APP_RULE = Rule("refined", deviation_max_iou=0.10, deviation_per_image=10)


def shift_band(shift: float) -> tuple[float, float]:
    """The range of centre shifts a single shift setting stands for."""
    return max(BAND_FLOOR, shift - BAND), shift + BAND


def validate_rule(settings: dict | None, base: Rule = APP_RULE) -> Rule:
    """Posted settings over ``base``: unknown keys dropped, ratios rescaled, shift and count limited.

    Ratios that are no numbers, or sum to 0, ask for no crops by ratio at all.
    """
    known = asdict(base)
    merged = {**known, **{k: v for k, v in (settings or {}).items() if k in known}}

    def number(value, fallback):
        try:
            return float(value)
        except (TypeError, ValueError):
            return fallback

    names = ("good_crop_ratio", "empty_crop_ratio", "deviation_ratio")
    ratios = [number(merged[n], None) for n in names]
    if None in ratios:
        ratios = [0.0] * 3
    whole = sum(ratios) or 1.0
    merged.update({n: r / whole for n, r in zip(names, ratios)})
    if merged["negative_rule"] not in ("baseline", "refined"):
        merged["negative_rule"] = "baseline"
    shift = number(merged["deviation_shift"], base.deviation_shift)
    merged["deviation_shift"] = min(SHIFT_RANGE[1], max(SHIFT_RANGE[0], shift))
    count = round(number(merged["deviation_per_image"], base.deviation_per_image))
    merged["deviation_per_image"] = min(COUNT_RANGE[1], max(COUNT_RANGE[0], count))
    return replace(base, **merged)


# -- positives ----------------------------------------------------------------------------------
def jitter_boxes(boxes: DataFrame, jitter: float, seed: int = 42) -> DataFrame:
    """Move centre and size by up to ``jitter`` of the box; a result under 2 pixels is not used.

    ``boxes`` has pixel corners with the ``width`` and ``height`` of the image.
    """
    if jitter <= 0:
        return boxes
    # a digest, its numbers and the moved box are columns of their own, and the box comes out of a generator: no later filter or
    # step draws and moves it again
    drawn = boxes.withColumn("__digest", digest(seed, F.lit("jitter"), "image_id", "box_ord"))
    drawn = drawn.withColumns({f"__w{i}": w for i, w in enumerate(words(F.col("__digest")))})
    drawn = drawn.withColumns({f"__u{i}": u for i, u in enumerate([*halves(F.col("__w0")), *halves(F.col("__w1"))])})
    b, u = box(), [F.col(f"__u{i}") for i in range(4)]
    wide, high = b.x2 - b.x1, b.y2 - b.y1
    cx = (b.x1 + b.x2) / 2 + spread(u[0], -jitter, jitter) * wide
    cy = (b.y1 + b.y2) / 2 + spread(u[1], -jitter, jitter) * high
    half_w = wide * (1 + spread(u[2], -jitter, jitter)) / 2
    half_h = high * (1 + spread(u[3], -jitter, jitter)) / 2
    placed = drawn.withColumns({"__cx": cx, "__cy": cy, "__half_w": half_w, "__half_h": half_h})
    cx, cy, half_w, half_h = (F.col(c) for c in ("__cx", "__cy", "__half_w", "__half_h"))
    moved = Box(
        F.greatest(F.lit(0.0), cx - half_w),
        F.greatest(F.lit(0.0), cy - half_h),
        F.least(F.col("width").cast("double"), cx + half_w),
        F.least(F.col("height").cast("double"), cy + half_h),
    )
    placed = placed.withColumns({f"__{n}": c for n, c in zip(Box._fields, moved)})
    moved = Box(*(F.col(f"__{n}") for n in Box._fields))
    usable = (moved.x2 - moved.x1 >= 2) & (moved.y2 - moved.y1 >= 2)
    kept = F.struct(*[F.when(usable, new).otherwise(old).alias(f"__{n}") for n, new, old in zip(Box._fields, moved, b)])
    made = placed.select(*boxes.columns, F.inline(F.array(kept)))
    return made.select(*[F.col(f"__{c}").alias(c) if c in Box._fields else c for c in boxes.columns])


def good_boxes(boxes: DataFrame) -> DataFrame:
    """Ground truth clipped to the image, at least one pixel on each side."""
    c = clip_to(box(), F.col("width").cast("double"), F.col("height").cast("double"))
    clipped = boxes.withColumns(dict(zip(Box._fields, c)))
    return clipped.where((F.col("x2") - F.col("x1") >= 1) & (F.col("y2") - F.col("y1") >= 1))


def negative_counts(good: DataFrame, rule: Rule) -> DataFrame:
    """Per image: background and displaced boxes wanted, from the number of positives."""
    negative = rule.empty_crop_ratio + rule.deviation_ratio
    n_good = good.groupBy("image_id").agg(F.count("*").alias("n_good"))
    noise = F.floor(F.col("n_good") * F.lit(negative) / F.lit(rule.good_crop_ratio))
    counts = n_good.withColumn("n_noise", noise if rule.good_crop_ratio > 0 else F.lit(0).cast("long"))
    counts = counts.withColumn("n_empty", F.floor(F.col("n_noise") * F.lit(rule.empty_crop_ratio) / F.lit(negative or 1.0)))
    rest = F.lit(rule.deviation_per_image) if rule.deviation_per_image > 0 else F.col("n_noise") - F.col("n_empty")
    return counts.withColumn("n_deviated", rest.cast("long"))


# -- shared -------------------------------------------------------------------------------------
def _ground_truth(gold: DataFrame, hot_limit: int):
    """Ground truth with a running number per image, boxes per image with its size, and hot images."""
    hot = hot_images.find(gold, hot_limit)
    gt = numbered(gold.select("image_id", "box_ord", *Box._fields), "box_ord", "gt_no", hot)
    per_image = gold.groupBy("image_id").agg(
        F.count("*").alias("n_gt"), F.max("width").alias("width"), F.max("height").alias("height")
    )
    return gt, per_image, hot


def _in_rows(gold: DataFrame, wanted: DataFrame, number: str, hot_limit: int):
    """Ordinary images as rows with their ground truth in order, and what is wanted of the others (None when there are none)."""
    hot = hot_images.crowded(gold, hot_limit)
    wanted = wanted.where(F.col(number) > 0).select("image_id", number)
    many = F.col(number) > hot_limit
    small, large = gold, wanted.where(many)
    if hot is not None:
        small = gold.join(hot, "image_id", "left_anti")
        large = wanted.join(hot, "image_id", "left_semi").unionByName(large.join(hot, "image_id", "left_anti"))
    boxes = F.sort_array(F.collect_list(F.struct("box_ord", *Box._fields)))
    images = small.groupBy("image_id").agg(boxes.alias("gt"), F.max("width").alias("width"), F.max("height").alias("height"))
    rows = images.join(wanted.where(~many), "image_id")
    large = cut_lineage(large)
    return rows, large if large.limit(1).count() else None


def _meets_any(gt: Column, b: Box, limit: float, at_limit: bool) -> Column:
    """Some ground truth of the image overlaps a box by more than the limit (or, ``at_limit``, by the limit)."""

    def hit(g: Column) -> Column:
        other = Box(*(g[c] for c in Box._fields))
        value = iou(b, other)
        return touches(b, other) & ((value >= limit) if at_limit else (value > limit))

    return F.exists(gt, hit)


def _free_of(attempts_: DataFrame, gold: DataFrame, limit: float, at_limit: bool, key: str, hot) -> DataFrame:
    """Attempts that stay below (or, without ``at_limit``, up to) an overlap limit with all ground truth."""
    value = iou(box("a"), box("b"))
    hit = (value >= limit) if at_limit else (value > limit)
    if hot is None:
        a, b = box("a"), box("b")
        near = (F.col("a.image_id") == F.col("b.image_id")) & touches(a, b)
        return attempts_.alias("a").join(gold.select("image_id", *Box._fields).alias("b"), near & hit, "left_anti")
    tagged = cut_lineage(attempts_.withColumn("box_ord", F.col(key)))
    return tagged.join(overlapping_on(hot, tagged, gold, hit), ["image_id", "box_ord"], "left_anti").drop("box_ord")


# -- displaced ground truth ---------------------------------------------------------------------
def fabricate_deviated(
    gold: DataFrame,
    wanted: DataFrame,
    rule: Rule,
    seed: int = 42,
    recheck_area: bool = True,
    inclusive: bool | None = None,
    hot_limit: int = hot_images.HOT_IMAGE,
    polar: bool | None = None,
) -> DataFrame:
    """Displaced copies of ground-truth boxes, at most ``n_deviated`` per image.

    ``gold`` has pixel corners and the image size, ``wanted`` has ``(image_id, n_deviated)``. Each slot
    picks one ground-truth box and makes up to 100 attempts; the first acceptable one is used. The
    baseline rule accepts overlap at its limit, the refined rule does not (``inclusive`` overrides). The refined
    rule moves boxes by a distance in the shift band and an angle, the baseline by each side (``polar``
    overrides: a preview always uses band and angle).
    """
    polar, at_limit = rule.refined if polar is None else polar, rule.refined if inclusive is None else not inclusive
    limit = rule.negative_iou_reject if rule.refined else rule.deviation_max_iou
    rows, large = _in_rows(gold, wanted, "n_deviated", hot_limit)
    corners = lambda v: Box(*(v[c] for c in Box._fields))
    none = F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in Box._fields) + ">")
    slots = rows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_deviated") - 1)))
    picked = slots.withColumn("gt_no", F.floor(uniforms(seed, F.lit("pick"), "image_id", "slot")[0] * F.size("gt")))
    aimed = picked.withColumn("g", F.get("gt", F.col("gt_no").cast("int")))
    sides = dict(zip(("wide", "high", "mid_x", "mid_y"), _sides_and_middle(corners(F.col("g")))))
    aimed = aimed.withColumns(sides | {kind: start(seed, F.lit(kind), "image_id", "slot") for kind in ("size", "move")})
    wide, high, mid_x, mid_y, size, move = (F.col(c) for c in (*sides, "size", "move"))

    def judged(attempt: Column) -> Column:
        def moved(new, m):
            dx, dy = _shift(wide, high, m, rule, polar)
            return let(F.struct((mid_x + dx).alias("x"), (mid_y + dy).alias("y")), lambda c: placed(new, c))

        def placed(new, c):
            return let(F.struct(*named(_around(c["x"], c["y"], new["w"], new["h"]))), free)

        def free(v):
            return F.when(_fits(corners(v), wide, high, rule, recheck_area) & ~_meets_any(F.col("gt"), corners(v), limit, at_limit), v)

        def sized(u):
            new = F.struct(*[(n * spread(x, *SIZE_JITTER)).alias(c) for c, n, x in zip("wh", (wide, high), u)])
            least = wide * high * rule.deviation_min_area_ratio
            return let(new, lambda n: F.when(n["w"] * n["h"] >= least, draw(move, attempt, 2 if polar else 4, lambda m: moved(n, m))))

        return draw(size, attempt, 2, sized)

    def first(low, high):
        step = lambda found, attempt: F.when(found.isNotNull(), found).otherwise(judged(attempt))
        return F.aggregate(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")), none, step)

    # the first attempt fills most slots: as plain columns it is compiled, which functions inside arrays are not
    draws = {"size": 2, "move": 2 if polar else 4}
    tried = aimed.withColumns({f"{kind}_0": F.md5(F.concat(F.col(kind), F.lit("0"))) for kind in draws})
    tried = tried.withColumns({f"{kind}_{i}": w for kind, n in draws.items() for i, w in enumerate(words(F.col(f"{kind}_0"), n))})
    u, m = ([h for i in range(n // 2) for h in halves(F.col(f"{kind}_{i}"))] for kind, n in draws.items())
    dx, dy = _shift(wide, high, m, rule, polar)
    new = {"new_w": wide * spread(u[0], *SIZE_JITTER), "new_h": high * spread(u[1], *SIZE_JITTER), "cx": mid_x + dx, "cy": mid_y + dy}
    tried = tried.withColumns(new)
    tried = tried.withColumns(dict(zip(Box._fields, _around(*(F.col(c) for c in ("cx", "cy", "new_w", "new_h"))))))
    fits = (F.col("new_w") * F.col("new_h") >= wide * high * rule.deviation_min_area_ratio) & _fits(box(), wide, high, rule, recheck_area)
    tried = tried.withColumn("b", F.when(fits & ~_meets_any(F.col("gt"), box(), limit, at_limit), F.struct(*Box._fields)))

    chosen = F.filter(F.array(F.coalesce("b", *[first(*wave) for wave in WAVES[1:]])), lambda b: b.isNotNull())
    made = tried.select("image_id", "slot", "gt_no", F.inline(chosen))
    if large is None:
        return made
    some = gold.join(large, "image_id", "left_semi")
    return made.unionByName(_deviated_by_joins(some, large, rule, seed, recheck_area, at_limit, hot_limit, polar, limit))


def _deviated_by_joins(gold, wanted, rule, seed, recheck_area, at_limit, hot_limit, polar, limit) -> DataFrame:
    """Displaced boxes of images of any size."""
    gt, per_image, hot = _ground_truth(gold, hot_limit)
    slots = (
        wanted.where(F.col("n_deviated") > 0)
        .join(per_image, "image_id")
        .select(
            "image_id", "n_gt", "width", "height",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_deviated") - 1)).alias("slot"),
        )
        .withColumn("gt_no", F.floor(uniforms(seed, F.lit("pick"), "image_id", "slot")[0] * F.col("n_gt")))
        .join(gt.select("image_id", "gt_no", *[F.col(c).alias("g_" + c) for c in Box._fields]), ["image_id", "gt_no"])
        .drop("n_gt")
    )
    waiting, done = cut_lineage(slots), []
    for wave in WAVES:
        tries = _deviated_attempts(spread_out(waiting, "image_id", "slot"), rule, seed, wave, recheck_area, polar)
        good = _free_of(tries, gold, limit, at_limit, "try_no", hot)
        first = good.groupBy("image_id", "slot").agg(F.min_by(F.struct("gt_no", *Box._fields), "attempt").alias("b"))
        tried = cut_lineage(waiting.join(first, ["image_id", "slot"], "left"))
        done.append(tried.where("b IS NOT NULL").select("image_id", "slot", "b.*"))
        waiting = tried.where("b IS NULL").drop("b")
        if waiting.limit(1).count() == 0:
            break
    return functools.reduce(DataFrame.unionByName, done)


def deviated_counts(wanted: DataFrame, made: DataFrame) -> DataFrame:
    """``image_id, wanted, made`` of displaced boxes: an image crowded with boxes may leave slots open after all attempts."""
    n = made.groupBy("image_id").agg(F.count("*").alias("made"))
    rows = wanted.select("image_id", F.col("n_deviated").alias("wanted")).join(n, "image_id", "left")
    return rows.withColumn("made", F.coalesce("made", F.lit(0).cast("long")))


def _sides_and_middle(g: Box) -> tuple[Column, Column, Column, Column]:
    return g.x2 - g.x1, g.y2 - g.y1, (g.x1 + g.x2) / 2, (g.y1 + g.y2) / 2


def _shift(wide: Column, high: Column, move, rule: Rule, polar: bool) -> tuple[Column, Column]:
    """How far an attempt moves the centre, from its draws."""
    if polar:
        far, turn = spread(move[0], *shift_band(rule.deviation_shift)), move[1] * (2 * math.pi)
        return far * wide * F.cos(turn), far * high * F.sin(turn)
    side = lambda u: F.when(u < 0.5, -1.0).otherwise(1.0)
    return side(move[0]) * spread(move[2], *FAR_SHIFT) * wide, side(move[1]) * spread(move[3], *FAR_SHIFT) * high


def _around(cx: Column, cy: Column, new_w: Column, new_h: Column) -> Box:
    """A box around a centre, inside the image of ``width`` by ``height``."""
    return Box(
        F.greatest(F.lit(0.0), cx - new_w / 2),
        F.greatest(F.lit(0.0), cy - new_h / 2),
        F.least(F.col("width").cast("double"), cx + new_w / 2),
        F.least(F.col("height").cast("double"), cy + new_h / 2),
    )


def _fits(b: Box, wide: Column, high: Column, rule: Rule, recheck_area: bool) -> Column:
    """Whether a box made from one of ``wide`` by ``high`` is large enough where it ends at the edge of the image."""
    fits = (b.x2 - b.x1 >= MIN_SIDE) & (b.y2 - b.y1 >= MIN_SIDE)
    if recheck_area:
        fits = fits & ((b.x2 - b.x1) * (b.y2 - b.y1) >= wide * high * rule.deviation_min_area_ratio)
    return fits


def _deviated_box(g: Box, size, move, rule: Rule, recheck_area: bool, polar: bool) -> tuple[Box, Column]:
    """An attempt from its draws, and whether it is large enough. The image is ``width`` by ``height``."""
    wide, high, mid_x, mid_y = _sides_and_middle(g)
    dx, dy = _shift(wide, high, move, rule, polar)
    new_w, new_h = wide * spread(size[0], *SIZE_JITTER), high * spread(size[1], *SIZE_JITTER)
    b = _around(mid_x + dx, mid_y + dy, new_w, new_h)
    return b, (new_w * new_h >= wide * high * rule.deviation_min_area_ratio) & _fits(b, wide, high, rule, recheck_area)


def _deviated_attempts(slots: DataFrame, rule: Rule, seed: int, wave, recheck_area: bool, polar: bool) -> DataFrame:
    numbers = F.sequence(F.lit(wave[0]).cast("long"), F.lit(wave[1] - 1).cast("long"))
    draws = attempts(numbers, seed, ("size", "move"), "image_id", "slot")
    tries = slots.select("*", F.inline(draws))
    size, move = ([F.col("u")[i] for i in span] for span in (range(0, 4), range(4, 8)))
    g = Box(*(F.col("g_" + c) for c in Box._fields))
    b, fits = _deviated_box(g, size, move, rule, recheck_area, polar)
    tries = tries.withColumn("__fits", fits).withColumns(dict(zip(Box._fields, b))).where("__fits")
    # an attempt's number within its image; slots stay far below the factor
    return tries.select(
        "image_id", "slot", "gt_no", "attempt", *Box._fields, (F.col("slot") * DEVIATED_ATTEMPTS + F.col("attempt")).alias("try_no")
    )


# -- background boxes ---------------------------------------------------------------------------
def fabricate_empty(
    gold: DataFrame, wanted: DataFrame, rule: Rule, seed: int = 42, hot_limit: int = hot_images.HOT_IMAGE
) -> DataFrame:
    """Background boxes, at most ``n_empty`` per image out of ``50 n_empty`` attempts.

    The first acceptable attempts of an image are used. Waves make 4, 16 and then all remaining
    attempts per open box, so most images need one wave.
    """
    limit, at_limit = (rule.negative_iou_reject, True) if rule.refined else (EMPTY_OVER, False)
    rows, large = _in_rows(gold, wanted, "n_empty", hot_limit)
    starts = {kind: start(seed, F.lit(kind), "image_id") for kind in ("empty", "place")}
    rows = rows.withColumns(starts | dict(zip(("smallest", "largest"), _side_limits())))
    limits = (F.col("smallest"), F.col("largest"))

    def judged(attempt: Column) -> Column:
        def sized(a):
            both = lambda n: F.struct(*[c.alias(x) for c, x in zip(_empty_size(a, n, limits, rule), ("w", "h"))])
            if not rule.refined:
                return let(both(None), placed)
            g = F.when(a[0] < SIMILAR_SHARE, F.get("gt", F.floor(a[1] * F.size("gt")).cast("int")))
            near = let(g, lambda g: F.struct((g["x2"] - g["x1"]).alias("w"), (g["y2"] - g["y1"]).alias("h")))
            return let(near, lambda n: let(both(n), placed))

        def placed(v):
            return draw(F.col("place"), attempt, 2, lambda at: cornered(at, v))

        def cornered(at, v):
            corner = F.struct(*[c.alias(x) for c, x in zip(_empty_corner(at, v["w"], v["h"], rule), ("x", "y"))])
            return let(corner, lambda c: let(F.struct(attempt.alias("attempt"), *named(_empty_box(c["x"], c["y"], v["w"], v["h"]))), kept))

        def kept(v):
            b = Box(*(v[c] for c in Box._fields))
            return F.when(_empty_fits(b, rule) & ~_meets_any(F.col("gt"), b, limit, at_limit), v)

        return draw(F.col("empty"), attempt, 4, sized)

    filled, open_ = rows, F.size("b") < F.col("n_empty")
    for low, high in zip((0, *ROW_WAVES), ROW_WAVES):
        numbers = F.sequence(F.col("n_empty") * low, F.col("n_empty") * high - 1)
        more = F.filter(F.transform(numbers, judged), lambda b: b.isNotNull())
        filled = filled.withColumn("b", more if low == 0 else F.when(open_, F.concat("b", more)).otherwise(F.col("b")))
    made = filled.select("image_id", F.inline(F.slice("b", 1, F.col("n_empty").cast("int"))))
    if large is None:
        return made
    return made.unionByName(_empty_by_joins(gold.join(large, "image_id", "left_semi"), large, rule, seed, hot_limit))


def _empty_by_joins(gold: DataFrame, wanted: DataFrame, rule: Rule, seed: int, hot_limit: int) -> DataFrame:
    """Background boxes of images of any size."""
    gt, per_image, hot = _ground_truth(gold, hot_limit)
    waiting = (
        wanted.where(F.col("n_empty") > 0)
        .join(per_image, "image_id")
        .select(
            "image_id", "n_gt", "width", "height", F.col("n_empty").alias("open"), F.lit(0).cast("long").alias("next"),
            (F.col("n_empty") * EMPTY_ATTEMPTS).alias("budget"),
        )
    )
    waiting, done = cut_lineage(waiting), None
    limit, at_limit = (rule.negative_iou_reject, True) if rule.refined else (EMPTY_OVER, False)
    for per_open in EMPTY_WAVES:
        if waiting.limit(1).count() == 0:
            break
        upto = F.least(F.col("budget"), F.col("next") + per_open * F.col("open"))
        step = spread_out(waiting, "image_id").withColumn("upto", upto)
        numbers = F.sequence(F.col("next"), F.col("upto") - 1)
        tries = step.select("*", F.inline(attempts(numbers, seed, ("empty", "place"), "image_id")))
        boxes = _empty_attempts(tries, gt, rule)
        good = _free_of(boxes, gold, limit, at_limit, "attempt", hot)
        placed = numbered(good, "attempt", "place", hot_images.crowded(good, hot_limit))
        taken = cut_lineage(placed.where(F.col("place") < F.col("open")).select("image_id", "attempt", *Box._fields))
        done = taken if done is None else done.unionByName(taken)
        filled = taken.groupBy("image_id").agg(F.count("*").alias("filled"))
        rest = step.join(filled, "image_id", "left").withColumn("open", F.col("open") - F.coalesce("filled", F.lit(0)))
        rest = rest.withColumn("next", F.col("upto")).drop("upto", "filled")
        waiting = cut_lineage(rest.where((F.col("open") > 0) & (F.col("next") < F.col("budget"))))
    return done if done is not None else wanted.limit(0).select(
        "image_id", F.lit(0).cast("long").alias("attempt"), *[F.lit(0.0).alias(c) for c in Box._fields]
    )


def _empty_attempts(tries: DataFrame, gt: DataFrame, rule: Rule) -> DataFrame:
    a, b = ([F.col("u")[i] for i in span] for span in (range(0, 4), range(4, 8)))
    near = None
    if rule.refined:
        tries = tries.withColumn("gt_no", F.when(a[0] < SIMILAR_SHARE, F.floor(a[1] * F.col("n_gt"))))
        sides = F.struct((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
        tries = tries.join(gt.select("image_id", "gt_no", sides.alias("near")), ["image_id", "gt_no"], "left")
        near = F.col("near")
    sized = tries.withColumns(dict(zip(("w", "h"), _empty_size(a, near, _side_limits(), rule))))
    placed = sized.withColumns(dict(zip(("x", "y"), _empty_corner(b, F.col("w"), F.col("h"), rule))))
    placed = placed.withColumns(dict(zip(Box._fields, _empty_box(*(F.col(c) for c in ("x", "y", "w", "h"))))))
    return placed.where(_empty_fits(box(), rule)).select("image_id", "attempt", "open", *Box._fields)


def _side_limits() -> tuple[Column, Column]:
    """The smallest and the largest side of a background box in an image of ``width`` by ``height``."""
    largest = F.greatest(F.lit(2), F.floor(F.least("width", "height") / 2))
    return F.when(F.lit(EMPTY_MIN_SIDE) >= largest, F.greatest(F.lit(1), largest - 1)).otherwise(EMPTY_MIN_SIDE), largest


def _empty_size(a: list[Column], near: Column | None, limits, rule: Rule) -> tuple[Column, Column]:
    """Sides of an attempt in an image of ``width`` by ``height``; ``near`` has the sides of the box it is to resemble, if any."""
    width, height = F.col("width"), F.col("height")
    smallest, largest = limits
    if rule.refined:
        large = lambda u: smallest + F.floor(u * (largest - smallest + 1))
        side = lambda u, g, most: between(
            F.when(near["w"].isNotNull(), near[g] * spread(u, *SIZE_JITTER)).otherwise(large(u)).cast("double"), 2.0, most.cast("double")
        )
        return side(a[2], "w", width), side(a[3], "h", height)

    def side(u, frame):
        most = F.least(largest, frame)
        low = F.greatest(F.lit(1), F.when(most > 1, F.least(smallest, most - 1)).otherwise(1))
        return low + F.floor(u * (F.greatest(low + 1, most) - low))

    return side(a[2], width), side(a[3], height)


def _empty_corner(at: list[Column], w: Column, h: Column, rule: Rule) -> tuple[Column, Column]:
    frame = ((at[0], F.col("width") - w), (at[1], F.col("height") - h))
    if rule.refined:
        return tuple(u * F.greatest(F.lit(0.0), room) for u, room in frame)
    return tuple(F.floor(u * F.greatest(F.lit(1), room)).cast("double") for u, room in frame)


def _empty_box(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, F.least(F.col("width").cast("double"), x + w), F.least(F.col("height").cast("double"), y + h))


def _empty_fits(b: Box, rule: Rule) -> Column:
    return ((b.x2 - b.x1 >= 2) & (b.y2 - b.y1 >= 2)) if rule.refined else F.lit(True)


# -- from model scores --------------------------------------------------------------------------
def model_based_crops(scored: DataFrame) -> DataFrame:
    """Crops labelled by score: confident ones good, weak ones noise, the middle left out."""
    return scored.withColumn("y", crop_label(F.col("score"))).where(F.col("y").isNotNull())


def has_both_classes(crops: DataFrame) -> bool:
    row = crops.agg(F.count(F.when(F.col("y") == 1, 1)).alias("good"), F.count(F.when(F.col("y") == 0, 1)).alias("noise")).first()
    return row["good"] > 0 and row["noise"] > 0


def crop_manifest(crops: DataFrame, per_kind: int = 24) -> tuple[DataFrame, DataFrame]:
    """Crops per kind, and the first ``per_kind`` crops of each kind for review."""
    counts = crops.groupBy("kind").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy("image_id", "crop_ord")
    samples = crops.withColumn("place", F.row_number().over(order)).where(F.col("place") <= int(per_kind))
    return counts, samples
