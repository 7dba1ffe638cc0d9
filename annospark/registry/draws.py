"""Queries over seeds, splits, numbering and fabricated negatives."""

import math
import re

from pyspark.sql import functions as F

from annospark import fixtures as fx
from annospark.functions.geometry import Box
from annospark.operators import negatives as ng, order_stats, sampling
from annospark.plans import training
from annospark.registry import sql as q
from annospark.registry.base import register

SEED = 42


def _classes(t):
    return t.spark.range(5).select(F.col("id").cast("int").alias("cls"))


QUOTA = (
    "quota",
    """SELECT c::INT AS cls, CASE WHEN n > 0 THEN greatest(1, round_even(round(n*0.05::DOUBLE, 9), 0)) ELSE 0 END::BIGINT AS quota
      FROM range(5) r(c) LEFT JOIN (SELECT label, count(DISTINCT image_id) AS n FROM gold GROUP BY 1) ON label = c""",
)


@register("seed_quota", q.query("SELECT cls, quota FROM quota", QUOTA))
def seed_quota(t):
    return sampling.seed_quota(fx.with_centre(t.gold), _classes(t), percent=5.0)


DRAWN = (
    "drawn",
    f"""SELECT DISTINCT image_id FROM (SELECT image_id, label AS cls, row_number() OVER (PARTITION BY label
      ORDER BY {q.order_key(SEED, 'image_id')}, image_id) AS place FROM (SELECT DISTINCT image_id, label FROM gold))
      JOIN quota USING (cls) WHERE place <= quota""",
)


@register("draw_seed", q.query("SELECT image_id FROM drawn", QUOTA, DRAWN))
def draw_seed(t):
    gold = fx.with_centre(t.gold)
    return sampling.draw_seed(gold, sampling.seed_quota(gold, _classes(t), percent=5.0), SEED)


FLAT = ("quota", "SELECT c::INT AS cls, 3::BIGINT AS quota FROM range(5) r(c)")


@register("draw_seed_flat", q.query("SELECT image_id FROM drawn", FLAT, DRAWN))
def draw_seed_flat(t):
    gold = fx.with_centre(t.gold)
    return sampling.draw_seed(gold, sampling.seed_quota(gold, _classes(t), count=3), SEED)


HELD = [
    ("imgs", "SELECT DISTINCT image_id FROM human"),
    (
        "held",
        f"""SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY {q.order_key(SEED, 'image_id')}, image_id) AS i,
      count(*) OVER () AS n FROM imgs) WHERE i <= greatest(1, round_even(n*0.2::DOUBLE, 0))""",
    ),
]


@register(
    "holdout_split",
    q.query(
        "SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM held) THEN 'val' ELSE 'train' END AS split FROM imgs", HELD
    ),
)
def holdout_split(t):
    """All classes occur in the larger part here, so no image has to move back."""
    return sampling.holdout_split(fx.with_centre(t.human), 0.2, SEED)


RARE = [
    (
        "rare",
        """SELECT image_id, label AS cls FROM human UNION ALL SELECT image_id, (10 + image_id // 400)::INT FROM imgs WHERE image_id % 400 = 0
      UNION ALL SELECT image_id, (5000 + image_id // 400)::INT FROM imgs WHERE image_id % 400 = 0 UNION ALL SELECT image_id, (9000 + image_id // 1200)::INT FROM imgs WHERE image_id % 400 = 0""",
    ),
    (
        "lacking",
        """SELECT cls, row_number() OVER (ORDER BY cls) AS k, list(image_id ORDER BY image_id) AS images FROM (SELECT DISTINCT cls, image_id FROM rare
      WHERE image_id IN (SELECT image_id FROM held) AND cls NOT IN (SELECT cls FROM rare WHERE image_id NOT IN (SELECT image_id FROM held))) GROUP BY cls""",
    ),
    (
        "rescue(k, moved)",
        """SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT l.k, list_concat(r.moved, list_filter(l.images, lambda i: NOT list_contains(r.moved, i))[1:1])
      FROM rescue r JOIN lacking l ON l.k = r.k + 1""",
    ),
    ("back", "SELECT unnest(arg_max(moved, k)) AS image_id FROM rescue"),
]


@register(
    "holdout_split_rescued",
    q.query(
        """SELECT image_id, CASE WHEN image_id IN (SELECT image_id FROM held) AND image_id NOT IN (SELECT image_id FROM back) THEN 'val' ELSE 'train' END AS split FROM imgs""",
        [(name, sql.replace("n*0.2", "n*0.5")) for name, sql in HELD],
        RARE,
    ),
)
def holdout_split_rescued(t):
    """Half of the images are held out, among them the only ones of many rare classes, two of which share an image; each class gets one back."""
    boxes = fx.with_centre(t.human).select("image_id", "cls")
    some = boxes.select("image_id").distinct().where("image_id % 400 = 0")
    rare = F.explode(F.array(F.expr("10 + image_id div 400"), F.expr("5000 + image_id div 400"), F.expr("9000 + image_id div 1200")).cast("array<int>"))
    return sampling.holdout_split(boxes.unionByName(some.select("image_id", rare.alias("cls"))), 0.5, SEED)


@register(
    "stratified_split",
    q.query(
        f"""SELECT image_id, box_ord, cls, CASE WHEN place <= least(greatest(1, round_even(round(n*0.2::DOUBLE, 9), 0)), n-1) THEN 'val' ELSE 'train' END AS split
      FROM (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls
        ORDER BY {q.order_key(SEED, "concat(image_id, ':', box_ord)")}, concat(image_id, ':', box_ord)) AS place FROM gold_norm)"""
    ),
)
def stratified_split(t):
    rows = fx.with_centre(t.gold).withColumn("key", F.concat_ws(":", "image_id", "box_ord"))
    return sampling.stratified_split(rows, "key", "cls", 0.2, SEED).select("image_id", "box_ord", "cls", "split")


@register(
    "random_split",
    q.query(
        f"""SELECT image_id, CASE WHEN i <= floor(n*0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (SELECT image_id,
      row_number() OVER (ORDER BY {q.order_key(SEED, 'image_id')}, image_id) AS i, count(*) OVER () AS n FROM images)"""
    ),
)
def random_split(t):
    return sampling.random_split(t.images.select("image_id"), "image_id", 0.2, SEED)


@register("dense_ids", q.query("SELECT image_id, row_number() OVER (ORDER BY image_id) AS id FROM images"))
def dense_ids(t):
    return order_stats.dense_ids(t.images.select("image_id"), ["image_id"])


@register(
    "cap_crops",
    q.query(
        """SELECT image_id, box_ord FROM gold JOIN (SELECT image_id, sum(n) OVER (ORDER BY image_id) - n AS before FROM
      (SELECT image_id, count(*) AS n FROM gold GROUP BY 1)) USING (image_id) WHERE before < 2000"""
    ),
)
def cap_crops(t):
    return sampling.cap_crops(t.gold, 2000).select("image_id", "box_ord")


@register(
    "cap_crops_trimmed",
    q.query("SELECT image_id, box_ord FROM (SELECT *, row_number() OVER (ORDER BY image_id, box_ord) AS i FROM gold) WHERE i <= 2000"),
)
def cap_crops_trimmed(t):
    rows = t.gold.withColumn("crop_ord", F.col("box_ord"))
    return sampling.cap_crops(rows, 2000, trim=True).select("image_id", "box_ord")


# -- positives ----------------------------------------------------------------------------------
def _u(i, *keys):
    return q.uniform(i, SEED, *keys)


def _spread(u, low, high):
    return f"({low}::DOUBLE + {u} * ({high}::DOUBLE - {low}::DOUBLE))"


_J = [_spread(_u(i, "'jitter'", "image_id", "box_ord"), -0.05, 0.05) for i in range(4)]
JITTERED = [
    (
        "jit",
        f"""SELECT *, (x1+x2)/2 + {_J[0]}*(x2-x1) AS cx, (y1+y2)/2 + {_J[1]}*(y2-y1) AS cy, (x2-x1)*(1+{_J[2]})/2 AS hw,
      (y2-y1)*(1+{_J[3]})/2 AS hh FROM gold""",
    ),
    (
        "moved",
        """SELECT *, greatest(0.0::DOUBLE, cx-hw) AS a, greatest(0.0::DOUBLE, cy-hh) AS b, least(640.0::DOUBLE, cx+hw) AS c,
      least(480.0::DOUBLE, cy+hh) AS d FROM jit""",
    ),
    (
        "jittered",
        """SELECT image_id, box_ord, CASE WHEN ok THEN a ELSE x1 END AS x1, CASE WHEN ok THEN b ELSE y1 END AS y1,
      CASE WHEN ok THEN c ELSE x2 END AS x2, CASE WHEN ok THEN d ELSE y2 END AS y2
      FROM (SELECT *, c-a >= 2 AND d-b >= 2 AS ok FROM moved)""",
    ),
]
R6 = "round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2"


def _r6(df):
    return df.withColumns({c: _rounded(F.col(c)) for c in Box._fields})


def _rounded(value):
    """``round(value, 6)``, which goes through decimal text: only for what is near the middle of two results, very large or no number."""
    scaled = value * 1e6
    whole = F.floor(scaled)
    rest = scaled - whole
    plain = (F.abs(value) < 1e6) & (F.abs(rest - 0.5) > 1e-3)
    return F.when(plain, (whole + F.when(rest > 0.5, 1).otherwise(0)).cast("double") / 1e6).otherwise(F.round(value, 6))


@register("jitter_boxes", q.query(f"SELECT image_id, box_ord, {R6} FROM jittered", JITTERED))
def jitter_boxes(t):
    return _r6(ng.jitter_boxes(t.gold_sized, 0.05, SEED)).select("image_id", "box_ord", *Box._fields)


CLIPPED = """SELECT * FROM (SELECT image_id, box_ord, greatest(0.0::DOUBLE, least(x1, 640.0::DOUBLE)) AS x1,
      greatest(0.0::DOUBLE, least(y1, 480.0::DOUBLE)) AS y1, greatest(0.0::DOUBLE, least(x2, 640.0::DOUBLE)) AS x2,
      greatest(0.0::DOUBLE, least(y2, 480.0::DOUBLE)) AS y2 FROM {source}) WHERE x2-x1 >= 1 AND y2-y1 >= 1"""
WANTED = (
    "wanted",
    """SELECT image_id, n_good, n_noise, floor(n_noise*0.3::DOUBLE/(0.3::DOUBLE+0.3::DOUBLE))::BIGINT AS n_empty,
      {deviated} AS n_deviated FROM (SELECT image_id, count(*) AS n_good, floor(count(*)*(0.3::DOUBLE+0.3::DOUBLE)/0.4::DOUBLE)::BIGINT AS n_noise
      FROM good GROUP BY 1)""",
)


def _wanted(source="gold", deviated="n_noise - floor(n_noise*0.3::DOUBLE/(0.3::DOUBLE+0.3::DOUBLE))::BIGINT"):
    return [("good", CLIPPED.format(source=source)), (WANTED[0], WANTED[1].format(deviated=deviated))]


@register("good_boxes", q.query("SELECT image_id, box_ord, x1, y1, x2, y2 FROM good", ("good", CLIPPED.format(source="gold"))))
def good_boxes(t):
    return ng.good_boxes(t.gold_sized).select("image_id", "box_ord", *Box._fields)


@register("negative_counts", q.query("SELECT * FROM wanted", _wanted()))
def negative_counts(t):
    return ng.negative_counts(ng.good_boxes(t.gold_sized), ng.Rule())


# -- displaced boxes ----------------------------------------------------------------------------
KEY = ("image_id", "slot", "attempt")
GT = [
    ("gt", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_ord) - 1 AS gt_no, count(*) OVER (PARTITION BY image_id) AS n_gt FROM gold"),
]


def _deviated_sql(rule: ng.Rule, wanted, recheck=True, inclusive=None, polar=None):
    """Every slot makes all its attempts; the first acceptable one counts."""
    size = [_u(i, "'size'", *KEY) for i in range(2)]
    move = [_u(i, "'move'", *KEY) for i in range(4)]
    reject, at_limit = (rule.negative_iou_reject, True) if rule.refined else (rule.deviation_max_iou, False)
    if rule.refined if polar is None else polar:
        low, high = ng.shift_band(rule.deviation_shift)
        far, turn = _spread(move[0], low, high), f"({move[1]} * {2 * math.pi!r}::DOUBLE)"
        dx, dy = f"{far}*gw*cos({turn})", f"{far}*gh*sin({turn})"
    else:
        side = lambda u: f"(CASE WHEN {u} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"
        dx, dy = f"{side(move[0])}*{_spread(move[2], 0.5, 2.0)}*gw", f"{side(move[1])}*{_spread(move[3], 0.5, 2.0)}*gh"
    if inclusive is not None:
        at_limit = not inclusive
    again = " AND (x2-x1)*(y2-y1) >= least_area" if recheck else ""
    hit = f"{q.iou('f', 'g')} {'>=' if at_limit else '>'} {reject}"
    return [
        *wanted,
        *GT,
        (
            "slots",
            f"""SELECT w.image_id, slot, n_gt, floor({_u(0, "'pick'", 'w.image_id', 'slot')}*n_gt)::BIGINT AS gt_no
      FROM (SELECT image_id, unnest(range(n_deviated)) AS slot FROM wanted) w JOIN (SELECT DISTINCT image_id, n_gt FROM gt) USING (image_id)""",
        ),
        (
            "aimed",
            """SELECT s.image_id, s.slot, s.gt_no, g.x2-g.x1 AS gw, g.y2-g.y1 AS gh, (g.x1+g.x2)/2 AS gx, (g.y1+g.y2)/2 AS gy
      FROM slots s JOIN gt g ON g.image_id = s.image_id AND g.gt_no = s.gt_no""",
        ),
        (
            "tried",
            f"""SELECT image_id, slot, gt_no, attempt, gx + {dx} AS cx, gy + {dy} AS cy, gw*{_spread(size[0], 0.7, 1.3)} AS nw,
      gh*{_spread(size[1], 0.7, 1.3)} AS nh, gw*gh*0.7::DOUBLE AS least_area FROM aimed, range(100) r(attempt)""",
        ),
        (
            "placed",
            """SELECT *, greatest(0.0::DOUBLE, cx-nw/2) AS x1, greatest(0.0::DOUBLE, cy-nh/2) AS y1, least(640.0::DOUBLE, cx+nw/2) AS x2,
      least(480.0::DOUBLE, cy+nh/2) AS y2 FROM tried WHERE nw*nh >= least_area""",
        ),
        ("fitting", f"SELECT * FROM placed WHERE x2-x1 >= 10 AND y2-y1 >= 10{again}"),
        ("free", f"SELECT * FROM fitting f WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.image_id = f.image_id AND {hit})"),
        (
            "deviated",
            """SELECT image_id, slot, gt_no, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id, slot ORDER BY attempt) AS i
      FROM free) WHERE i = 1""",
        ),
    ]


def _deviated(t, rule, **kw):
    wanted = ng.negative_counts(ng.good_boxes(t.gold_sized), rule)
    return _r6(ng.fabricate_deviated(t.gold_sized, wanted, rule, SEED, **kw)).select("image_id", "slot", "gt_no", *Box._fields)


LIBRARY_REFINED = ng.Rule("refined")
DEVIATED_ROWS = f"SELECT image_id, slot, gt_no, {R6} FROM deviated"


@register("fabricate_deviated_baseline", q.query(DEVIATED_ROWS, _deviated_sql(ng.Rule(), _wanted())))
def fabricate_deviated_baseline(t):
    return _deviated(t, ng.Rule())


@register("fabricate_deviated_refined", q.query(DEVIATED_ROWS, _deviated_sql(LIBRARY_REFINED, _wanted())))
def fabricate_deviated_refined(t):
    return _deviated(t, LIBRARY_REFINED)


@register(
    "deviated_counts",
    q.query(
        """SELECT image_id, n_deviated AS wanted, coalesce(n, 0) AS made FROM wanted LEFT JOIN (SELECT image_id, count(*) AS n FROM deviated GROUP BY image_id) USING (image_id)""",
        _deviated_sql(LIBRARY_REFINED, _wanted()),
    ),
)
def deviated_counts(t):
    wanted = ng.negative_counts(ng.good_boxes(t.gold_sized), LIBRARY_REFINED)
    return ng.deviated_counts(wanted, ng.fabricate_deviated(t.gold_sized, wanted, LIBRARY_REFINED, SEED))


@register(
    "preview_deviated", q.query(DEVIATED_ROWS, _deviated_sql(ng.APP_RULE, _wanted(deviated="10::BIGINT"), recheck=False, inclusive=False))
)
def preview_deviated(t):
    """The review screen's form: ten per image, no second area check."""
    return _deviated(t, ng.APP_RULE, recheck_area=False, inclusive=False)


PREVIEW_BASELINE = ng.Rule(deviation_per_image=10)


@register(
    "preview_deviated_baseline",
    q.query(DEVIATED_ROWS, _deviated_sql(PREVIEW_BASELINE, _wanted(deviated="10::BIGINT"), recheck=False, inclusive=False, polar=True)),
)
def preview_deviated_baseline(t):
    """The review screen under the baseline rule moves boxes by band and angle all the same."""
    return _deviated(t, PREVIEW_BASELINE, recheck_area=False, inclusive=False, polar=True)


# -- background boxes ---------------------------------------------------------------------------
def _empty_sql(rule: ng.Rule, wanted):
    a = [_u(i, "'empty'", "image_id", "attempt") for i in range(4)]
    b = [_u(i, "'place'", "image_id", "attempt") for i in range(2)]
    if rule.refined:
        sized = f"""SELECT t.image_id, t.attempt, t.n_empty,
      greatest(2.0::DOUBLE, least(CASE WHEN g.image_id IS NOT NULL THEN (g.x2-g.x1)*{_spread('u2', 0.7, 1.3)} ELSE 50+floor(u2*191) END, 640.0::DOUBLE)) AS w,
      greatest(2.0::DOUBLE, least(CASE WHEN g.image_id IS NOT NULL THEN (g.y2-g.y1)*{_spread('u3', 0.7, 1.3)} ELSE 50+floor(u3*191) END, 480.0::DOUBLE)) AS h, px, py
      FROM tries t LEFT JOIN gt g ON g.image_id = t.image_id AND u0 < 0.5 AND g.gt_no = floor(u1*t.n_gt)"""
        placed = "SELECT *, px*greatest(0.0::DOUBLE, 640-w) AS x1, py*greatest(0.0::DOUBLE, 480-h) AS y1 FROM sized"
        keep, hit = "x2-x1 >= 2 AND y2-y1 >= 2", f"{q.iou('f', 'g')} >= 0.75"
    else:
        sized = "SELECT image_id, attempt, n_empty, 50+floor(u2*190) AS w, 50+floor(u3*190) AS h, px, py FROM tries"
        placed = "SELECT *, floor(px*greatest(1, 640-w)) AS x1, floor(py*greatest(1, 480-h)) AS y1 FROM sized"
        keep, hit = "true", f"{q.iou('f', 'g')} > 0.1"
    return [
        *wanted,
        *GT,
        (
            "tries",
            f"""SELECT image_id, attempt, n_empty, n_gt, {a[0]} AS u0, {a[1]} AS u1, {a[2]} AS u2, {a[3]} AS u3, {b[0]} AS px, {b[1]} AS py
      FROM (SELECT w.image_id, n_empty, n_gt, unnest(range(n_empty*50)) AS attempt FROM wanted w
        JOIN (SELECT DISTINCT image_id, n_gt FROM gt) USING (image_id))""",
        ),
        ("sized", sized),
        ("placed", placed),
        ("boxed", "SELECT *, least(640.0::DOUBLE, x1+w) AS x2, least(480.0::DOUBLE, y1+h) AS y2 FROM placed"),
        ("fitting", f"SELECT * FROM boxed WHERE {keep}"),
        ("free", f"SELECT * FROM fitting f WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.image_id = f.image_id AND {hit})"),
        (
            "empties",
            """SELECT image_id, attempt, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY attempt) AS i
      FROM free) WHERE i <= n_empty""",
        ),
    ]


EMPTY_ROWS = f"SELECT image_id, attempt, {R6} FROM empties"


def _empty(t, rule):
    wanted = ng.negative_counts(ng.good_boxes(t.gold_sized), rule)
    return _r6(ng.fabricate_empty(t.gold_sized, wanted, rule, SEED)).select("image_id", "attempt", *Box._fields)


@register("fabricate_empty_baseline", q.query(EMPTY_ROWS, _empty_sql(ng.Rule(), _wanted())))
def fabricate_empty_baseline(t):
    return _empty(t, ng.Rule())


@register("fabricate_empty_refined", q.query(EMPTY_ROWS, _empty_sql(LIBRARY_REFINED, _wanted())))
def fabricate_empty_refined(t):
    return _empty(t, LIBRARY_REFINED)


# -- training sets ------------------------------------------------------------------------------
def _training_parts(source):
    """All three kinds of crops; the steps of the background boxes get names of their own."""
    clash = re.compile(r"\b(sized|placed|boxed|fitting|free)\b")
    wanted = _wanted(source)
    empties = [(clash.sub(r"e_\1", n), clash.sub(r"e_\1", body)) for n, body in _empty_sql(LIBRARY_REFINED, [])[len(GT) :]]
    return [*(JITTERED if source == "jittered" else []), *_deviated_sql(LIBRARY_REFINED, wanted), *empties]


TRAINING_ROWS = f"""SELECT image_id, 'good' AS kind, box_ord AS crop_ord, 1::INT AS y, {R6} FROM good
      UNION ALL SELECT image_id, 'empty', attempt, 0, {R6} FROM empties UNION ALL SELECT image_id, 'deviated', slot, 0, {R6} FROM deviated"""


def _training_sql(source):
    return q.query(TRAINING_ROWS, *_training_parts(source))


@register("fabricate_training_set", _training_sql("jittered"))
def fabricate_training_set(t):
    return _r6(training.fabricate_training_set(t.gold_sized, LIBRARY_REFINED, SEED))


@register("fabricate_training_set_plain", _training_sql("gold"))
def fabricate_training_set_plain(t):
    """The form without jitter on the positives."""
    return _r6(training.fabricate_training_set(t.gold_sized, LIBRARY_REFINED, SEED, jitter=False))


@register(
    "crop_manifest",
    q.query(
        """SELECT kind, n, first FROM (SELECT label::VARCHAR AS kind, count(*) AS n FROM gold GROUP BY 1) JOIN (
      SELECT kind, string_agg(concat(image_id, ':', box_ord), ',' ORDER BY place) AS first FROM (SELECT label::VARCHAR AS kind, image_id, box_ord,
      row_number() OVER (PARTITION BY label ORDER BY image_id, box_ord) AS place FROM gold) WHERE place <= 24 GROUP BY 1) USING (kind)"""
    ),
)
def crop_manifest(t):
    """Counts and the first samples per kind; the class stands for the kind here."""
    crops = t.gold.select("image_id", F.col("box_ord").alias("crop_ord"), F.col("label").cast("string").alias("kind"))
    counts, samples = ng.crop_manifest(crops, 24)
    named = F.concat_ws(":", "image_id", "crop_ord")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", named.alias("s")))), lambda x: x["s"])
    return counts.join(samples.groupBy("kind").agg(F.array_join(listed, ",").alias("first")), "kind")


@register(
    "model_based_crops",
    q.query(
        """SELECT image_id, box_ord, CASE WHEN p_good > 0.7 THEN 1 ELSE 0 END AS y FROM candidates WHERE p_good > 0.7 OR p_good < 0.5"""
    ),
)
def model_based_crops(t):
    return ng.model_based_crops(t.candidates.withColumn("score", F.col("p_good"))).select("image_id", "box_ord", "y")


@register(
    "model_crops_fallback",
    q.query(
        f"""SELECT kind, y, count(*) AS n FROM ({TRAINING_ROWS}) GROUP BY 1, 2""",
        *_training_parts("gold"),
    ),
)
def model_crops_fallback(t):
    """Scores that leave no weak crop: the training set is made by rule instead."""
    scored = t.candidates.withColumn("score", F.col("p_good") / 4 + 0.75)
    crops = training.crops_from_scores(scored, t.gold_sized, LIBRARY_REFINED, SEED)
    return crops.groupBy("kind", "y").agg(F.count("*").alias("n"))


@register(
    "class_head_dataset",
    q.query(
        """SELECT * FROM (SELECT image_id, box_ord, cls, greatest(0, trunc((cx-w/2)*640)::INT) AS x1, greatest(0, trunc((cy-h/2)*480)::INT) AS y1,
      least(640, trunc((cx+w/2)*640)::INT) AS x2, least(480, trunc((cy+h/2)*480)::INT) AS y2 FROM gold_norm) WHERE x2-x1 >= 4 AND y2-y1 >= 4"""
    ),
)
def class_head_dataset(t):
    return training.class_head_dataset(fx.with_centre(t.gold), t.images)


# -- synthetic candidates -----------------------------------------------------------------------
_S = lambda k, i: _u(i, f"'{k}'", "image_id", "box_ord")
SYNTHETIC = f"""SELECT image_id, box_ord, {_S('at', 0)}*(CASE WHEN box_ord < 3 THEN 500 ELSE 560 END) AS x1,
      {_S('at', 1)}*(CASE WHEN box_ord < 3 THEN 500 ELSE 560 END) AS y1, floor({_S('at', 2)}*3)::INT AS label,
      CASE WHEN box_ord < 3 THEN {_spread(_S('score', 0), 0.4, 0.9)} ELSE {_spread(_S('score', 0), 0.05, 0.5)} END AS det_conf,
      CASE WHEN box_ord < 3 THEN {_spread(_S('score', 1), 0.7, 0.98)} ELSE {_spread(_S('score', 1), 0.05, 0.55)} END AS p_good
      FROM (SELECT image_id, unnest(range(3 + 4 + floor({_u(0, "'extra'", 'image_id')}*9)::BIGINT)) AS box_ord FROM images)"""


@register(
    "synthetic_candidates",
    q.query(
        "SELECT image_id, box_ord, round(x1, 6) AS x1, round(y1, 6) AS y1, label, round(det_conf, 6) AS det_conf, round(p_good, 6) AS p_good FROM s",
        ("s", SYNTHETIC),
    ),
)
def synthetic_candidates(t):
    from annospark.sources.synthetic import synthetic_candidates as build

    rows = build(t.images, 3, SEED)
    return rows.select("image_id", "box_ord", "label", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "det_conf", "p_good")])
