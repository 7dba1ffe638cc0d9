"""Queries over the seed and the acceptance policies."""

import functools
import uuid

from pyspark.sql import functions as F

from annospark.functions.scores import bin_of
from annospark.operators import acceptance as ac, density, order_stats, status
from annospark.plans import automate, study, training
from annospark.registry import sql as q
from annospark.registry.base import register
from annospark.session import shared_dir

KEY = ("image_id", "box_ord")


@register("seed_density", q.query("SELECT n_images, total_boxes, mean_count, median_count, p90_count, true AS reliable FROM seed"))
def seed_density(t):
    return density.seed_density(density.seed_counts(t.human), 1, 1)


@register(
    "seed_density_all_images",
    q.query(
        """SELECT count(*) AS n_images, sum(n)::BIGINT AS total_boxes, avg(n) AS mean_count, median(n) AS median_count,
      (SELECT max(n)::DOUBLE FROM s WHERE i = round_even(0.9::DOUBLE*(c-1), 0)) AS p90_count, true AS reliable FROM s""",
        ("h", "SELECT o.image_id, count(g.image_id) AS n FROM owned o LEFT JOIN gold g ON g.image_id = o.image_id GROUP BY o.image_id"),
        ("s", "SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM h"),
    ),
)
def seed_density_all_images(t):
    """The library form: seed images without a box count as zero."""
    return density.seed_density(density.seed_counts(t.human, t.ownership), 2, 3)


@register(
    "adaptive_decision",
    q.query(
        """SELECT containment, max_topk, round_even(frac, 4) AS nest_frac, round_even(mean, 2) AS seed_mean FROM decision, decision_raw"""
    ),
)
def adaptive_decision(t):
    return density.adaptive_decision(t.human)


@register("accept_threshold", q.query("SELECT image_id, box_ord FROM candidates WHERE p_good >= 0.5"))
def accept_threshold(t):
    return ac.fixed(ac.with_score(t.candidates), 0.5)[0].select(*KEY)


@register("accept_confidence", q.query("SELECT image_id, box_ord FROM candidates WHERE det_conf >= 0.75"))
def accept_confidence(t):
    return ac.fixed(ac.with_score(t.candidates, "confidence"), 0.75)[0].select(*KEY)


@register(
    "accept_manual",
    q.query("SELECT image_id, box_ord FROM candidates WHERE det_conf >= 0.6 AND image_id NOT IN (SELECT image_id FROM owned)"),
)
def accept_manual(t):
    return ac.manual(t.candidates, t.ownership, "det_conf", 0.6).select(*KEY)


RANKED = "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p_good DESC, box_ord) AS rk FROM pool WHERE p_good >= 0.05"


@register(
    "accept_topk",
    q.query(
        """SELECT image_id, box_ord FROM ranked WHERE rk <= (SELECT greatest(1, least(100, round_even(median_count, 0))) FROM seed)""",
        ("ranked", RANKED),
    ),
)
def accept_topk(t):
    return ac.top_k(t.pool, t.seed)[0].select(*KEY)


# scores as a broken model leaves them: every 7th candidate of the pool NaN, every 11th null
BROKEN = "SELECT image_id, box_ord, CASE WHEN (image_id+box_ord) % 7 = 0 THEN 'NaN'::DOUBLE WHEN (image_id+box_ord) % 11 = 0 THEN NULL ELSE p_good END AS s FROM pool"
SOUND = "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, box_ord) AS rk, row_number() OVER (ORDER BY s DESC) AS i, count(*) OVER () AS c FROM broken WHERE s IS NOT NULL AND NOT isnan(s)"


def _broken(t):
    place = F.col("image_id") + F.col("box_ord")
    score = F.when(place % 7 == 0, F.lit(float("nan"))).when(place % 11 != 0, F.col("p_good"))
    return t.pool.withColumns({"score": score, "p_good": score})


def _sound(rows: str, *more):
    return q.query(rows, ("broken", BROKEN), ("sound", SOUND), *more)


@register("accept_threshold_nan", _sound("SELECT image_id, box_ord FROM sound WHERE s >= 0.5"))
def accept_threshold_nan(t):
    return ac.fixed(_broken(t), 0.5)[0].select(*KEY)


@register(
    "accept_topk_nan",
    _sound("SELECT image_id, box_ord FROM sound WHERE s >= 0.05 AND rk <= (SELECT greatest(1, least(100, round_even(median_count, 0))) FROM seed)"),
)
def accept_topk_nan(t):
    return ac.top_k(_broken(t), t.seed)[0].select(*KEY)


@register("accept_topk_wide", q.query("SELECT image_id, box_ord, rk::INT AS place FROM ranked WHERE rk <= 1500", ("ranked", RANKED)))
def accept_topk_wide(t):
    """A bound beyond what the group limit covers."""
    return ac.ranked(ac.at_least(t.pool, 0.05), 1500).select(*KEY, "place")


@register("accept_rate_nan", _sound("SELECT image_id, box_ord FROM sound WHERE s >= greatest(0.05, (SELECT max(s) FROM sound WHERE i = greatest(1, round_even(0.5::DOUBLE*c, 0))))"))
def accept_rate_nan(t):
    return ac.rate(_broken(t), 0.5)[0].select(*KEY)


@register(
    "accept_global_tau_nan",
    _sound(
        """SELECT image_id, box_ord FROM sound WHERE s >= (SELECT CASE WHEN k >= c THEN 0.05 ELSE greatest(0.05, tau) END FROM (SELECT max(c) AS c,
      max(k) AS k, max(s) FILTER (i = k) AS tau FROM sound, (SELECT round_even((SELECT mean_count FROM seed) * count(DISTINCT image_id), 0) AS k FROM broken)))"""
    ),
)
def accept_global_tau_nan(t):
    return ac.global_tau(_broken(t), t.seed)[0].select(*KEY)


@register("fold_gate_nan", _sound("SELECT image_id, box_ord FROM sound WHERE s >= (SELECT min(s) FROM sound WHERE i <= c - floor(0.4::DOUBLE*c))"))
def fold_gate_nan(t):
    return ac.fold_gate(_broken(t), 0.4).select(*KEY)


BUDGET = """SELECT image_id, greatest(1, least(100, round_even(round((SELECT mean_count FROM seed)
      * (r / (SELECT avg(r) FROM mass)), 9), 0))) AS k FROM mass"""
MASS = "SELECT image_id, sum(greatest(p_good, 0)) AS r FROM pool GROUP BY image_id"


@register("score_mass", q.query("SELECT image_id, round(r, 6) AS mass FROM mass", ("mass", MASS)))
def score_mass(t):
    return ac.score_mass(t.pool).withColumn("mass", F.round("mass", 6))


@register(
    "image_budgets", q.query("SELECT image_id, k::BIGINT AS k FROM budget", ("mass", MASS), ("budget", BUDGET))
)
def image_budgets(t):
    return ac.image_budgets(t.pool, t.seed.mean)


@register(
    "accept_adaptive_k",
    q.query(
        "SELECT image_id, box_ord FROM ranked JOIN budget USING (image_id) WHERE rk <= k",
        ("mass", MASS),
        ("budget", BUDGET),
        ("ranked", RANKED),
    ),
)
def accept_adaptive_k(t):
    return ac.adaptive_k(t.pool, t.seed)[0].select(*KEY)


TARGET = "SELECT round_even((SELECT mean_count FROM seed) * count(DISTINCT image_id), 0) AS k FROM pool"
DESC = "SELECT p_good, row_number() OVER (ORDER BY p_good DESC) AS i, count(*) OVER () AS c FROM pool"


@register(
    "accept_global_tau",
    q.query(
        """SELECT image_id, box_ord FROM pool WHERE p_good >= greatest(0.05, (SELECT max(p_good) FROM ordered, target WHERE i = k))""",
        ("target", TARGET),
        ("ordered", DESC),
    ),
)
def accept_global_tau(t):
    return ac.global_tau(t.pool, t.seed)[0].select(*KEY)


@register(
    "kth_largest",
    q.query(
        """SELECT c // 3 AS k, p_good AS value FROM (SELECT p_good, row_number() OVER (ORDER BY p_good DESC) AS i, count(*) OVER () AS c
      FROM candidates) WHERE i = c // 3"""
    ),
)
def kth_largest(t):
    k = t.candidates.count() // 3
    value = order_stats.kth_largest(t.candidates, "p_good", k)
    return t.candidates.agg(F.first(F.lit(k)).cast("long").alias("k"), F.first(F.lit(value)).alias("value"))


OTSU = [
    ("bins", "SELECT least(63, greatest(0, floor(p_good*64)))::INT AS b, count(*)::DOUBLE AS n FROM pool GROUP BY 1"),
    (
        "cum",
        """SELECT b, sum(n) OVER (ORDER BY b) AS wb, sum(n) OVER () AS w, sum(n*((b+0.5::DOUBLE)/64)) OVER (ORDER BY b) AS sb,
      sum(n*((b+0.5::DOUBLE)/64)) OVER () AS s FROM bins""",
    ),
    (
        "var",
        """SELECT (b+1)/64.0::DOUBLE AS edge, wb*(w-wb)*(sb/wb-(s-sb)/(w-wb))*(sb/wb-(s-sb)/(w-wb)) AS v FROM cum WHERE wb < w""",
    ),
    ("tau", "SELECT greatest(0.05::DOUBLE, (SELECT edge FROM var ORDER BY v DESC, edge LIMIT 1)) AS tau"),
]


@register("otsu_tau", q.query("SELECT tau FROM tau", OTSU))
def otsu_tau(t):
    return ac.otsu_curve(t.pool).orderBy(F.desc("variance"), "edge").limit(1).select(
        F.greatest(F.lit(ac.SCORE_FLOOR), "edge").alias("tau")
    )


@register("accept_otsu", q.query("SELECT image_id, box_ord FROM pool, tau WHERE p_good >= tau", OTSU))
def accept_otsu(t):
    return ac.otsu(t.pool)[0].select(*KEY)


@register(
    "accept_rate",
    q.query(
        """SELECT image_id, box_ord FROM pool WHERE p_good >= greatest(0.05, (SELECT max(p_good) FROM ordered
      WHERE i = greatest(1, round_even(0.5::DOUBLE*c, 0))))""",
        ("ordered", DESC),
    ),
)
def accept_rate(t):
    return ac.rate(t.pool, 0.5)[0].select(*KEY)


@register(
    "fold_gate",
    q.query(
        """SELECT image_id, box_ord FROM pool WHERE p_good >= (SELECT max(p_good) FROM (
      SELECT p_good, row_number() OVER (ORDER BY p_good) - 1 AS i, count(*) OVER () AS c FROM pool)
      WHERE i = least(floor(0.4::DOUBLE*c), c-1))"""
    ),
)
def fold_gate(t):
    return ac.fold_gate(t.pool, 0.4).select(*KEY)


@register(
    "cap_per_image",
    q.query(
        """SELECT image_id, box_ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_conf DESC, box_ord) AS rk
      FROM candidates) WHERE rk <= 3"""
    ),
)
def cap_per_image(t):
    return ac.cap_per_image(t.candidates, 3).select(*KEY)


@register(
    "adaptive_collection",
    q.query(
        """SELECT c.image_id, c.box_ord, level FROM candidates c JOIN (SELECT image_id, CASE WHEN m >= 0.8 THEN 0.8::DOUBLE
      WHEN m >= 0.4 THEN 0.4::DOUBLE WHEN m >= 0.1 THEN 0.1::DOUBLE WHEN m >= 0.0005 THEN 0.0005::DOUBLE END AS level
      FROM (SELECT image_id, max(det_conf) AS m FROM candidates GROUP BY image_id)) USING (image_id) WHERE det_conf >= level"""
    ),
)
def adaptive_collection(t):
    return ac.adaptive_collection(t.candidates, 0.8, (0.4, 0.1, 0.0005)).select(*KEY, "level")


@register(
    "score_histogram",
    q.query(
        """SELECT b::INT AS bin, (SELECT count(*) FROM pool WHERE least(99, floor(p_good*100)) = b) AS n_p_good,
      (SELECT count(*) FROM pool WHERE least(99, floor(det_conf*100)) = b) AS n_det_conf FROM range(100) r(b)"""
    ),
)
def score_histogram(t):
    return status.score_histogram(t.pool, 100)


@register("accepted_at", q.query("SELECT count(*) AS n_accepted FROM pool WHERE floor(p_good*100) >= 38"))
def accepted_at(t):
    return status.accepted_at(status.score_histogram(t.pool, 100), "n_p_good", 0.375, 100)


# -- whole methods ------------------------------------------------------------------------------
VIEW = q.fold("view", "pool", "p_good DESC, box_ord", 0.45, "d.containment")
GUIDED = [
    ("mass", "SELECT image_id, sum(greatest(p_good, 0)) AS r FROM view GROUP BY image_id"),
    (
        "budget",
        """SELECT image_id, greatest(1, least((SELECT max_topk FROM decision), round_even(round((SELECT mean_count FROM seed)
      * (r / (SELECT avg(r) FROM mass)), 9), 0))) AS k FROM mass""",
    ),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY p_good DESC, box_ord) AS rk FROM view WHERE p_good >= 0.05"),
    ("accepted", "SELECT image_id, box_ord, x1, y1, x2, y2, label, p_good, det_conf FROM ranked JOIN budget USING (image_id) WHERE rk <= k"),
]
CLEAN = [*q.fold("folded", "accepted", "p_good DESC, box_ord", 0.55), *q.contained_sweep("clean", "folded", "d.containment")]
SAVED = """SELECT image_id, box_ord, label AS cls, (x1+x2)/2/640 AS cx, (y1+y2)/2/480 AS cy, (x2-x1)/640 AS w, (y2-y1)/480 AS h FROM clean"""


def _fixed(condition: str):
    return [("accepted", f"SELECT * FROM view WHERE {condition}")]


@register("candidates_view", q.query("SELECT image_id, box_ord FROM view", VIEW))
def candidates_view(t):
    return automate.candidates_view(t.pool, automate.Decision.of(t.human)).select(*KEY)


def _all(t, **kw):
    return automate.automate_all(t.images, t.candidates, t.ownership, t.human, **kw)


@register("automate_all", q.query(SAVED, VIEW, GUIDED, CLEAN))
def automate_all(t):
    return _all(t)


@register("self_training_resumed", q.query(SAVED, VIEW, GUIDED, CLEAN))
def self_training_resumed(t):
    """Three rounds, stopped by an error in the third and taken up again: the last round's labels are those of all candidates."""
    folder = f"{shared_dir(t.spark)}/annospark-{t.spark.sparkContext.applicationId}/cycle-{uuid.uuid4().hex}"
    calls = []

    def train(boxes):
        calls.append(boxes.limit(1).count())
        if len(calls) == 3:
            raise InterruptedError("stopped in the third round")
        return None

    run = functools.partial(training.self_training_cycle, t.images, t.ownership, t.human, train, lambda model: t.candidates, rounds=3, output=folder)
    try:
        run()
    except InterruptedError:
        pass
    return run(resume=True)[0]


for _name, _cut in (("conf25", 0.25), ("conf50", 0.5), ("conf75", 0.75), ("conf90", 0.9)):
    register(f"automate_all_{_name}", q.query(SAVED, VIEW, _fixed(f"det_conf >= {_cut}"), CLEAN))(
        lambda t, m=_name: _all(t, method=m)
    )


@register("automate_all_manual", q.query(SAVED, VIEW, _fixed("det_conf >= 0.42"), CLEAN))
def automate_all_manual(t):
    return _all(t, method="manual", threshold=0.42, score="det_conf")


GATED = [
    (
        "gated",
        """SELECT * FROM accepted WHERE p_good >= (SELECT max(p_good) FROM (SELECT p_good, row_number() OVER (ORDER BY p_good) - 1 AS i,
      count(*) OVER () AS c FROM accepted) WHERE i = least(floor(0.4::DOUBLE*c), c-1))""",
    )
]
GATED_CLEAN = [*q.fold("folded", "gated", "p_good DESC, box_ord", 0.55), *q.contained_sweep("clean", "folded", "d.containment")]


@register("automate_all_gated", q.query(SAVED, VIEW, GUIDED, GATED, GATED_CLEAN))
def automate_all_gated(t):
    return _all(t, fold_share=0.4)


@register(
    "automate_summary",
    q.query(
        """SELECT (SELECT count(*) FROM targets) AS auto_labeled, count(*) AS total_boxes,
      count(*) / (SELECT count(*) FROM targets) AS boxes_per_image FROM clean""",
        VIEW, GUIDED, CLEAN,
    ),
)
def automate_summary(t):
    return status.automate_summary(status.targets(t.images, t.ownership), _all(t))


POOL40 = ("pool40", "SELECT * FROM candidates WHERE image_id % 20 <> 0 OR image_id = 60")


@register(
    "automate_image",
    q.query(
        f"""SELECT *, (SELECT round_even(p_good, 3) FROM clean c WHERE c.image_id = s.image_id AND c.box_ord = s.box_ord) AS score,
      (SELECT CASE WHEN p_good >= 0.65 THEN 'green' WHEN p_good >= 0.35 THEN 'amber' ELSE 'red' END FROM clean c
       WHERE c.image_id = s.image_id AND c.box_ord = s.box_ord) AS band FROM ({SAVED}) s WHERE image_id = 60""",
        POOL40,
        q.fold("view", "pool40", "p_good DESC, box_ord", 0.45, "d.containment"),
        GUIDED,
        CLEAN,
    ),
)
def automate_image(t):
    """A human-owned image: it joins the pool the method is fitted on."""
    return automate.automate_image(t.images, t.candidates, t.ownership, t.human, 60)


@register(
    "image_candidates",
    q.query(
        """SELECT image_id, box_ord, label AS cls, (x1+x2)/2/640 AS cx, (y1+y2)/2/480 AS cy, (x2-x1)/640 AS w, (y2-y1)/480 AS h,
      round_even(p_good, 4) AS p_good, round_even(det_conf, 4) AS det_conf FROM candidates"""
    ),
)
def image_candidates(t):
    return automate.image_candidates(t.images, t.candidates)


# -- study arms ---------------------------------------------------------------------------------
@register("condition_c2", q.query("SELECT image_id, box_ord, 'C2_auto_fixed_conf' AS condition FROM pool WHERE p_good >= 0.5"))
def condition_c2(t):
    return _arm(t, "C2_auto_fixed_conf")


@register(
    "condition_c2b", q.query("SELECT image_id, box_ord, 'C2b_auto_adaptive' AS condition FROM pool, tau WHERE p_good >= tau", OTSU)
)
def condition_c2b(t):
    return _arm(t, "C2b_auto_adaptive")


@register(
    "condition_c3",
    q.query(
        """SELECT image_id, box_ord, 'C3_auto_count_guided' AS condition FROM ranked
      WHERE rk <= (SELECT greatest(1, least(100, round_even(median_count, 0))) FROM seed)""",
        ("ranked", RANKED),
    ),
)
def condition_c3(t):
    return _arm(t, "C3_auto_count_guided")


@register("condition_c3_global", q.query(
    """SELECT image_id, box_ord, 'C3_auto_count_guided' AS condition FROM pool
      WHERE p_good >= greatest(0.05, (SELECT max(p_good) FROM ordered, target WHERE i = k))""",
    ("target", TARGET),
    ("ordered", DESC),
))
def condition_c3_global(t):
    return _arm(t, "C3_auto_count_guided", study.StudyConfig(strategy="global_tau"))


def _arm(t, name, cfg=study.StudyConfig()):
    accepted, _ = study.run_condition(name, t.pool.drop("score"), density.seed_counts(t.human), cfg)
    return accepted.select(*KEY, "condition")


@register(
    "score_bins",
    q.query("SELECT least(9, floor(p_good*10))::INT AS bin, count(*) AS n FROM candidates GROUP BY 1"),
)
def score_bins(t):
    return t.candidates.groupBy(bin_of(F.col("p_good"), 10).alias("bin")).agg(F.count("*").alias("n"))
