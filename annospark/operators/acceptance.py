"""Acceptance policies: which scored candidates become boxes.

A policy is fitted once on the whole pool. Global cuts are plain numbers after the fit, so the final
filter is a literal comparison that reaches the file scan. All tables need ``image_id, box_ord, score``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from annospark.functions.scores import bin_of, half_even, selection_score, usable
from annospark.operators import hot_images
from annospark.operators.density import k_star, target_total
from annospark.operators.order_stats import kth_largest, numbered

# Defaults of the acceptance policies.
SCORE_FLOOR, FIXED_CUT, MIN_TOPK, MAX_TOPK, OTSU_BINS = 0.05, 0.5, 1, 100, 64
COLLECTION_LEVELS = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)

GROUP_LIMIT = 1_000  # the largest bound that Spark applies to each task's rows before the shuffle


@dataclass(frozen=True)
class Seed:
    """The scalar seed figures a policy is fitted with."""

    mean: float
    median: float
    reliable: bool = True
    n_images: int = 0

    @staticmethod
    def of(density: DataFrame) -> "Seed":
        row = density.first()
        return Seed(row["mean_count"], row["median_count"], row["reliable"], row["n_images"])


@dataclass(frozen=True)
class Fitted:
    """What a fit decided, kept as provenance next to the accepted boxes."""

    strategy: str
    tau: float | None = None
    k_star: int | None = None
    target_total: int | None = None
    seed_median: float | None = None
    seed_mean: float | None = None
    reliable: bool = True


def with_score(candidates: DataFrame, kind: str = "validator") -> DataFrame:
    return candidates.withColumn("score", selection_score(kind))


def at_least(candidates: DataFrame, tau: float) -> DataFrame:
    """Everything at or above a cut; ties at the cut are all kept, rows without a usable score never."""
    return candidates.where(usable(F.col("score")) & (F.col("score") >= tau))


def ranked(candidates: DataFrame, bound: int, name: str = "place", score: str = "score") -> DataFrame:
    """The ``bound`` best of each image with their place.

    The bound is a literal, so every map task drops all but ``bound`` rows per image before the
    shuffle: an image with very many candidates does not reach a single task. For a bound above
    ``GROUP_LIMIT`` no such limit exists; images with more rows than that are then numbered across tasks.
    """
    scored, order = candidates.where(usable(F.col(score))), [F.desc(score), F.asc("box_ord")]
    if bound <= GROUP_LIMIT:
        place = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
        return scored.withColumn(name, place).where(F.col(name) <= int(bound))
    placed = numbered(scored, order, name, hot_images.crowded(scored, GROUP_LIMIT))
    return placed.withColumn(name, (F.col(name) + 1).cast("int")).where(F.col(name) <= int(bound))


def top_k(candidates: DataFrame, seed: Seed, low=MIN_TOPK, high=MAX_TOPK, floor=SCORE_FLOOR):
    """One K for all images, from the seed median."""
    k = k_star(seed.median, low, high)
    fit = Fitted("per_image_topk", k_star=k, seed_median=seed.median, seed_mean=seed.mean, reliable=seed.reliable)
    return ranked(at_least(candidates, floor), k).drop("place"), fit


def score_mass(candidates: DataFrame) -> DataFrame:
    """Expected objects per image: the sum of its non-negative scores; an unusable score counts as zero."""
    mass = F.when(usable(F.col("score")), F.greatest(F.lit(0.0), "score")).otherwise(0.0)
    return candidates.groupBy("image_id").agg(F.sum(mass).alias("mass"))


def image_budgets(candidates: DataFrame, seed_mean: float, low=MIN_TOPK, high=MAX_TOPK) -> DataFrame:
    """``(image_id, k)``: the seed mean, scaled by an image's score mass relative to the average mass.

    The average is taken over images that have candidates.
    """
    mass = score_mass(candidates)
    mean = mass.agg(F.avg("mass")).scalar()
    wanted = F.when(mean > 0, half_even(F.lit(float(seed_mean)) * (F.col("mass") / mean))).otherwise(low)
    return mass.select("image_id", F.greatest(F.lit(low), F.least(F.lit(high), wanted)).alias("k"))


def adaptive_k(candidates: DataFrame, seed: Seed, low=MIN_TOPK, high=MAX_TOPK, floor=SCORE_FLOOR, pool=None):
    """A budget per image, fitted on ``pool`` (default: the candidates themselves).

    Images the fit has not seen get the smallest budget.
    """
    budgets = image_budgets(candidates if pool is None else pool, seed.mean, low, high)
    fit = Fitted("adaptive_per_image_k", seed_mean=seed.mean, seed_median=seed.median, reliable=seed.reliable)
    joined = ranked(at_least(candidates, floor), high).join(budgets, "image_id", "left")
    return joined.where(F.col("place") <= F.coalesce("k", F.lit(low))).drop("place", "k"), fit


def global_tau(candidates: DataFrame, seed: Seed, floor=SCORE_FLOOR):
    """One cut so that about ``seed mean x images with candidates`` boxes are accepted."""
    n, images = candidates.agg(F.count(F.when(usable(F.col("score")), 1)), F.countDistinct("image_id")).first()
    target = target_total(seed.mean, images)
    if target <= 0 or n == 0:
        tau = 1.0
    elif target >= n:
        tau = floor
    else:
        tau = kth_largest(candidates, "score", target)
    tau = max(tau, floor)
    fit = Fitted("global_tau", tau, None, target, seed.median, seed.mean, seed.reliable)
    return at_least(candidates, tau), fit


def otsu_curve(candidates: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """Variance between the classes below and above every bin edge, one row per usable bin."""
    scores = candidates.select("score").where(usable(F.col("score")))
    counted = scores.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"))
    weight = F.col("n") * ((F.col("bin") + 0.5) / bins)
    upto, whole = Window.orderBy("bin"), Window.partitionBy()  # at most ``bins`` rows
    sums = counted.select(
        "bin",
        F.sum("n").over(upto).cast("double").alias("below"),
        F.sum("n").over(whole).cast("double").alias("all"),
        F.sum(weight).over(upto).alias("sum_below"),
        F.sum(weight).over(whole).alias("sum_all"),
    ).where(F.col("below") < F.col("all"))
    above = F.col("all") - F.col("below")
    gap = F.col("sum_below") / F.col("below") - (F.col("sum_all") - F.col("sum_below")) / above
    return sums.select(
        ((F.col("bin") + 1) / F.lit(float(bins))).alias("edge"), ((F.col("below") * above) * (gap * gap)).alias("variance")
    )


def otsu_tau(candidates: DataFrame, bins: int = OTSU_BINS) -> float:
    """Upper edge of the first bin with the largest variance; 0.5 when there is nothing to split."""
    best = otsu_curve(candidates, bins).orderBy(F.desc("variance"), "edge").first()
    return best["edge"] if best is not None else 0.5


def otsu(candidates: DataFrame, floor=SCORE_FLOOR, bins: int = OTSU_BINS):
    tau = max(floor, otsu_tau(candidates, bins))
    return at_least(candidates, tau), Fitted("auto_adaptive_otsu", tau)


def rate(candidates: DataFrame, share: float = 0.5, floor=SCORE_FLOOR):
    """Accept the best ``share`` of all candidates."""
    share, n = min(1.0, max(0.0, float(share))), candidates.where(usable(F.col("score"))).count()
    if n == 0 or share <= 0:
        tau = 1.0
    else:
        tau = max(floor, kth_largest(candidates, "score", min(n, max(1, round(share * n)))))
    return at_least(candidates, tau), Fitted("quantile_rate", tau)


def fixed(candidates: DataFrame, tau: float):
    return at_least(candidates, tau), Fitted("fixed_threshold", float(tau))


def manual(candidates: DataFrame, human_images: DataFrame, column: str, tau: float) -> DataFrame:
    """The confidence slider: a cut on one raw score, on images no human owns."""
    if column not in ("p_good", "det_conf"):
        raise ValueError(f"unknown score column: {column}")
    return candidates.where(usable(F.col(column)) & (F.col(column) >= tau)).join(human_images, "image_id", "left_anti")


def fold_gate(accepted: DataFrame, drop_share: float) -> DataFrame:
    """Drop the lowest share by ``p_good``: keep values at or above the one at index int(share * n)."""
    good = usable(F.col("p_good"))
    n = accepted.where(good).count()
    if n == 0 or not 0.0 < drop_share < 1.0:
        return accepted
    index = min(int(drop_share * n), n - 1)
    return accepted.where(good & (F.col("p_good") >= kth_largest(accepted, "p_good", n - index)))


def cap_per_image(candidates: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most confident detections of each image."""
    return ranked(candidates, n, "__rank", "det_conf").drop("__rank")


def adaptive_collection(candidates: DataFrame, first_level: float = 0.05, levels=COLLECTION_LEVELS) -> DataFrame:
    """Per image, everything above the first confidence level that yields a candidate.

    The candidates are scored once at the lowest level; an image's level follows from its best score.
    """
    candidates = candidates.where(usable(F.col("det_conf")))
    best = candidates.groupBy("image_id").agg(F.max("det_conf").alias("best"))
    order = dict.fromkeys([first_level, *levels])
    level = F.coalesce(*[F.when(F.col("best") >= value, F.lit(float(value))) for value in order])
    cut = best.select("image_id", level.alias("level")).where(F.col("level").isNotNull())
    return candidates.join(cut, "image_id").where(F.col("det_conf") >= F.col("level"))
