"""What a small human-labelled seed says about object density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from annospark.functions.geometry import CONTAINED_FROM, box, containment
from annospark.functions.scores import half_even
from annospark.operators.overlap import self_pairs

# When nested boxes are real objects, and how far top-K may exceed the seed's density.
NESTING_KEEPS_FROM, SPARSE_BELOW, TOPK_FACTOR = 0.03, 2.5, 1.5


def seed_counts(boxes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Boxes per seed image. With ``images`` those without a box count as zero, otherwise they are left out."""
    counts = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    if images is None:
        return counts
    return images.select("image_id").join(counts, "image_id", "left").select(
        "image_id", F.coalesce("n", F.lit(0)).alias("n")
    )


def _at_rank(counts: DataFrame, position) -> DataFrame:
    """Count value at a zero-based rank of the ascending counts; ``position`` reads column ``images``.

    Works on one row per distinct count, so it stays small whatever the number of images.
    """
    distinct = counts.groupBy("n").agg(F.count("*").alias("images_here"))
    total = F.sum("images_here").over(Window.partitionBy())
    upto = F.sum("images_here").over(Window.orderBy("n"))
    ranked = distinct.select("n", total.alias("images"), upto.alias("upto"))
    return ranked.where(F.col("upto") > position).agg(F.min("n").alias("value"))


def seed_density(counts: DataFrame, min_images: int, min_boxes: int) -> DataFrame:
    """One row: images, boxes, mean, median, nearest-rank 90th percentile, and whether to trust them."""
    stats = counts.agg(
        F.count("*").alias("n_images"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_boxes"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_count"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median_count"),
    )
    p90 = _at_rank(counts, half_even((F.col("images") - 1) * 0.9)).scalar()
    enough = (F.col("n_images") >= max(1, min_images)) & (F.col("total_boxes") >= min_boxes)
    return stats.select("*", F.coalesce(p90.cast("double"), F.lit(0.0)).alias("p90_count"), enough.alias("reliable"))


def k_star(median: float, low: int = 1, high: int = 100) -> int:
    """Boxes per image from the seed median; Python rounds half to even as needed here."""
    return max(low, min(high, round(median)))


def target_total(mean: float, images: int) -> int:
    return max(0, round(round(mean * images, 9)))


def adaptive_decision(seed: DataFrame) -> DataFrame:
    """One row: are nested boxes duplicates on this dataset, and how many boxes may an image get.

    Nested boxes are real objects when the seed shows nesting or is sparse. ``max_topk`` follows a
    crowded seed image (index ``int(0.9 n)``, another definition than the one in ``seed_density``).
    Stored figures are rounded; the decision uses the exact ones.
    """
    counts = seed_counts(seed)
    crowded = _at_rank(counts, F.least(F.col("images") - 1, F.floor(F.col("images") * 0.9))).scalar()
    inside = self_pairs(seed, containment(box("a"), box("b")) >= CONTAINED_FROM, [F.lit(1).alias("one")])
    row = counts.agg(
        F.count("*").alias("images"), F.avg("n").alias("mean"), F.sum(F.col("n") * (F.col("n") - 1)).alias("ordered_pairs")
    ).select("*", crowded.alias("value"), inside.agg(F.count("*")).scalar().alias("nested"))
    share = F.when(F.col("ordered_pairs") > 0, F.col("nested") / F.col("ordered_pairs")).otherwise(0.0)
    empty = F.col("images") == 0
    keep_nested = (share >= NESTING_KEEPS_FROM) | (F.col("mean") < SPARSE_BELOW)
    return row.select(
        F.when(empty, True).otherwise(~keep_nested).alias("containment"),
        F.when(~empty, F.greatest(F.lit(2), half_even(F.col("value") * TOPK_FACTOR))).cast("int").alias("max_topk"),
        F.when(~empty, F.bround(share, 4)).alias("nest_frac"),
        F.when(~empty, F.bround("mean", 2)).alias("seed_mean"),
    )
