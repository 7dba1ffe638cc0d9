"""Candidates with a realistic score structure for trying policies without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annospark.functions.hashing import spread, uniforms

# Ranges of the made-up candidates.
TRUE_SIDE, TRUE_FRAME, NOISE_FRAME, NOISE_SIDE = 60.0, 500.0, 560.0, (20.0, 80.0)
NOISE_PER_IMAGE = (4, 12)
TRUE_CONF, TRUE_GOOD, NOISE_CONF, NOISE_GOOD = (0.4, 0.9), (0.7, 0.98), (0.05, 0.5), (0.05, 0.55)
CLASSES = 3


def synthetic_candidates(images: DataFrame, density: int = 3, seed: int = 42) -> DataFrame:
    """Per image ``density`` well-scored boxes and 4 to 12 weak ones; depends on seed and image only."""
    low, high = NOISE_PER_IMAGE
    extra = low + F.floor(uniforms(seed, F.lit("extra"), "image_id")[0] * (high - low + 1))
    rows = images.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), density + extra - 1)).alias("box_ord"))
    true = F.col("box_ord") < density
    at = uniforms(seed, F.lit("at"), "image_id", "box_ord")
    score = uniforms(seed, F.lit("score"), "image_id", "box_ord")
    frame = F.when(true, TRUE_FRAME).otherwise(NOISE_FRAME)
    side = lambda u: F.when(true, TRUE_SIDE).otherwise(spread(u, *NOISE_SIDE))
    pick = lambda u, yes, no: F.when(true, spread(u, *yes)).otherwise(spread(u, *no))
    x1, y1 = at[0] * frame, at[1] * frame
    return rows.select(
        "image_id",
        F.concat_ws(":", "image_id", "box_ord").alias("box_id"),
        "box_ord",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + side(score[2])).alias("x2"),
        (y1 + side(score[3])).alias("y2"),
        F.floor(at[2] * CLASSES).cast("int").alias("label"),
        pick(score[0], TRUE_CONF, NOISE_CONF).alias("det_conf"),
        pick(score[1], TRUE_GOOD, NOISE_GOOD).alias("p_good"),
    )
