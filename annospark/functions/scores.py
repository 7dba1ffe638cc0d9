"""Score bands, bins and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Traffic-light limits, and the limits of model-made crop labels.
BAND_LOW, BAND_HIGH = 0.35, 0.65
CROP_GOOD_ABOVE, CROP_NOISE_BELOW = 0.7, 0.5


def usable(score: Column) -> Column:
    """Whether a score takes part in fits and selections: not null, and not NaN, which sorts above all numbers."""
    return score.isNotNull() & ~F.isnan(score)


def band(score: Column, low: float = BAND_LOW, high: float = BAND_HIGH) -> Column:
    return F.when(score >= high, "green").when(score >= low, "amber").otherwise("red")


def bin_of(score: Column, bins: int) -> Column:
    """Histogram bin of a score in [0, 1]; values outside fall into the first or last bin."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(score * bins).cast("int")))


def half_even(value: Column) -> Column:
    """Whole number, ties to even. Sums are cut to 9 decimals first so that their order is harmless."""
    return F.bround(F.round(value, 9), 0).cast("long")


def crop_label(score: Column) -> Column:
    """1 for a good crop, 0 for noise, null for the ambiguous middle."""
    return F.when(score > CROP_GOOD_ABOVE, 1).when(score < CROP_NOISE_BELOW, 0)


def selection_score(kind: str) -> Column:
    """The column a policy selects on: the validator's or the detector's."""
    if kind not in ("validator", "confidence"):
        raise ValueError(f"unknown score kind: {kind}")
    return F.col("p_good" if kind == "validator" else "det_conf")
