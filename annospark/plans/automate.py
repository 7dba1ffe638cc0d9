"""Labelling whole datasets: candidates to saved boxes under one acceptance method."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from annospark.functions.geometry import box, centre_from_pixels
from annospark.functions.scores import band
from annospark.operators import acceptance as ac, density, overlap
from annospark.operators.hot_images import HOT_IMAGE, crowded
from annospark.operators.status import fit_pool, targets


@dataclass(frozen=True)
class Method:
    """A named acceptance method. ``needs_seed`` falls back to the automatic cut without a seed."""

    label: str
    score: str
    policy: str
    cut: float = 0.5
    needs_seed: bool = False


# The methods a user can choose from.
METHODS = {
    "count_guided": Method("Count-guided", "validator", "adaptive", 0.5, True),
    "manual": Method("Manual threshold", "validator", "manual"),
    "conf25": Method("Confidence (≥ 0.25)", "confidence", "fixed", 0.25),
    "conf50": Method("Confidence (≥ 0.50)", "confidence", "fixed", 0.50),
    "conf75": Method("Confidence (≥ 0.75)", "confidence", "fixed", 0.75),
    "conf90": Method("Confidence (≥ 0.90)", "confidence", "fixed", 0.90),
}
DEFAULT_METHOD = "count_guided"


@dataclass(frozen=True)
class Decision:
    """The per-dataset decisions drawn from the human seed, as plain numbers."""

    containment: bool = True
    max_topk: int | None = None

    @staticmethod
    def of(seed_boxes: DataFrame) -> "Decision":
        row = density.adaptive_decision(seed_boxes).first()
        return Decision(row["containment"], row["max_topk"])


def candidates_view(raw: DataFrame, decision: Decision, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Raw detections without duplicates; how nested boxes count follows the seed.

    Written once: the fit, the selection and the clean-up all read this view.
    """
    return overlap.cut(overlap.nms(raw, decision.containment, hot_limit), hot_limit)


def _hot_limit(raw: DataFrame) -> int | None:
    """None when no image is large: then no later step, which only removes boxes, has to look again."""
    return HOT_IMAGE if crowded(raw, HOT_IMAGE) is not None else None


def seed_figures(seed_boxes: DataFrame) -> ac.Seed:
    """Seed density as the application uses it: one labelled image with one box is enough."""
    return ac.Seed.of(density.seed_density(density.seed_counts(seed_boxes), 1, 1))


def apply_method(candidates: DataFrame, method: str, seed: ac.Seed, decision: Decision, pool: DataFrame | None = None):
    """Accepted candidates, the fit, and whether a missing seed forced the automatic cut.

    ``pool`` is what the policy is fitted on when it differs from ``candidates``.
    """
    m = METHODS.get(method, METHODS[DEFAULT_METHOD])
    scored = ac.with_score(candidates, m.score)
    fitted_on = scored if pool is None else ac.with_score(pool, m.score)
    high = decision.max_topk or ac.MAX_TOPK
    fell_back = m.needs_seed and not seed.reliable
    if fell_back:
        _, fit = ac.otsu(fitted_on)
        return ac.at_least(scored, fit.tau), fit, True
    if m.policy == "adaptive":
        accepted, fit = ac.adaptive_k(scored, seed, high=high, pool=fitted_on)
    else:
        accepted, fit = ac.fixed(scored, m.cut)
    return accepted, fit, False


def _saved(accepted: DataFrame, images: DataFrame) -> DataFrame:
    cx, cy, w, h = centre_from_pixels(box(), F.col("width"), F.col("height"))
    sized = accepted.join(images.select("image_id", "width", "height"), "image_id")
    return sized.select(
        "image_id", "box_ord", F.col("label").alias("cls"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), "score"
    )


def automate_all(
    images: DataFrame,
    raw: DataFrame,
    ownership: DataFrame,
    seed_boxes: DataFrame,
    method: str = DEFAULT_METHOD,
    threshold: float | None = None,
    score: str = "p_good",
    fold_share: float | None = None,
) -> DataFrame:
    """Boxes for every image no human owns, normalised. Human-labelled images are only the seed.

    The method is fitted once on all targets. ``manual`` with a threshold is the confidence slider.
    ``fold_share`` drops the weakest share of what goes back into training.
    """
    decision = Decision.of(seed_boxes)
    limit = _hot_limit(raw)
    # suppression reads its boxes three times
    pool = overlap.cut(raw.join(targets(images, ownership).select("image_id"), "image_id", "left_semi"), limit)
    view = candidates_view(pool, decision, limit)
    if method == "manual" and threshold is not None:
        if score not in ("p_good", "det_conf"):
            raise ValueError(f"unknown score column: {score}")
        accepted = ac.at_least(view.withColumn("score", F.col(score)), threshold)
    else:
        accepted, _, _ = apply_method(view, method, seed_figures(seed_boxes), decision)
    accepted = overlap.cut(accepted, limit)
    if fold_share is not None:  # its passes read the written table
        accepted = ac.fold_gate(accepted, fold_share)
    clean = overlap.dedup(accepted, decision.containment, order=-F.col("p_good"), hot_limit=limit)
    return _saved(clean, images).drop("score")


def automate_image(
    images: DataFrame, raw: DataFrame, ownership: DataFrame, seed_boxes: DataFrame, image_id, method: str = DEFAULT_METHOD
) -> DataFrame:
    """Proposals for one image, fitted on the same pool as ``automate_all`` plus this image."""
    decision = Decision.of(seed_boxes)
    limit = _hot_limit(raw)
    view = candidates_view(raw.join(fit_pool(images, ownership, image_id), "image_id", "left_semi"), decision, limit)
    mine = view.where(F.col("image_id") == image_id)
    accepted, _, _ = apply_method(mine, method, seed_figures(seed_boxes), decision, pool=view)
    clean = overlap.dedup(overlap.cut(accepted, limit), decision.containment, order=-F.col("p_good"), hot_limit=limit)
    return _saved(clean, images).select(
        "image_id", "box_ord", "cls", "cx", "cy", "w", "h", F.bround("score", 3).alias("score"), band(F.col("score")).alias("band")
    )


def image_candidates(images: DataFrame, view: DataFrame, image_id=None) -> DataFrame:
    """All candidates, normalised and with both scores at 4 decimals; of one image when it is named."""
    chosen = view if image_id is None else view.where(F.col("image_id") == image_id)
    cx, cy, w, h = centre_from_pixels(box(), F.col("width"), F.col("height"))
    return chosen.join(images.select("image_id", "width", "height"), "image_id").select(
        "image_id",
        "box_ord",
        F.col("label").alias("cls"),
        cx.alias("cx"),
        cy.alias("cy"),
        w.alias("w"),
        h.alias("h"),
        F.bround("p_good", 4).alias("p_good"),
        F.bround("det_conf", 4).alias("det_conf"),
    )
