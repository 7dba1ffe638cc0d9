"""Study arms: the same candidates under different acceptance policies, and their quality side by side."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from annospark.operators import acceptance as ac, density, metrics

# The study arms.
CONDITIONS = ("C1_manual", "C2_auto_fixed_conf", "C2b_auto_adaptive", "C3_auto_count_guided")


@dataclass(frozen=True)
class StudyConfig:
    strategy: str = "per_image_topk"
    score: str = "validator"
    fixed_cut: float = ac.FIXED_CUT
    floor: float = ac.SCORE_FLOOR
    min_topk: int = ac.MIN_TOPK
    max_topk: int = ac.MAX_TOPK
    n_seed_images: int = 5
    min_seed_boxes: int = 3


def make_policy(cfg: StudyConfig):
    """The count-guided policy a configuration names, as ``(candidates, seed) -> (accepted, fit)``."""
    if cfg.strategy == "per_image_topk":
        return lambda c, s: ac.top_k(c, s, cfg.min_topk, cfg.max_topk, cfg.floor)
    if cfg.strategy == "global_tau":
        return lambda c, s: ac.global_tau(c, s, cfg.floor)
    raise ValueError(f"unknown strategy: {cfg.strategy}")


def run_condition(condition: str, candidates: DataFrame, seed_counts: DataFrame, cfg: StudyConfig = StudyConfig()):
    """Accepted candidates of one arm with column ``condition``, and the fit.

    The count-guided arm uses the fixed cut, flagged as unreliable, when the seed is too small.
    """
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition: {condition}")
    scored = ac.with_score(candidates, cfg.score)
    if condition == "C1_manual":
        accepted, fit = scored.limit(0), ac.Fitted("manual")
    elif condition == "C2_auto_fixed_conf":
        accepted, fit = ac.fixed(scored, cfg.fixed_cut)
    elif condition == "C2b_auto_adaptive":
        accepted, fit = ac.otsu(scored, cfg.floor)
    else:
        floor_images = cfg.n_seed_images // 2 or 1
        seed = ac.Seed.of(density.seed_density(seed_counts, floor_images, cfg.min_seed_boxes))
        if seed.reliable:
            accepted, fit = make_policy(cfg)(scored, seed)
        else:
            accepted, fit = ac.fixed(scored, cfg.fixed_cut)
            fit = replace(fit, reliable=False)
    return accepted.withColumn("condition", F.lit(condition)), fit


def compare_methods(accepted_by_method: dict[str, DataFrame], gold: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Defects and escape rate per method over the same gold boxes."""
    rows = None
    for name, accepted in accepted_by_method.items():
        one = metrics.defect_escape(metrics.image_defects(accepted, gold, at_least)).withColumn("method", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows
