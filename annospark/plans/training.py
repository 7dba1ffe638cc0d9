"""Training data and self-training rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.functions.geometry import Box, box, centre_to_corners
from annospark.operators import negatives as ng
from annospark.plans.automate import automate_all
from annospark.session import cut_by, cut_lineage, shared_dir


MOST_ROUNDS = 10


def fabricate_training_set(gold: DataFrame, rule: ng.Rule, seed: int = 42, jitter: bool = True) -> DataFrame:
    """Good, empty and displaced crops per image: ``(image_id, kind, crop_ord, y, x1, y1, x2, y2)``.

    ``gold`` has pixel corners with image sizes. Positives are jittered by ``rule.good_crop_jitter`` unless
    ``jitter`` is off; the number of negatives follows the positives of the same image.
    """
    good = ng.good_boxes(ng.jitter_boxes(gold, rule.good_crop_jitter, seed) if jitter else gold)
    # written once, in buckets as gathered boxes are: both kinds of negatives join it, and so do not jitter again
    wanted = cut_by(ng.negative_counts(good, rule), "image_id")
    empty = ng.fabricate_empty(gold, wanted, rule, seed)
    deviated = ng.fabricate_deviated(gold, wanted, rule, seed)

    def shaped(rows: DataFrame, kind: str, order: str, y: int) -> DataFrame:
        return rows.select(
            "image_id", F.lit(kind).alias("kind"), F.col(order).cast("long").alias("crop_ord"), F.lit(y).alias("y"), *Box._fields
        )

    return (
        shaped(good, "good", "box_ord", 1)
        .unionByName(shaped(empty, "empty", "attempt", 0))
        .unionByName(shaped(deviated, "deviated", "slot", 0))
    )


def crops_from_scores(scored: DataFrame, gold: DataFrame, rule: ng.Rule, seed: int = 42) -> DataFrame:
    """Training crops ``(image_id, kind, crop_ord, y, x1, y1, x2, y2)`` labelled by a model's scores.

    ``scored`` has pixel corners and ``score``. When the scores give crops of one class only, the set is
    made from the ground truth by ``rule``, without jitter.
    """
    crops = cut_lineage(ng.model_based_crops(scored).select("image_id", "box_ord", "y", *Box._fields))
    if not ng.has_both_classes(crops):
        return fabricate_training_set(gold, rule, seed, jitter=False)
    kind = F.when(F.col("y") == 1, "good").otherwise("noise").alias("kind")
    return crops.select("image_id", kind, F.col("box_ord").cast("long").alias("crop_ord"), "y", *Box._fields)


def class_head_dataset(boxes: DataFrame, images: DataFrame, least: int = 4) -> DataFrame:
    """Whole-pixel ground-truth crops of at least ``least`` pixels with their class."""
    c = centre_to_corners(*(F.col(n) for n in ("cx", "cy", "w", "h")))
    w, h = F.col("width"), F.col("height")
    whole = Box(
        F.greatest(F.lit(0), (c.x1 * w).cast("int")),
        F.greatest(F.lit(0), (c.y1 * h).cast("int")),
        F.least(w, (c.x2 * w).cast("int")),
        F.least(h, (c.y2 * h).cast("int")),
    )
    rows = boxes.join(images.select("image_id", "width", "height"), "image_id").withColumns(dict(zip(Box._fields, whole)))
    b = box()
    return rows.where((b.x2 - b.x1 >= least) & (b.y2 - b.y1 >= least)).select("image_id", "box_ord", "cls", *Box._fields)


def class_head_ready(crops: DataFrame) -> bool:
    """A class head is only trained on two classes and four crops or more."""
    row = crops.agg(F.countDistinct("cls").alias("classes"), F.count("*").alias("n")).first()
    return row["classes"] >= 2 and row["n"] >= 4


def self_training_cycle(
    images: DataFrame,
    ownership: DataFrame,
    human_boxes: DataFrame,
    train: Callable[[DataFrame], object],
    score: Callable[[object], DataFrame],
    rounds: int = 3,
    method: str = "count_guided",
    fold_share: float | None = 0.4,
    include_ai: bool = True,
    output: str | None = None,
    measure: Callable[[object], dict] | None = None,
    resume: bool = False,
):
    """Rounds of: train, score all images, label all targets.

    ``train(boxes)`` gets pixel boxes (the human seed, from round two also accepted model boxes) and
    returns a model, ``score(model)`` returns raw candidates. The weakest ``fold_share`` is held back on
    all but the last round. Every round is written as a table of its own, so a round starts from files
    and not from the plans of the rounds before. ``output`` is the folder of these tables; without it they go
    to the scratch folder of the session. ``measure(model)`` may give the round's ``map50`` and ``val_acc``.
    Returns the labels of the last round and a summary.

    A round counts as finished once its figures stand in ``<output>/finished``, which is written after its labels. With
    ``resume`` a run that was stopped goes on after its last finished round and gives the labels of an unbroken run; it must ask for
    the same rounds, method and shares. Without, all rounds are made anew.
    """
    if not 1 <= rounds <= MOST_ROUNDS:
        raise ValueError(f"between 1 and {MOST_ROUNDS} rounds, not {rounds}")
    spark = images.sparkSession
    folder = output or f"{shared_dir(spark)}/cycle-{uuid.uuid4().hex}"
    asked = f"rounds={rounds} method={method} fold_share={fold_share} include_ai={include_ai}"
    done = _finished(spark, folder, asked) if resume else 0
    n_targets = images.join(ownership, "image_id", "left_anti").count()
    for number in range(done + 1, rounds + 1):
        labels = spark.read.parquet(f"{folder}/round={number - 1}") if number > 1 else None
        use_ai = labels is not None and include_ai
        boxes = human_boxes.unionByName(_pixels(labels, images)) if use_ai else human_boxes
        model = train(boxes)
        candidates, figures = score(model), measure(model) if measure else {}
        gate = None if number == rounds or not include_ai else fold_share
        path = f"{folder}/round={number}"
        automate_all(images, candidates, ownership, human_boxes, method, fold_share=gate).write.mode("overwrite").parquet(path)
        shown = (figures.get("map50"), figures.get("val_acc"))
        row = (number, "all" if use_ai else "human", *shown, n_targets, spark.read.parquet(path).count(), asked)
        spark.createDataFrame([row], f"{SUMMARY}, asked string").coalesce(1).write.mode("overwrite" if number == 1 else "append").parquet(f"{folder}/finished")
    summary = spark.read.parquet(f"{folder}/finished").drop("asked")
    return spark.read.parquet(f"{folder}/round={rounds}"), summary


SUMMARY = "round int, scope string, map50 double, val_acc double, auto_labeled long, total_boxes long"


def _finished(spark: SparkSession, folder: str, asked: str) -> int:
    """The number of rounds that a run in ``folder`` has finished."""
    try:
        rows = spark.read.schema(f"{SUMMARY}, asked string").parquet(f"{folder}/finished").collect()  # MOST_ROUNDS at most
    except AnalysisException:
        return 0
    if any(r["asked"] != asked for r in rows):
        raise ValueError(f"{folder} holds rounds of another run: {rows[0]['asked']}")
    return max((r["round"] for r in rows), default=0)


def _pixels(labels: DataFrame, images: DataFrame) -> DataFrame:
    sized = labels.join(images.select("image_id", "width", "height"), "image_id")
    c = centre_to_corners(*(F.col(n) for n in ("cx", "cy", "w", "h")))
    w, h = F.col("width"), F.col("height")
    return sized.select(
        "image_id", "box_ord", (c.x1 * w).alias("x1"), (c.y1 * h).alias("y1"), (c.x2 * w).alias("x2"), (c.y2 * h).alias("y2"), F.col("cls").alias("label")
    )
