"""Progress, histograms and class views over labels and candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from annospark.functions.scores import bin_of
from annospark.session import cut_lineage


def targets(images: DataFrame, ownership: DataFrame) -> DataFrame:
    """Images no human owns."""
    return images.join(ownership.select("image_id"), "image_id", "left_anti")


def fit_pool(images: DataFrame, ownership: DataFrame, extra_image=None) -> DataFrame:
    """Target images, with one more image when a single image is labelled on request."""
    pool = targets(images, ownership).select("image_id")
    if extra_image is None:
        return pool
    extra = images.where(F.col("image_id") == extra_image).select("image_id")
    return pool.unionByName(extra).distinct()


def score_histogram(candidates: DataFrame, bins: int = 100) -> DataFrame:
    """``(bin, n_p_good, n_det_conf)`` for every bin, from one pass over the candidates."""
    both = F.array(
        F.struct(bin_of(F.col("p_good"), bins).alias("bin"), F.lit(1).alias("p"), F.lit(0).alias("d")),
        F.struct(bin_of(F.col("det_conf"), bins).alias("bin"), F.lit(0).alias("p"), F.lit(1).alias("d")),
    )
    counted = candidates.select(F.inline(both)).groupBy("bin").agg(F.sum("p").alias("p"), F.sum("d").alias("d"))
    every = candidates.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.coalesce("p", F.lit(0)).alias("n_p_good"), F.coalesce("d", F.lit(0)).alias("n_det_conf")
    )


def accepted_at(histogram: DataFrame, column: str, threshold: float, bins: int = 100) -> DataFrame:
    """Candidates accepted at a threshold, read off the histogram: all bins from round(threshold * bins)."""
    start = min(bins - 1, max(0, math.floor(threshold * bins + 0.5)))
    return histogram.where(F.col("bin") >= start).agg(F.coalesce(F.sum(column), F.lit(0)).alias("n_accepted"))


def label_status(images: DataFrame, boxes: DataFrame, ownership: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Per image: saved boxes, their classes, classes the model proposes, and who owns it."""
    saved = boxes.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("cls")).alias("classes"))
    rows = images.select("image_id").join(saved, "image_id", "left")
    if candidates is None:
        rows = rows.withColumn("ai_classes", F.array().cast("array<int>"))
    else:
        proposed = candidates.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias("ai_classes"))
        rows = rows.join(proposed, "image_id", "left")
    owned = ownership.select("image_id", F.lit("human").alias("owner")).distinct()
    count = F.coalesce("n", F.lit(0))
    owner = F.coalesce("owner", F.when(count > 0, "auto").otherwise("none"))
    none = F.array().cast("array<int>")
    return rows.join(owned, "image_id", "left").select(
        "image_id",
        count.alias("n_boxes"),
        F.coalesce("classes", none).alias("classes"),
        F.coalesce("ai_classes", none).alias("ai_classes"),
        owner.alias("owner"),
    )


def status_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.when(F.col("n_boxes") > 0, 1)).alias("labeled"),
        F.count(F.when(F.col("owner") == "human", 1)).alias("human"),
        F.count("*").alias("total"),
    )


def images_by_class(boxes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Distinct ``(image_id, cls)`` of saved labels and of model proposals."""
    saved = boxes.select("image_id", "cls")
    if candidates is not None:
        saved = saved.unionByName(candidates.select("image_id", F.col("label").alias("cls")))
    return saved.distinct()


def images_with_class(images: DataFrame, by_class: DataFrame, cls: int) -> DataFrame:
    return images.join(by_class.where(F.col("cls") == cls), "image_id", "left_semi")


def label_stats(boxes: DataFrame, label_files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row per class and one total row (``cls`` null) of a split.

    Without an image listing, label files stand for images.
    """
    grouped = boxes.groupingSets([[F.col("cls")], []], F.col("cls")).agg(F.count("*").alias("objects"))
    n_files = label_files.agg(F.count("*")).scalar()
    n_images = n_files if images is None else images.agg(F.count("*")).scalar()
    found = F.when(n_images > 0, n_images).otherwise(n_files)
    return grouped.select("cls", "objects", n_files.alias("n_label_files"), found.alias("n_images"))


def class_distribution(crops: DataFrame) -> DataFrame:
    return crops.agg(
        F.count(F.when(F.col("y") == 0, 1)).alias("noise"),
        F.count(F.when(F.col("y") == 1, 1)).alias("good"),
        F.count("*").alias("total"),
    )


def prediction_summary(images: DataFrame, candidates: DataFrame) -> DataFrame:
    mean = F.coalesce(F.bround(F.round(F.avg("p_good"), 9), 4), F.lit(0.0))
    return candidates.agg(F.count("*").alias("candidates"), mean.alias("mean_p_good")).select(
        images.agg(F.count("*")).scalar().alias("images"), "candidates", "mean_p_good"
    )


def automate_summary(target_images: DataFrame, saved: DataFrame) -> DataFrame:
    """Images labelled, boxes saved, and the boxes per image."""
    n = target_images.agg(F.count("*")).scalar()
    return saved.agg(F.count("*").alias("total_boxes")).select(
        n.alias("auto_labeled"),
        "total_boxes",
        F.when(n > 0, F.col("total_boxes") / n).otherwise(F.lit(0.0)).alias("boxes_per_image"),
    )


# -- classes ------------------------------------------------------------------------------------
def infer_classes(boxes: DataFrame) -> DataFrame:
    """``class_0 .. class_max`` for a dataset that names none."""
    last = boxes.agg(F.max("cls").alias("last")).where(F.col("last").isNotNull())
    every = last.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("cls"))
    return every.select("cls", F.concat(F.lit("class_"), F.col("cls")).alias("name"))


def with_class_name(boxes: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Class names; a label the class table does not know shows as its number."""
    names = cut_lineage(classes.select(F.col("cls").alias("__cls"), F.col("name").alias("__name")))  # of known size: boxes are not dealt by class
    joined = boxes.join(names, F.col(label) == F.col("__cls"), "left")
    return joined.withColumn("class_name", F.coalesce("__name", F.col(label).cast("string"))).drop("__cls", "__name")


def add_class(classes: DataFrame, name: str) -> DataFrame:
    """Append a class. Commas become spaces; empty and known names are refused."""
    clean = str(name or "").strip().replace(",", " ").strip()
    if not clean:
        raise ValueError("the class name is empty")
    if classes.where(F.col("name") == clean).limit(1).count():
        raise ValueError(f"class already exists: {clean}")
    last = classes.agg(F.coalesce(F.max("cls"), F.lit(-1)).alias("last"))
    new = last.select((F.col("last") + 1).cast("int").alias("cls"), F.lit(clean).alias("name"))
    return classes.select("cls", "name").unionByName(new)


def adopt_saved_classes(base: list[str], saved: list[str], saved_for: str | None, images: str) -> list[str]:
    """A saved class list counts only for the same image folder and when it extends ``base``."""
    kept = [str(c) for c in saved if str(c).strip()]
    same_folder = saved_for is None or saved_for == images
    return kept if same_folder and len(kept) > len(base) and kept[: len(base)] == base else base


# -- ownership ----------------------------------------------------------------------------------
def seed_images(images: DataFrame, boxes: DataFrame, manifest: DataFrame | None, scope: str = "human") -> DataFrame:
    """Boxes of the labelled images to train from.

    ``human`` keeps images of the ownership table; without one every labelled image counts as human.
    ``all`` keeps model-written labels too.
    """
    if scope not in ("human", "all"):
        raise ValueError(f"unknown scope: {scope}")
    rows = boxes.join(images.select("image_id"), "image_id", "left_semi")
    if scope == "human" and manifest is not None:
        rows = rows.join(manifest.select("image_id"), "image_id", "left_semi")
    return rows


def own(ownership: DataFrame, saved_images: DataFrame, human: bool = True) -> DataFrame:
    """Ownership after a save: a human save adds the images, a passive one does not."""
    if not human:
        return ownership.select("image_id")
    return ownership.select("image_id").unionByName(saved_images.select("image_id")).distinct()
