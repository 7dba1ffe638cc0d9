"""Candidate overlays and event logs as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.schemas import CORRUPT, EVENT_LINE, OVERLAY_DOCUMENT, OVERLAY_RECORD
from annospark.sources.folders import opened_path
from annospark.sources.json_ranges import map_keys

LAYOUTS = ("document", "images", "boxes")


def _overlay_maps(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", OVERLAY_DOCUMENT).alias("overlay"))


def _flat(rows: DataFrame) -> DataFrame:
    """``(image_id, box_ord, c)`` to candidate columns; a missing label is class 0."""
    at = lambda i: F.element_at("c.box_xyxy", i)
    return rows.select(
        "image_id",
        F.col("c.box_id").alias("box_id"),
        F.col("box_ord").cast("long").alias("box_ord"),
        at(1).alias("x1"),
        at(2).alias("y1"),
        at(3).alias("x2"),
        at(4).alias("y2"),
        F.coalesce("c.label", F.lit(0)).alias("label"),
        F.col("c.det_conf").alias("det_conf"),
        F.col("c.p_good").alias("p_good"),
    )


def read_overlay(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Candidates of an overlay.

    ``document`` is one JSON map per file, ``images`` one line per image, ``boxes`` one line per box.
    A JSON document cannot be split, so large overlays belong in the line layouts.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout: {layout}")
    if layout == "boxes":
        schema = f"image_id string, box_ord bigint, c {OVERLAY_RECORD.simpleString()}"
        return _flat(spark.read.schema(schema).json(path))
    if layout == "images":
        schema = f"image_id string, candidates array<{OVERLAY_RECORD.simpleString()}>"
        rows = spark.read.schema(schema).json(path)
        return _flat(rows.select("image_id", F.posexplode("candidates").alias("box_ord", "c")))
    images = _overlay_maps(spark, path).select(F.explode("overlay").alias("image_id", "candidates"))
    return _flat(images.select("image_id", F.posexplode("candidates").alias("box_ord", "c")))


def overlay_image_ids(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """All images of a document overlay, also those without a candidate. ``parts``: ``path`` is a folder of ``write_overlay_document``.

    Documents that Python can open are read in ranges by several tasks, those of other stores by one task each.
    """
    if opened_path(path) is not None:
        return map_keys(spark, path, parts).select(F.col("key").alias("image_id"))
    if parts:
        raise ValueError(f"parts of one document need a folder that can be opened, not {path}")
    return _overlay_maps(spark, path).select(F.explode(F.map_keys("overlay")).alias("image_id"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Annotator events from JSON lines; blank lines are skipped, the text of malformed ones is kept."""
    rows = spark.read.schema(EVENT_LINE).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("ts", F.timestamp_millis("ts_ms"))
