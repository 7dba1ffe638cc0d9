"""Annotation tables derived from the driver's test tables by whole-number arithmetic.

The test data has no images and no boxes, so orders stand for images and order lines for candidate
boxes. Every derivation is a plain projection of the whole table that any SQL engine repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.functions.geometry import Box, box, centre_from_pixels, named
from annospark.operators import hot_images
from annospark.operators.order_stats import numbered_once
from annospark.session import cut_by, cut_lineage, spread_out

WIDTH, HEIGHT = 640, 480
HOT_ORDER = 1_000_000  # lines of one order that a single task may number
ORDER_GROUPS = 65_536  # hashed groups of orders that are counted before single orders


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height")
    )


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived candidates, written once per application as a table in the shared folder.

    Queries then scan only the columns they need, as they would on a stored candidate table. It is kept in buckets of images
    unless an order holds too many lines for one of them.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        hot = hot_images.crowded(lines, HOT_ORDER, "l_orderkey", ORDER_GROUPS)
        rows = derive_candidates(lines, hot)
        _WRITTEN[key] = cut_by(rows, "image_id") if hot is None else cut_lineage(spread_out(rows, "image_id"))
    return _WRITTEN[key].select("*")


def derive_candidates(lines: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``lines`` may repeat; ``hot`` names the orders with more than ``HOT_ORDER`` of them."""
    image, part, supp, rank = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "box_ord"))
    dealt = spread_out(lines, "l_orderkey") if hot is None else lines  # dealt by order once for all steps
    ranked = numbered_once(dealt, ["l_partkey", "l_suppkey"], "box_ord", hot, "l_orderkey")
    x1 = ((image * 37 + (rank % 3) * 211) % 400 + part % 40).cast("double")
    y1 = ((image * 53 + (rank % 3) * 131) % 300 + supp % 40).cast("double")
    wide = (40 + part % 120).cast("double")
    high = (40 + (part + supp) % 120).cast("double")
    return ranked.select(
        image.alias("image_id"),
        "box_ord",
        *named(Box(x1, y1, x1 + wide, y1 + high)),
        ((part + supp) % 4).cast("int").alias("label"),
        (((part * 7919 + supp * 104729 + image * 31) % 10000) / F.lit(10000.0)).alias("p_good"),
        (((part * 6271 + supp * 3571 + image * 17) % 10000) / F.lit(10000.0)).alias("det_conf"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: two thirds of the candidates, shifted, with a wrong class on every 11th image."""
    image, rank = F.col("image_id"), F.col("box_ord")
    b, dx, dy = box(), image % 9, (rank % 7) * 2
    wrong = F.when(image % 11 == 0, 1).otherwise(0)
    return (
        candidates(spark, sf_dir)
        .where((image + rank) % 3 != 0)
        .select(
            "image_id",
            F.col("box_ord"),
            *named(Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)),
            ((F.col("label") + wrong) % 4).cast("int").alias("label"),
        )
    )


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images labelled by a human: every 20th."""
    return images(spark, sf_dir).where(F.col("image_id") % 20 == 0).select("image_id")


def human_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold(spark, sf_dir).where(F.col("image_id") % 20 == 0)


def with_centre(boxes: DataFrame) -> DataFrame:
    """Normalised label boxes ``(image_id, box_ord, cls, cx, cy, w, h)`` from pixel boxes."""
    cx, cy, w, h = centre_from_pixels(box(), F.lit(float(WIDTH)), F.lit(float(HEIGHT)))
    return boxes.select(
        "image_id", "box_ord", F.col("label").alias("cls"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h")
    )


# How the actions in the event table stand for annotator events.
ACTIONS = {
    "signup": "session_start",
    "view": "candidate_rendered",
    "click": "box_accept",
    "error": "box_reject",
    "purchase": "image_finalized",
}


def epoch_millis(ts):
    """Epoch milliseconds of a zone-less timestamp, whatever the session time zone is."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000
    second = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + second


def telemetry_from(events: DataFrame) -> DataFrame:
    """Annotator events from the raw event table (batch or stream)."""
    action = F.create_map(*[F.lit(v) for pair in ACTIONS.items() for v in pair])
    image = F.col("event_id") % 1000
    ms = epoch_millis(F.col("ts"))
    return events.select(
        ms.alias("ts_ms"),
        F.timestamp_millis(ms).alias("ts"),
        F.col("user_id").cast("string").alias("session_id"),
        F.element_at(action, F.col("event_type")).alias("event_type"),
        image.cast("string").alias("image_id"),
        F.concat_ws(":", image, F.col("event_id") % 5).alias("box_id"),
        F.create_map(F.lit("dwell_ms"), F.floor(F.col("value") * 1000).cast("string")).alias("payload"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from(table(spark, sf_dir, "events"))
