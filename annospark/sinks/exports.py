"""Annotations in the formats of other tools. Tables first; writers only serialise them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annospark.functions.geometry import Box, area, box, centre_to_corners, clip_centre, has_extent, named
from annospark.functions.scores import band
from annospark.operators.order_stats import dense_ids

CVAT_IMAGES = 50_000  # images of one XML file


def _gathered(rows: DataFrame, keys, present, element, name: str) -> DataFrame:
    """One row for each ``keys`` with the elements of its rows that are ``present``, by ``box_ord``.

    A projection makes the elements, which is compiled code; inside the aggregate every field of every element would be interpreted.
    """
    entries = rows.select(*keys, F.when(present, F.struct("box_ord", element.alias("e"))).alias("entry"))
    return entries.groupBy(*keys).agg(F.sort_array(F.collect_list("entry"))["e"].alias(name))


# -- label text ---------------------------------------------------------------------------------
def clipped_labels(boxes: DataFrame) -> DataFrame:
    """Normalised boxes clipped to the image; boxes that clip away to nothing are left out."""
    *values, usable = clip_centre(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    clipped = boxes.withColumns({f"__{n}": v for n, v in zip(("cx", "cy", "w", "h"), values)}).where(usable)
    return clipped.withColumns({n: F.col(f"__{n}") for n in ("cx", "cy", "w", "h")}).drop("__cx", "__cy", "__w", "__h")


def label_lines(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(stem, box_ord, line)``; an image without a box has one empty line, so that its file exists."""
    rows = clipped_labels(boxes).select(
        "stem", "box_ord", F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h").alias("line")
    )
    return images.select("stem").distinct().join(rows, "stem", "left").withColumn("line", F.coalesce("line", F.lit("")))


def write_label_table(images: DataFrame, boxes: DataFrame, path: str) -> None:
    """Label lines of all images as one table, the layout for large sets (see ``read_label_table``)."""
    label_lines(images, boxes).withColumnRenamed("box_ord", "line_no").write.mode("overwrite").parquet(path)


def write_labels(images: DataFrame, boxes: DataFrame, path: str) -> None:
    """One text file per image, in a folder ``stem=<stem>``; lines end with a line feed.

    This is what other tools read, at the price of very many small files.

    Lines are written as they come, so no image is gathered in memory. Only the images that are written
    are replaced (dynamic overwrite), so labels of other images stay.
    """
    lines = label_lines(images, boxes).repartition("stem").sortWithinPartitions("stem", "box_ord")
    writer = lines.select("stem", "line").write.partitionBy("stem").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").text(path)


def stage_split(boxes: DataFrame, path: str, class_agnostic: bool = False) -> None:
    """Training layout: label rows by ``split``; for localisation only, all classes become 0."""
    rows = boxes.withColumn("cls", F.lit(0)) if class_agnostic else boxes
    rows.write.partitionBy("split").mode("overwrite").parquet(path)


# -- overlay, ownership, classes, reports -------------------------------------------------------
def overlay_records(candidates: DataFrame) -> DataFrame:
    """``(image_id, box_ord, c)`` with ``c`` in the record layout of overlays."""
    c = F.struct(
        "box_id", F.array("x1", "y1", "x2", "y2").alias("box_xyxy"), F.col("label").cast("int").alias("label"), "det_conf", "p_good"
    )
    return candidates.select(F.col("image_id").cast("string").alias("image_id"), "box_ord", c.alias("c"))


def write_overlay(images: DataFrame, candidates: DataFrame, path: str, layout: str = "boxes") -> None:
    """JSON lines: one per box, or one per image with all its candidates (images without one included).

    The per-image layout gathers an image in one row, as that format asks for.
    """
    rows = overlay_records(candidates)
    if layout == "images":
        grouped = _gathered(rows, ["image_id"], F.lit(True), F.col("c"), "candidates")
        ids = images.select(F.col("image_id").cast("string").alias("image_id"))
        rows = ids.join(grouped, "image_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(grouped.schema["candidates"].dataType)))
    rows.write.mode("overwrite").json(path)


def write_ownership(ownership: DataFrame, path: str) -> None:
    """Owned image names, one JSON object per line, in order."""
    ownership.select("image_id").distinct().orderBy("image_id").write.mode("overwrite").json(path)


def write_classes(classes: DataFrame, images: str, path: str) -> None:
    """The class list with the image folder it belongs to."""
    named_list = F.transform(F.array_sort(F.collect_list(F.struct("cls", "name"))), lambda c: c["name"])
    row = classes.agg(named_list.alias("classes")).select(F.lit(images).alias("images"), "classes")
    row.coalesce(1).write.mode("overwrite").json(path)


def append_report(report: DataFrame, path: str) -> None:
    """Add run metrics to the report table."""
    report.write.mode("append").parquet(path)


def write_crops(crops: DataFrame, path: str) -> DataFrame:
    """Crops by class ``y``; returns the number per class."""
    crops.write.partitionBy("y").mode("overwrite").parquet(path)
    return crops.sparkSession.read.parquet(path).groupBy("y").agg(F.count("*").alias("n"))


# -- COCO ---------------------------------------------------------------------------------------
def coco_images(images: DataFrame) -> DataFrame:
    """Images with dense ids from 1 in name order."""
    return dense_ids(images.select("image_id", "width", "height"), ["image_id"]).select(
        F.col("id").cast("long").alias("id"), F.col("image_id").alias("file_name"), "width", "height"
    )


def coco_annotations(numbered_images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixel boxes with dense ids from 1 in (image, box) order; degenerate boxes are left out."""
    i = numbered_images.select(F.col("id").alias("image_no"), F.col("file_name").alias("image_id"), "width", "height")
    c = centre_to_corners(*(F.col(n) for n in ("cx", "cy", "w", "h")))
    px = Box(
        F.greatest(F.lit(0.0), c.x1 * F.col("width")),
        F.greatest(F.lit(0.0), c.y1 * F.col("height")),
        F.least(F.col("width").cast("double"), c.x2 * F.col("width")),
        F.least(F.col("height").cast("double"), c.y2 * F.col("height")),
    )
    rows = boxes.join(i, "image_id").select("image_no", "box_ord", "cls", *named(px)).where(has_extent(box()))
    numbered = dense_ids(rows, ["image_no", "box_ord"])
    b = box()
    return numbered.select(
        F.col("id").cast("long").alias("id"),
        F.col("image_no").alias("image_id"),
        (F.col("cls") + 1).alias("category_id"),
        F.array(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1).alias("bbox"),
        area(b).alias("area"),
        F.lit(0).alias("iscrowd"),
    )


def coco_categories(classes: DataFrame) -> DataFrame:
    return classes.select((F.col("cls") + 1).alias("id"), "name")


def write_coco(images: DataFrame, boxes: DataFrame, classes: DataFrame, path: str) -> None:
    """The three COCO tables as JSON lines below ``path``."""
    numbered = coco_images(images)
    numbered.write.mode("overwrite").json(f"{path}/images")
    coco_annotations(numbered, boxes).write.mode("overwrite").json(f"{path}/annotations")
    coco_categories(classes).write.mode("overwrite").json(f"{path}/categories")


# -- Label Studio -------------------------------------------------------------------------------
def label_studio_regions(images: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per region in percent of the image; images without a box stay, with null regions.

    ``accepted`` needs ``box_id, class_name, score``; ``images`` needs ``ref, width, height``.
    """
    w, h = F.greatest(F.lit(1), "width"), F.greatest(F.lit(1), "height")
    b = box()
    return images.select("image_id", "ref", "width", "height").join(accepted, "image_id", "left").select(
        "image_id",
        "ref",
        F.col("width").alias("original_width"),
        F.col("height").alias("original_height"),
        "box_ord",
        (b.x1 * 100.0 / w).alias("x"),
        (b.y1 * 100.0 / h).alias("y"),
        ((b.x2 - b.x1) * 100.0 / w).alias("width"),
        ((b.y2 - b.y1) * 100.0 / h).alias("height"),
        "class_name",
        F.col("box_id").alias("pg_box_id"),
        F.col("score").alias("pg_score"),
        F.when(F.col("box_id").isNotNull(), band(F.col("score"))).alias("pg_band"),
    )


def label_studio_tasks(regions: DataFrame, model_version: str = "annospark") -> DataFrame:
    """One task per image with its regions as one prediction; the format gathers an image in one row."""
    region = F.struct(
        F.lit("label").alias("from_name"),
        F.lit("image").alias("to_name"),
        F.lit("rectanglelabels").alias("type"),
        "original_width",
        "original_height",
        F.lit(0).alias("image_rotation"),
        F.struct(
            "x", "y", "width", "height", F.lit(0).alias("rotation"), F.array("class_name").alias("rectanglelabels")
        ).alias("value"),
        F.struct("pg_box_id", "pg_score", "pg_band").alias("meta"),
    )
    tasks = _gathered(regions, ["image_id", "ref"], F.col("pg_box_id").isNotNull(), region, "result")
    return tasks.select(
        F.struct(F.col("ref").alias("image"), F.col("image_id").alias("pg_image_id")).alias("data"),
        F.array(F.struct(F.lit(model_version).alias("model_version"), "result")).alias("predictions"),
    )


# -- CVAT ---------------------------------------------------------------------------------------
def cvat_boxes(images: DataFrame, accepted: DataFrame) -> DataFrame:
    """Boxes with coordinates at 2 and scores at 4 decimals, as text; images without a box stay."""
    b = box()
    text = lambda value, digits: F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))
    return images.select("image_id", "ref", "width", "height").join(accepted, "image_id", "left").select(
        "image_id",
        "ref",
        "width",
        "height",
        "box_ord",
        "class_name",
        text(b.x1, 2).alias("xtl"),
        text(b.y1, 2).alias("ytl"),
        text(b.x2, 2).alias("xbr"),
        text(b.y2, 2).alias("ybr"),
        text(F.col("score"), 4).alias("pg_score"),
        F.when(F.col("class_name").isNotNull(), band(F.col("score"))).alias("pg_band"),
    )


def write_cvat(images: DataFrame, accepted: DataFrame, path: str, source: str = "annospark") -> None:
    """Annotation XML, one ``image`` element per image, ids dense from 0; Spark escapes the text.

    A file holds at most ``CVAT_IMAGES`` images, since a reader takes an XML file as a whole.
    """
    ids = dense_ids(images.select("image_id"), ["image_id"], "no")
    attribute = lambda name, value: F.struct(F.lit(name).alias("_name"), value.alias("_VALUE"))
    element = F.struct(
        F.col("class_name").alias("_label"),
        F.lit("0").alias("_occluded"),
        F.lit(source).alias("_source"),
        *[F.col(c).alias("_" + c) for c in ("xtl", "ytl", "xbr", "ybr")],
        F.lit("0").alias("_z_order"),
        F.array(attribute("pg_score", F.col("pg_score")), attribute("pg_band", F.col("pg_band"))).alias("attribute"),
    )
    boxes = cvat_boxes(images, accepted)
    rows = _gathered(boxes, ["image_id", "ref", "width", "height"], F.col("class_name").isNotNull(), element, "box").join(ids, "image_id")
    rows.select(
        (F.col("no") - 1).alias("_id"), F.col("ref").alias("_name"), F.col("width").alias("_width"), F.col("height").alias("_height"), "box"
    ).write.format("xml").option("rootTag", "annotations").option("rowTag", "image").option("maxRecordsPerFile", CVAT_IMAGES).mode("overwrite").save(path)
