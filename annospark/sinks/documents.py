"""Whole documents for other tools, written as ordered text parts: put one after the other, they are the document.

``cat <path>/part-* > file`` gives a file that the tool reads (``zcat`` for parts written with gzip). Rows are sorted by range, every line is one element, and
no image is gathered in a row, so neither a document nor a large image passes through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.operators.order_stats import dense_ids
from annospark.sinks.exports import coco_annotations, coco_categories, coco_images, cvat_boxes, label_studio_regions, overlay_records

PLACE = ("section", "no", "kind", "ord")


def _row(section: int, no, kind: int, ord_, text) -> list[Column]:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return [
        F.lit(section).alias("section"),
        as_column(no).cast("long").alias("no"),
        F.lit(kind).alias("kind"),
        as_column(ord_).cast("long").alias("ord"),
        as_column(text).alias("text"),
    ]


def fixed(spark: SparkSession, section: int, text: str) -> DataFrame:
    """A line that stands by itself, such as the head of a document."""
    return spark.range(1).select(*_row(section, 0, 0, 0, text))


def listed(section: int, rows: DataFrame, text: Column) -> DataFrame:
    """Elements numbered from 1 by ``no``, with a comma before all but the first."""
    return rows.select(*_row(section, F.col("no"), 0, 0, F.when(F.col("no") > 1, F.concat(F.lit(","), text)).otherwise(text)))


def nested(section: int, parents: DataFrame, children: DataFrame, comma: str = ",") -> DataFrame:
    """Elements ``parents(no, opening, closing)`` around their ``children(no, ord, text)``, a line each.

    Children may carry ``first``, the smallest ``ord`` of their element, which saves a join of all their texts.
    """
    parted = lambda later, text: F.when(later, F.concat(F.lit(comma), text)).otherwise(text)
    if "first" not in children.columns:
        children = children.join(children.groupBy("no").agg(F.min("ord").alias("first")), "no")
    inside = children.select(*_row(section, F.col("no"), 1, F.col("ord"), parted(F.col("ord") > F.col("first"), F.col("text"))))
    opening = parents.select(*_row(section, F.col("no"), 0, 0, parted(F.col("no") > 1, F.col("opening"))))
    return opening.unionByName(inside).unionByName(parents.select(*_row(section, F.col("no"), 2, 0, F.col("closing"))))


def write_document(parts: list[DataFrame], path: str, compression: str | None = None) -> None:
    every = reduce(DataFrame.unionByName, parts)
    every.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).select("text").write.mode("overwrite").text(path, compression=compression)


def write_coco_document(images: DataFrame, boxes: DataFrame, classes: DataFrame, path: str) -> None:
    spark, numbered = images.sparkSession, coco_images(images)
    annotations = coco_annotations(numbered, boxes)
    tables = (("images", numbered), ("annotations", annotations), ("categories", coco_categories(classes)))
    parts = []
    for i, (name, rows) in enumerate(tables):
        parts.append(fixed(spark, 2 * i, ("{" if i == 0 else "],") + f'"{name}": ['))
        # categories count from 1 by their class, which may start anywhere
        if name == "categories":
            rows = dense_ids(rows, ["id"], "no")
        else:
            rows = rows.withColumn("no", F.col("id"))
        parts.append(listed(2 * i + 1, rows, F.to_json(F.struct(*[c for c in rows.columns if c != "no"]))))
    write_document([*parts, fixed(spark, 6, "]}")], path)


def _numbered(images: DataFrame) -> DataFrame:
    return dense_ids(images, ["image_id"], "no")


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def write_cvat_document(images: DataFrame, accepted: DataFrame, path: str, source: str = "annospark") -> None:
    """Annotation XML with its version; ids count from 0 in name order."""
    ids = _numbered(images.select("image_id", "ref", "width", "height"))
    tag = lambda element, **values: F.concat(
        F.lit(f"<{element}"), *[x for k, v in values.items() for x in (F.lit(f' {k}="'), _escaped(F.coalesce(v.cast("string"), F.lit(""))), F.lit('"'))], F.lit(">")
    )
    parents = ids.select(
        "no",
        tag("image", id=F.col("no") - 1, name=F.col("ref"), width=F.col("width"), height=F.col("height")).alias("opening"),
        F.lit("</image>").alias("closing"),
    )
    sides = ("xtl", "ytl", "xbr", "ybr")
    boxes = cvat_boxes(images.select("image_id", "ref", "width", "height"), accepted).where("class_name IS NOT NULL").join(ids.select("image_id", "no"), "image_id")
    note = lambda name: F.concat(F.lit(f'<attribute name="{name}">'), _escaped(F.coalesce(name, F.lit(""))), F.lit("</attribute>"))
    head = tag("box", label=F.col("class_name"), occluded=F.lit("0"), source=F.lit(source), **{s: F.col(s) for s in sides}, z_order=F.lit("0"))
    children = boxes.select("no", F.col("box_ord").alias("ord"), F.concat(head, note("pg_score"), note("pg_band"), F.lit("</box>")).alias("text"))
    spark = images.sparkSession
    begin = '<?xml version="1.0" encoding="utf-8"?>\n<annotations>\n<version>1.1</version>'
    write_document([fixed(spark, 0, begin), nested(1, parents, children, ""), fixed(spark, 2, "</annotations>")], path)


def write_label_studio_document(
    images: DataFrame, accepted: DataFrame, path: str, model_version: str = "annospark", compression: str | None = None
) -> None:
    """A list of tasks, one for each image, each with one prediction. ``compression`` may be gzip, whose parts can be put together as well."""
    ids = _numbered(images.select("image_id", "ref"))
    data = F.to_json(F.struct(F.col("ref").alias("image"), F.col("image_id").alias("pg_image_id")))
    opening = F.concat(F.lit('{"data": '), data, F.lit(f', "predictions": [{{"model_version": "{model_version}", "result": ['))
    parents = ids.select("no", opening.alias("opening"), F.lit("]}]}").alias("closing"))
    first = accepted.where("box_id IS NOT NULL").groupBy("image_id").agg(F.min("box_ord").cast("long").alias("first"))
    places = ids.select("image_id", "no").join(first, "image_id")
    rows = label_studio_regions(images, accepted).where("pg_box_id IS NOT NULL").join(places, "image_id")
    value = F.struct("x", "y", "width", "height", F.lit(0).alias("rotation"), F.array("class_name").alias("rectanglelabels")).alias("value")
    region = F.struct(
        F.lit("label").alias("from_name"),
        F.lit("image").alias("to_name"),
        F.lit("rectanglelabels").alias("type"),
        "original_width",
        "original_height",
        F.lit(0).alias("image_rotation"),
        value,
        F.struct("pg_box_id", "pg_score", "pg_band").alias("meta"),
    )
    children = rows.select("no", F.col("box_ord").alias("ord"), "first", F.to_json(region).alias("text"))
    spark = images.sparkSession
    write_document([fixed(spark, 0, "["), nested(1, parents, children), fixed(spark, 2, "]")], path, compression)


def write_overlay_document(images: DataFrame, candidates: DataFrame, path: str) -> None:
    """One map from image to its candidates; images without one have an empty list."""
    ids = _numbered(images.select(F.col("image_id").cast("string").alias("image_id")))
    name = F.regexp_replace(F.to_json(F.struct(F.col("image_id").alias("n"))), r'^\{"n":|\}$', "")  # the quoted name
    parents = ids.select("no", F.concat(name, F.lit(": [")).alias("opening"), F.lit("]").alias("closing"))
    rows = overlay_records(candidates).join(ids, "image_id")
    children = rows.select("no", F.col("box_ord").alias("ord"), F.to_json("c").alias("text"))
    spark = images.sparkSession
    write_document([fixed(spark, 0, "{"), nested(1, parents, children), fixed(spark, 2, "}")], path)
