"""Label text: one line ``cls cx cy w h`` per box, one file per image."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from annospark.functions.names import decoded, stem
from annospark.operators import hot_images
from annospark.operators.order_stats import numbered
from annospark.session import cut_lineage
from annospark.sources.folders import in_stem_folder, list_files, opened_path, read_each, read_ranges

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MODES = ("strict", "drop_file", "drop_row")


def parse_lines(lines: DataFrame, mode: str = "strict", key: str = "stem", order: str = "line_no") -> DataFrame:
    """Boxes ``(key, box_ord, cls, cx, cy, w, h)`` from text lines.

    Lines with fewer than five words are no boxes. A word that is no number is an error (``strict``),
    drops all boxes of its file (``drop_file``) or only its line (``drop_row``).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    # from a generator, so that what follows reads the words instead of splitting the line again
    rows = lines.select(key, order, F.explode(F.filter(F.array(words), lambda w: F.size(w) >= 5)).alias("w"))
    word = lambda i: F.element_at("w", i + 1)
    numeric = F.forall(F.slice("w", 1, 5), lambda x: F.rlike(x, F.lit(NUMBER)))
    rows = rows.withColumn("ok", numeric)
    if mode == "strict":
        complaint = F.concat(F.lit("bad number in label line of "), F.col(key).cast("string"))
        rows = rows.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(complaint).cast("boolean")))
    elif mode == "drop_file":
        rows = rows.join(rows.where(~F.col("ok")).select(key).distinct(), key, "left_anti")
    rows = rows.where("ok").select(
        key,
        order,
        word(0).try_cast("double").cast("int").alias("cls"),
        *[word(i).try_cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)],
    )
    # counted by lines, of which there are at least as many as boxes; that parses none of them
    placed = numbered(rows, order, "box_ord", hot_images.crowded(lines, hot_images.HOT_IMAGE, key), key)
    return placed.select(key, F.col("box_ord").cast("int").alias("box_ord"), "cls", "cx", "cy", "w", "h")


def _text_files(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, recursive=True).where(F.endswith("path", F.lit(".txt")))


def _stem_of(path: Column) -> Column:
    in_table = in_stem_folder(path)  # files written by ``write_labels``
    return F.when(in_table != "", in_table).otherwise(stem(path))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(stem, line_no, line)`` of all label files below ``folder``; ``line_no`` only orders lines."""
    if opened_path(folder) is not None:
        rows = read_ranges(_text_files(spark, folder))
        return rows.select(_stem_of(F.col("path")).alias("stem"), F.struct("path", "block", "row").alias("line_no"), "line")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(_stem_of(decoded(F.col("_metadata.file_path"))).alias("stem"), at.alias("line_no"), F.col("value").alias("line"))


def read_labels(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    return parse_lines(cut_lineage(read_lines(spark, folder)), mode)  # written, so that no file is opened twice


def read_label_table(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Labels from a table of lines ``(stem, line_no, line)``."""
    return parse_lines(spark.read.parquet(path), mode)


def read_label_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(stem, text)``: every label file as one text, empty ones too."""
    files = _text_files(spark, folder)
    if opened_path(folder) is not None:
        read = lambda file: file.read().removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
        return read_each(files, read, "text", pa.string()).select(_stem_of(F.col("path")).alias("stem"), "text")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    return reader.load(folder).select(_stem_of(decoded(F.col("path"))).alias("stem"), F.col("content").cast("string").alias("text"))


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """``stem`` of every label file, also of empty ones. Folders are listed in tasks."""
    return _text_files(spark, folder).select(_stem_of(F.col("path")).alias("stem")).distinct()


def for_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels joined to images by stem. Two images that share a stem share its labels."""
    keyed = images.select("image_id", stem(F.col("image_id")).alias("stem"))
    return keyed.join(labels, "stem").drop("stem")


def read_ownership(spark: SparkSession, path: str, images: DataFrame, files: DataFrame, layout: str = "list") -> DataFrame:
    """Human-owned images, limited to images that exist.

    ``list`` is one JSON list of image names, ``lines`` one JSON object per image. Where the record is
    missing or unreadable, every image with a label file counts as human.
    """
    try:
        if layout == "lines":
            lines = spark.read.text(path).where(F.trim("value") != "")
            parsed = lines.select(F.from_json("value", "image_id string")["image_id"].alias("image_id"))
            listed = parsed.where(F.col("image_id").isNotNull())
            # no line at all says that nobody owns anything; lines of which none can be read say nothing
            readable = listed.limit(1).count() > 0 or parsed.limit(1).count() == 0
        else:
            text = spark.read.text(path, wholetext=True)
            names = text.select(F.from_json("value", "array<string>").alias("names")).where(F.col("names").isNotNull())
            readable = names.limit(1).count() > 0
            listed = names.select(F.explode("names").alias("image_id"))
    except AnalysisException:
        readable = False
    if readable:
        return images.join(listed, "image_id", "left_semi").select("image_id")
    keyed = images.select("image_id", stem(F.col("image_id")).alias("stem"))
    return keyed.join(files, "stem", "left_semi").select("image_id")


def read_classes(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """The image folder a class list was saved for (None in the old list-only format) and the list."""
    try:
        text = spark.read.text(path, wholetext=True)
        row = text.select(
            F.from_json("value", "struct<images:string,classes:array<string>>").alias("o"),
            F.from_json("value", "array<string>").alias("l"),
        ).first()
    except AnalysisException:
        return None, []
    if row is None:
        return None, []
    if row["o"] is not None and row["o"]["classes"] is not None:
        return row["o"]["images"] or "", list(row["o"]["classes"])
    return None, list(row["l"] or [])
