"""Image files: listing, sizes and crops."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.functions.geometry import Box, box, crop_window, crop_window_float
from annospark.functions.names import IMAGE_ENDINGS, IMAGE_ENDINGS_WIDE, decoded, ends_with_any, file_name
from annospark.sources.folders import list_files, opened_path, read_each
from annospark.sources.image_headers import size_of


def list_images(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """``(image_id, path)``; ``wide`` accepts more endings, in any case."""
    files = list_files(spark, folder)
    ok = ends_with_any(F.col("path"), IMAGE_ENDINGS_WIDE if wide else IMAGE_ENDINGS, ignore_case=wide)
    return files.where(ok).select(file_name(F.col("path")).alias("image_id"), "path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(image_id, width, height, channels, data, readable)``, decoded by Spark's image source (BGR rows).

    Files with an image ending are read. One that cannot be decoded, as some formats cannot, keeps its row: ``readable`` is false, the rest null.
    """
    i = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")
    i = i.where(ends_with_any(decoded(F.col("origin")), IMAGE_ENDINGS_WIDE, ignore_case=True))
    ok = F.coalesce(F.col("width") > 0, F.lit(False))
    shown = lambda column, name: F.when(ok, F.col(column)).alias(name)
    return i.select(
        file_name(decoded(F.col("origin"))).alias("image_id"),
        shown("width", "width"),
        shown("height", "height"),
        shown("nChannels", "channels"),
        shown("data", "data"),
        ok.alias("readable"),
    )


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``(image_id, width, height, readable)`` of the images in a folder, from their headers.

    A few hundred bytes of each file are read in tasks. A file that is no image keeps its row: ``readable`` is false, the
    sizes are null. In stores that only Spark reads, images are decoded.
    """
    if opened_path(folder) is None:
        return read_images(spark, folder).select("image_id", "width", "height", "readable")
    found = read_each(list_images(spark, folder, wide=True), size_of, "size", pa.list_(pa.int32()))
    return found.select("image_id", F.col("size")[0].alias("width"), F.col("size")[1].alias("height"), F.col("size").isNotNull().alias("readable"))


CROP_SCHEMA = "image_id string, box_id string, width int, height int, pixels binary"


def _planes(row):
    import numpy as np

    pixels = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(pixels, 3, axis=2) if row.channels == 1 else pixels[:, :, :3]


BOXES_PER_ROW = 64  # boxes that are cut from one copy of an image, on average


def _cut(images: DataFrame, boxes: DataFrame, window, make) -> DataFrame:
    """Crops ``make(planes, row, box) -> (width, height, bytes)`` of all boxes whose ``window`` is not degenerate.

    Boxes are gathered in chunks of about ``BOXES_PER_ROW``, so an image's pixels move once per chunk and are
    decoded once for all boxes in it; an image with very many boxes spreads over its chunks.
    """
    own = boxes.select("image_id", "box_id", *Box._fields)
    chunks = own.groupBy("image_id").agg(F.ceil(F.count("*") / BOXES_PER_ROW).alias("n"))
    dealt = own.join(chunks, "image_id").withColumn("chunk", F.pmod(F.xxhash64("box_id", *Box._fields), F.col("n")))
    gathered = dealt.groupBy("image_id", "chunk").agg(F.collect_list(F.struct("box_id", *Box._fields)).alias("boxes"))

    def placed(x):
        inside = window(Box(*(x[c] for c in Box._fields)), F.col("width"), F.col("height"))
        return F.struct(x["box_id"].alias("box_id"), *[c.alias(n) for n, c in zip(Box._fields, inside)])

    usable = F.filter(F.transform("boxes", placed), lambda x: (x["x2"] > x["x1"]) & (x["y2"] > x["y1"]))
    rows = images.join(gathered, "image_id").withColumn("boxes", usable).where(F.size("boxes") > 0)

    def cut(batches):
        import pandas as pd

        for batch in batches:
            found = []
            for row in batch.itertuples():
                planes = _planes(row)
                found += [(row.image_id, b["box_id"], *make(planes, row, b)) for b in row.boxes]
            yield pd.DataFrame(found, columns=["image_id", "box_id", "width", "height", "pixels"])

    return rows.select("image_id", "width", "height", "channels", "data", "boxes").mapInPandas(cut, CROP_SCHEMA)


def extract_crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of every box that is not degenerate inside its image; the row keeps its ``box_id``."""

    def whole(planes, row, b):
        return b["x2"] - b["x1"], b["y2"] - b["y1"], planes[b["y1"] : b["y2"], b["x1"] : b["x2"]].tobytes()

    return _cut(images, boxes, crop_window, whole)


def crop_resize(images: DataFrame, boxes: DataFrame, side: int = 256) -> DataFrame:
    """Crops scaled to ``side x side`` by bilinear interpolation; boxes are ordered and clipped first."""

    def scaled(planes, row, b):
        import numpy as np

        def axis(low, high, size):
            at = np.clip(low + (np.arange(side) + 0.5) * (high - low) / side - 0.5, 0, size - 1)
            first = np.floor(at).astype(int)
            return first, np.minimum(first + 1, size - 1), at - first

        x0, x1, fx = axis(b["x1"], b["x2"], row.width)
        y0, y1, fy = axis(b["y1"], b["y2"], row.height)
        fx, fy = fx[None, :, None], fy[:, None, None]
        upper, lower = planes[y0].astype(np.float32), planes[y1].astype(np.float32)
        top = upper[:, x0] * (1 - fx) + upper[:, x1] * fx
        low = lower[:, x0] * (1 - fx) + lower[:, x1] * fx
        return side, side, np.rint(top * (1 - fy) + low * fy).astype(np.uint8).tobytes()

    return _cut(images, boxes, crop_window_float, scaled)


def read_crop_folders(spark: SparkSession, folder: str, good: str, noise: str) -> DataFrame:
    """``(path, y)`` of stored crops: files in the ``good`` folder are 1, in the ``noise`` folder 0."""
    part = lambda name, y: list_files(spark, f"{folder}/{name}").select("path", F.lit(y).alias("y"))
    return part(good, 1).unionByName(part(noise, 0)).where(ends_with_any(F.col("path"), (".jpg",)))
