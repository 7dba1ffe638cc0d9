"""Seeds, splits and caps. Draws are ordered by a hash, so they are reproducible and parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from annospark.functions.hashing import order_key
from annospark.functions.scores import half_even
from annospark.operators.order_stats import kth_largest, running
from annospark.session import cut_lineage

# above this many seed images per class the firsts are numbered across tasks
SMALL_QUOTA = 1000


def class_images(boxes: DataFrame) -> DataFrame:
    """Distinct ``(image_id, cls)`` of boxes with a positive size."""
    return boxes.where((F.col("w") > 0) & (F.col("h") > 0)).select("image_id", "cls").distinct()


def per_class_image_counts(boxes: DataFrame) -> DataFrame:
    return class_images(boxes).groupBy("cls").agg(F.count("*").alias("images"))


def seed_quota(boxes: DataFrame, classes: DataFrame, percent: float = 0.0, count: int = 0) -> DataFrame:
    """Seed images wanted per class: a flat count, or a share of the images that contain the class.

    A class that occurs at all gets at least one image.
    """
    if percent <= 0:
        return classes.select("cls", F.lit(int(count)).cast("long").alias("quota"))
    wanted = F.greatest(F.lit(1), half_even(F.col("images") * (percent / 100.0)))
    have = classes.join(per_class_image_counts(boxes), "cls", "left")
    return have.select("cls", F.when(F.col("images") > 0, wanted).otherwise(0).cast("long").alias("quota"))


def draw_seed(boxes: DataFrame, quota: DataFrame, seed: int = 42) -> DataFrame:
    """Images of a class-balanced seed.

    Walking the images in random order and taking one while any of its classes is short takes, for
    every class, its first ``quota`` images. So the draw is the union of those firsts.
    """
    most = quota.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    having = class_images(boxes).withColumn("__h", order_key(seed, "image_id"))
    if most <= SMALL_QUOTA:
        # the literal bound lets each task drop all but ``most`` images per class before the shuffle
        order = Window.partitionBy("cls").orderBy("__h", "image_id")
        firsts = having.withColumn("place", F.row_number().over(order)).where(F.col("place") <= int(most))
    else:
        firsts = running(having, ["__h", "image_id"], {"place": F.lit(1).cast("long")}, ["cls"])
    taken = firsts.join(quota, "cls").where(F.col("place") <= F.col("quota"))
    return taken.select("image_id").distinct()


def first_by_hash(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly the first ``n`` rows in hash order, found by an order statistic instead of a sort."""
    marked = rows.withColumn("__h", order_key(seed, *keys))
    if n <= 0:
        return marked.limit(0).drop("__h")
    cut = kth_largest(marked.withColumn("__neg", -F.col("__h").cast("double")), "__neg", n)
    if cut is None:
        return marked.drop("__h")
    sure = marked.where(-F.col("__h").cast("double") > cut)
    # rows that share the hash at the cut are taken in key order
    on_cut = marked.where(-F.col("__h").cast("double") == cut).orderBy("__h", *keys).limit(n - sure.count())
    return sure.unionByName(on_cut).drop("__h")


def holdout_split(boxes: DataFrame, share: float = 0.2, seed: int = 42, class_aware: bool = True) -> DataFrame:
    """``(image_id, split)`` for labelled images; an image may be in both splits.

    When training would miss a class, one held-out image per initially missing class moves back. With
    nothing held out, all images serve as validation too.
    """
    images = boxes.select("image_id").distinct()
    n = images.count()
    held = max(1, round(n * share)) if n >= 2 else 0
    val = first_by_hash(images, held, seed, "image_id")
    if class_aware:
        val = val.join(_rescued(boxes, val), "image_id", "left_anti")
    train = images.join(val, "image_id", "left_anti").withColumn("split", F.lit("train"))
    if val.limit(1).count():
        return train.unionByName(val.withColumn("split", F.lit("val")))
    return train.unionByName(train.withColumn("split", F.lit("val")))


def _rescued(boxes: DataFrame, val: DataFrame) -> DataFrame:
    """For each class that only held-out images have, in class order: its first image not yet moved.

    Every class asks for its first image and an image goes to the smallest class that asks; the others ask for their next one, until
    no image is asked for twice. That is what taking the classes in turn gives, in as many rounds as classes stand in each other's way.
    """
    having = boxes.select("image_id", "cls").where("cls IS NOT NULL").distinct()
    trained = having.join(val, "image_id", "left_anti").select("cls").distinct()
    missing = cut_lineage(having.join(val, "image_id", "left_semi").join(trained, "cls", "left_anti"))
    first = lambda images: images.groupBy("cls").agg(F.min("image_id").alias("image_id"))
    asking = cut_lineage(first(missing))
    while True:
        judged = asking.join(asking.groupBy("image_id").agg(F.min("cls").alias("winner")), "image_id")
        lost = judged.where("cls <> winner").select("cls", F.col("image_id").alias("tried"))
        if not lost.limit(1).count():
            return asking.select("image_id")
        others = first(missing.join(lost, "cls").where(F.col("image_id") > F.col("tried")))
        asking = cut_lineage(judged.where("cls = winner").select("cls", "image_id").unionByName(others))


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with a ``split``: every class with two or more rows is in both splits.

    Single rows train; when that leaves no validation rows, one row of all moves there. Per class the
    cut is an order statistic on the hash, so a class may hold any share of the rows.
    """
    marked = rows.withColumn("__h", order_key(seed, key))
    n, wanted = F.col("__n"), half_even(F.col("__n") * share)
    counts = marked.groupBy(label).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__k", F.least(F.greatest(F.lit(1), wanted), n - 1)).drop("__n")
    placed = running(marked, ["__h", key], {"__place": F.lit(1).cast("long")}, [label])
    split = F.when(F.col("__place") <= F.col("__k"), "val").otherwise("train")
    counts = counts.withColumnRenamed(label, "__label")  # a null label is a class like any other
    out = placed.join(counts, F.col(label).eqNullSafe(F.col("__label"))).withColumn("split", split).drop("__k", "__place", "__h", "__label")
    if out.where(F.col("split") == "val").limit(1).count():
        return out
    moved = first_by_hash(rows, 1, seed, key).select(key, F.lit(True).alias("__moved"))
    return out.join(moved, key, "left").withColumn(
        "split", F.when(F.col("__moved"), "val").otherwise(F.col("split"))
    ).drop("__moved")


def random_split(rows: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly ``int(n * share)`` rows to ``val``."""
    val = first_by_hash(rows, int(rows.count() * share), seed, key)
    train = rows.join(val.select(key), key, "left_anti")
    return val.withColumn("split", F.lit("val")).unionByName(train.withColumn("split", F.lit("train")))


def cap_crops(crops: DataFrame, most: int, trim: bool = False) -> DataFrame:
    """Whole images in listing order until ``most`` crops are reached.

    The last image may exceed the limit unless ``trim`` cuts its crops (by ``crop_ord``) as well.
    """
    if trim:
        counted = running(crops, ["image_id", "crop_ord"], {"upto": F.lit(1).cast("long")})
        return counted.where(F.col("upto") <= most).drop("upto")
    sizes = crops.groupBy("image_id").agg(F.count("*").alias("n"))
    taken = running(sizes, ["image_id"], {"upto": F.col("n")}).where(F.col("upto") - F.col("n") < most)
    return crops.join(taken.select("image_id"), "image_id", "left_semi")
