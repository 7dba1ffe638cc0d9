"""Datasets on disk, found from one file listing.

Every function works on a listing table ``files(path)`` (see ``images.list_files``), so a store of many
datasets is grouped and joined like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from annospark.functions.names import (
    IMAGE_ENDINGS,
    IMAGE_ENDINGS_WIDE,
    decoded,
    ends_with_any,
    file_name,
    normal_name,
    stem,
)

SPLITS = {"train": ("train",), "val": ("val", "valid"), "test": ("test",)}


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def read_yamls(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of the dataset descriptions below a folder."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml")
    return reader.text(folder, wholetext=True).select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def _entry(text: Column, name: str) -> Column:
    """A top-level scalar of a description, without quotes; null when it is absent."""
    value = F.regexp_extract(text, rf"(?m)^{name}[ \t]*:[ \t]*([^#\r\n]*?)[ \t]*(?:#.*)?\r?$", 1)
    clean = F.regexp_replace(value, "^['\"]|['\"]$", "")
    return F.when(clean != "", clean)


MOST_CLASSES = 100_000


def _bounded(n: Column) -> Column:
    """A class id or count from a file; one that would make more than ``MOST_CLASSES`` rows is an error."""
    return F.when(n <= MOST_CLASSES, n).otherwise(F.raise_error(F.concat(F.lit("not so many classes: "), n.cast("string"))).cast("int"))


def class_names(yamls: DataFrame, use_count: bool = False, keep_ids: bool = False) -> DataFrame:
    """``(path, cls, name)`` from the ``names`` entry, as an inline list or as a block of ``id: name``.

    With ``use_count`` a description without names but with a class count ``nc`` names classes by number. A block
    is numbered in the order of its ids; with ``keep_ids``, as a loader reads it, names keep their ids and ids
    that are missing below the largest are named by their number.
    """
    clean = lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")
    inline = F.regexp_extract("text", r"(?ms)^\s*names:\s*\[(.*?)\]", 1)
    listed = F.filter(F.transform(F.split(inline, ","), clean), lambda x: x != "")
    rows_inline = yamls.where(inline != "").select("path", F.posexplode(listed).alias("cls", "name"))
    block = F.regexp_extract("text", r"(?m)^\s*names:[ \t]*\r?$\n?((?:^(?:[ \t]+.*|[ \t]*)\r?$\n?)*)", 1)
    # The two line shapes of a class list.
    ids = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+(\d+)\s*:\s*(.+?)[ \t\r]*$"), 1)
    names = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+(\d+)\s*:\s*(.+?)[ \t\r]*$"), 2)
    pairs = F.arrays_zip(ids.alias("i"), names.alias("n"))
    rows_block = yamls.where(inline == "").select("path", F.explode(pairs).alias("p"))
    order = Window.partitionBy("path").orderBy("id")
    numbered = rows_block.select("path", F.col("p.i").cast("int").alias("id"), clean(F.col("p.n")).alias("name"))
    if keep_ids:
        numbered = numbered.withColumn("id", _bounded(F.col("id")))
        last = numbered.groupBy("path").agg(F.max("id").alias("last"))
        every = last.select("path", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("id"))
        named = every.join(numbered.dropDuplicates(["path", "id"]), ["path", "id"], "left")
        numbered = named.select("path", F.col("id").alias("cls"), F.coalesce("name", F.col("id").cast("string")).alias("name"))
    else:
        numbered = numbered.select("path", (F.row_number().over(order) - 1).alias("cls"), "name")
    found = rows_inline.unionByName(numbered)
    if not use_count:
        return found
    count = _entry(F.col("text"), "nc").try_cast("int")
    unnamed = yamls.join(found.select("path").distinct(), "path", "left_anti").where(count > 0)
    by_number = unnamed.select("path", F.explode(F.sequence(F.lit(0), _bounded(count) - 1)).alias("cls"))
    return found.unionByName(by_number.withColumn("name", F.col("cls").cast("string")))


def image_folders(files: DataFrame, wide: bool = True) -> DataFrame:
    """``(folder, n)``: images directly in each folder."""
    ok = ends_with_any(F.col("path"), IMAGE_ENDINGS_WIDE if wide else IMAGE_ENDINGS, ignore_case=wide)
    return files.where(ok).groupBy(folder_of(F.col("path")).alias("folder")).agg(F.count("*").alias("n"))


def _split_counts(roots: DataFrame, folders: DataFrame) -> DataFrame:
    """Images per split of a root: the split's folder, an alias of it, or the unsplit image folder."""
    names = [n for aliases in SPLITS.values() for n in aliases]
    below = folders.withColumn("sub", F.regexp_extract("folder", r"/images(?:/([^/]+))?$", 1)).where(
        F.rlike("folder", F.lit(r"/images(/[^/]+)?$"))
    )
    root = F.regexp_replace("folder", r"/images(/[^/]+)?$", "")
    per_root = below.groupBy(root.alias("root")).agg(
        *[F.max(F.when(F.col("sub") == n, F.col("n"))).alias(f"in_{n}") for n in names],
        F.max(F.when(F.col("sub") == "", F.col("n"))).alias("unsplit"),
    )
    joined = roots.join(per_root, "root", "left")
    for split, aliases in SPLITS.items():
        found = F.coalesce(*[F.col(f"in_{a}") for a in aliases], F.col("unsplit"), F.lit(0))
        joined = joined.withColumn(f"n_{split}", found)
    return joined.drop(*[f"in_{n}" for n in names], "unsplit")


def expand_split(entries: DataFrame, files: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Image paths ``(root, entry, path)`` of split entries: a folder, a text list of paths, or a file.

    ``lists`` holds the lines ``(path, line)`` of list files. A relative line is looked up next to the
    list first and below the root otherwise.
    """
    resolved = entries.withColumn(
        "at", F.when(F.startswith("entry", F.lit("/")), F.col("entry")).otherwise(F.concat_ws("/", "root", "entry"))
    ).withColumn("at", F.regexp_replace(F.regexp_replace("at", r"/\./", "/"), r"/$", ""))
    image = files.where(ends_with_any(F.col("path"), IMAGE_ENDINGS_WIDE, ignore_case=True))
    in_folder = resolved.join(image.withColumn("at", folder_of(F.col("path"))), "at").select("root", "entry", "path")
    is_list = F.endswith(F.lower("at"), F.lit(".txt"))
    single = resolved.where(~is_list).join(files.withColumn("at", F.col("path")), "at").select("root", "entry", "path")
    found = in_folder.unionByName(single).distinct()
    if lists is None:
        return found
    lines = lists.select(F.col("path").alias("at"), F.trim("line").alias("line")).where(F.col("line") != "")
    near = F.concat_ws("/", folder_of(F.col("at")), F.regexp_replace("line", r"^\./", ""))
    far = F.concat_ws("/", "root", F.regexp_replace("line", r"^\./", ""))
    listed = resolved.where(is_list).join(lines, "at").withColumn("near", near)
    known = files.select(F.col("path").alias("near"), F.lit(True).alias("exists")).distinct()
    listed = listed.join(known, "near", "left")
    path = F.when(F.startswith("line", F.lit("/")), F.col("line")).when(F.col("exists"), F.col("near")).otherwise(far)
    return found.unionByName(listed.select("root", "entry", path.alias("path")))


def _allowed(name: Column, allow: list[str] | None) -> Column:
    """Exact match of normalised names, or one contained in the other."""
    if not allow:
        return F.lit(True)
    n = normal_name(name)
    wanted = F.array(*[normal_name(F.lit(a)) for a in dict.fromkeys(allow) if a])
    return (n != "") & F.exists(wanted, lambda a: (a != "") & (F.contains(n, a) | F.contains(a, n)))


def dataset_catalog(files: DataFrame, yamls: DataFrame, top: str, allow: list[str] | None = None) -> DataFrame:
    """Datasets below ``top``: folders with images one or two levels down, and described ones.

    Datasets of the same normalised name are the same dataset; the one with most images stays, a
    described one before an undescribed one. Largest first when ordered by ``place``.
    """
    every = files.select(folder_of(F.col("path")).alias("folder")).distinct()
    holders = every.where(F.rlike("folder", F.lit(r"/(images|labels)(/|$)"))).select(
        F.regexp_extract("folder", r"^(.*?)/(images|labels)(?:/|$)", 1).alias("root"),
        F.regexp_extract("folder", r"^(.*?)/(images|labels)(?:/|$)", 2).alias("kind"),
    ).distinct()
    with_images = holders.where(F.col("kind") == "images").select("root").distinct()
    level = F.size(F.split(F.regexp_replace("root", F.lit("^" + _quoted(top) + "/"), F.lit("")), "/"))
    below = with_images.where(F.startswith("root", F.lit(top + "/"))).withColumn("level", level)
    shallow = below.where(F.col("level") == 1).select("root")
    deep = below.where(F.col("level") == 2).select("root", folder_of(F.col("root")).alias("parent"))
    deep = deep.join(shallow.withColumnRenamed("root", "parent"), "parent", "left_anti").select("root")
    plain = shallow.unionByName(deep).withColumn("yaml", F.lit(None).cast("string"))

    has = holders.select("root").distinct()
    y = yamls.where(F.coalesce(*[_entry(F.col("text"), s) for s in SPLITS]).isNotNull())
    base, named_root = folder_of(F.col("path")), _entry(F.col("text"), "path")
    direct = F.when(named_root.isNull(), base).when(F.startswith(named_root, F.lit("/")), named_root).otherwise(
        F.concat_ws("/", base, named_root)
    )
    y = y.select(F.col("path").alias("yaml"), base.alias("base"), F.regexp_replace(direct, r"/\.?$", "").alias("direct"))
    known = lambda column, flag: has.select(F.col("root").alias(column), F.lit(True).alias(flag))
    y = y.withColumn("parent", folder_of(F.col("direct")))
    y = y.join(known("direct", "ok_direct"), "direct", "left").join(known("base", "ok_base"), "base", "left")
    y = y.join(with_images.select(F.col("root").alias("parent"), F.lit(True).alias("ok_parent")), "parent", "left")
    doubled = (file_name(F.col("direct")) == stem(F.col("yaml"))) & F.col("ok_parent")
    root = F.when(F.col("ok_direct"), F.col("direct")).when(doubled, F.col("parent")).when(
        F.col("ok_base"), F.col("base")
    ).otherwise(F.col("direct"))
    described = y.select(root.alias("root"), "yaml")

    specs = plain.unionByName(described).withColumn("name", file_name(F.col("root")))
    specs = _split_counts(specs.where(_allowed(F.col("name"), allow)), image_folders(files))
    specs = specs.withColumn("n_images", F.col("n_train") + F.col("n_val") + F.col("n_test"))
    specs = specs.withColumn("key", normal_name(F.col("name")))
    best = Window.partitionBy("key").orderBy(F.desc("n_images"), F.col("yaml").isNull(), "root", "yaml")
    kept = specs.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).drop("__n")
    return kept.select("name", "key", "root", "yaml", "n_train", "n_val", "n_test", "n_images").orderBy(
        F.desc("n_images"), "key"
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def dataset_presets(files: DataFrame, yamls: DataFrame, top: str) -> DataFrame:
    """Ready-made datasets: training images, training labels and named classes directly below ``top``."""
    root = F.regexp_extract("folder", "^(" + _quoted(top) + r"/[^/]+)/((?:images|labels)/(?:train|val))$", 1)
    part = F.regexp_extract("folder", "^(" + _quoted(top) + r"/[^/]+)/((?:images|labels)/(?:train|val))$", 2)
    folders = files.select(folder_of(F.col("path")).alias("folder")).distinct().withColumn("root", root).withColumn("part", part)
    has = folders.where(F.col("root") != "").groupBy("root").agg(F.collect_set("part").alias("parts"))
    ready = has.where(F.array_contains("parts", "images/train") & F.array_contains("parts", "labels/train"))
    counts = image_folders(files, wide=False)
    n = lambda sub: counts.where(F.endswith("folder", F.lit("/images/" + sub))).select(
        F.regexp_replace("folder", "/images/" + sub + "$", "").alias("root"), F.col("n").alias(f"{sub}_images")
    )
    first = yamls.withColumn("root", folder_of(F.col("path"))).groupBy("root").agg(F.min("path").alias("path"))
    names = class_names(yamls).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("cls", "name"))).alias("c"))
    return (
        ready.select("root")
        .join(first, "root")
        .join(names, "path")
        .join(n("train"), "root", "left")
        .join(n("val"), "root", "left")
        .select(
            file_name(F.col("root")).alias("name"),
            F.array_join(F.col("c.name"), ",").alias("classes"),
            F.size("c").alias("num_classes"),
            F.coalesce("train_images", F.lit(0)).alias("train_images"),
            F.coalesce("val_images", F.lit(0)).alias("val_images"),
        )
    )
