"""Queries over class lists, dataset descriptions, stored crops and reports."""

from pyspark.sql import functions as F

from annospark.registry import sql as q
from annospark.registry.base import register
from annospark.registry.formats import _pixels, _scratch
from annospark.sinks import documents, exports, named_files
from annospark.sources import catalog, images, labels, overlay

# -- class lists and descriptions ---------------------------------------------------------------
# a dataset for each region with its nations as classes; odd regions list them inline, even ones by id
YAMLS = (
    "yamls",
    """SELECT r_regionkey AS r, concat('/data/set ', r_regionkey, '/data.yaml') AS path, n_nationkey, n_name,
      (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS cls FROM region JOIN nation ON n_regionkey = r_regionkey""",
)


def _yamls(t):
    named = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = named.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("c"))
    block = F.concat(F.lit("names:\n"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("  "), x["n_nationkey"], F.lit(": \""), x["n_name"], F.lit("\"  \n"))), ""))
    inline = F.concat(F.lit("names: ['"), F.array_join(F.transform("c", lambda x: x["n_name"]), "', '"), F.lit("']\n"))
    text = F.concat(F.lit("path: .\ntrain: images/train # folder\nval: images/val\n"), F.when(F.col("r_regionkey") % 2 == 1, inline).otherwise(block), F.lit("nc: 99\n"))
    return rows.select(F.concat(F.lit("/data/set "), "r_regionkey", F.lit("/data.yaml")).alias("path"), text.alias("text"))


@register("class_names_from_yaml", q.query("SELECT path, cls, n_name AS name FROM yamls", YAMLS))
def class_names_from_yaml(t):
    return catalog.class_names(_yamls(t)).select("path", F.col("cls").cast("int").alias("cls"), "name")


@register(
    "class_names_with_ids",
    q.query(
        """SELECT path, cls, n_name AS name FROM yamls WHERE r % 2 = 1 UNION ALL
      SELECT l.path, i::INT AS cls, coalesce(n_name, i::VARCHAR) AS name FROM (SELECT path, unnest(range(max(n_nationkey) + 1)) AS i FROM yamls WHERE r % 2 = 0 GROUP BY path) l
      LEFT JOIN yamls y ON y.path = l.path AND y.n_nationkey = i""",
        YAMLS,
    ),
)
def class_names_with_ids(t):
    """Names keep their ids; ids that are missing are named by their number."""
    return catalog.class_names(_yamls(t), keep_ids=True).select("path", F.col("cls").cast("int").alias("cls"), "name")


# customers are the images of their region's dataset; the last region has no labels
DATASET = (
    "dataset",
    """SELECT n_regionkey AS r, c_custkey, c_custkey % 5 = 0 AS val FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)


def _dataset_files(t):
    c = t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.when(F.col("c_custkey") % 5 == 0, "val/").otherwise("train/")
    path = lambda kind, ending: F.concat(F.lit("/data/set "), "n_regionkey", F.lit(f"/{kind}/"), part, "c_custkey", F.lit(ending))
    labelled = c.where("n_regionkey < 4").select(path("labels", ".txt").alias("path"))
    return c.select(path("images", ".png").alias("path")).unionByName(labelled)


@register(
    "dataset_presets",
    q.query(
        """SELECT concat('set ', y.r) AS name, classes, num_classes, train_images, val_images FROM (
      SELECT r, string_agg(n_name, ',' ORDER BY cls) AS classes, count(*)::INT AS num_classes FROM yamls GROUP BY r) y JOIN (
      SELECT r, count(*) FILTER (NOT val) AS train_images, count(*) FILTER (val) AS val_images FROM dataset GROUP BY r) d ON d.r = y.r WHERE y.r < 4""",
        YAMLS,
        DATASET,
    ),
)
def dataset_presets(t):
    return catalog.dataset_presets(_dataset_files(t), _yamls(t), "/data")


@register(
    "dataset_catalog_described",
    q.query(
        """SELECT concat('set ', r) AS name, concat('set-', r) AS key, concat('/data/set ', r, '/data.yaml') AS yaml, count(*) FILTER (NOT val) AS n_train,
      count(*) FILTER (val) AS n_val, 0::BIGINT AS n_test, count(*) AS n_images FROM dataset WHERE r <> 2 GROUP BY r""",
        DATASET,
    ),
)
def dataset_catalog_described(t):
    """Every dataset is found as a folder and by its description, which wins; names on the list are taken only."""
    allow = [f"Set_{r}" for r in (0, 1, 3, 4)]
    return catalog.dataset_catalog(_dataset_files(t), _yamls(t), "/data", allow).drop("root")


@register("class_list_round_trip", "SELECT n_nationkey AS cls, n_name AS name, '/data/flags' AS images FROM nation")
def class_list_round_trip(t):
    path = _scratch(t, "classes")
    exports.write_classes(t.table("nation").select(F.col("n_nationkey").alias("cls"), F.col("n_name").alias("name")), "/data/flags", path)
    where, names = labels.read_classes(t.spark, path)
    listed = t.spark.createDataFrame([(names,)], "names array<string>")
    return listed.select(F.posexplode("names").alias("cls", "name")).select(F.col("cls").cast("int").alias("cls"), "name", F.lit(where).alias("images"))


@register("overlay_image_ids", q.query("SELECT image_id::VARCHAR AS image_id FROM images"))
def overlay_image_ids(t):
    """One overlay document in parts, every third image of which has no candidate."""
    path = _scratch(t, "overlay-document")
    boxes = t.candidates.where("image_id % 3 <> 0").withColumn("box_id", F.concat_ws(":", "image_id", "box_ord"))
    documents.write_overlay_document(t.images, boxes, path)
    return overlay.overlay_image_ids(t.spark, path, parts=True)


# -- crops and reports --------------------------------------------------------------------------
@register("crop_folders", "SELECT concat('crop ', p_partkey, '.jpg') AS name, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS y FROM part WHERE p_partkey % 4 <> 1")
def crop_folders(t):
    """Good and noise crops in folders of their own; files with other endings are no crops."""
    path, key = _scratch(t, "crops"), F.col("p_partkey")
    ending = F.when(key % 4 == 1, ".png").otherwise(".jpg")
    rows = t.table("part").select(F.concat(F.lit("crop "), key, ending).alias("name"), F.encode("p_name", "UTF-8").alias("content"), key.alias("at"))
    named_files.write_named(rows.where("at % 3 <> 0"), f"{path}/good", "at")
    named_files.write_named(rows.where("at % 3 = 0"), f"{path}/noise", "at")
    crops = images.read_crop_folders(t.spark, path, "good", "noise")
    return crops.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "y")


@register("write_crops", q.query("SELECT CASE WHEN p_good >= 0.5 THEN 1 ELSE 0 END AS y, count(*) AS n FROM candidates GROUP BY 1"))
def write_crops(t):
    return exports.write_crops(t.candidates.withColumn("y", (F.col("p_good") >= 0.5).cast("int")), _scratch(t, "crops"))


@register("run_report", q.query("SELECT run, label, count(*) AS boxes FROM candidates, (VALUES ('first'), ('second')) r(run) GROUP BY ALL"))
def run_report(t):
    """Two runs added to one report."""
    path = _scratch(t, "report")
    for run in ("first", "second"):
        exports.append_report(t.candidates.groupBy("label").agg(F.count("*").alias("boxes")).withColumn("run", F.lit(run)), path)
    return t.spark.read.parquet(path)


@register(
    "crop_resize",
    """SELECT vec_id::VARCHAR AS image_id, array_to_string(list_transform(range(16), lambda i: repeat(printf('%02X', round_even(
      (px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2] + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4.0::DOUBLE, 0)::INT), 3)), '') AS pixels
      FROM (SELECT vec_id, list_transform(embedding, lambda v: (abs(floor(v::DOUBLE * 100)) % 256)::INT) AS px FROM embeddings)""",
)
def crop_resize(t):
    """Whole images of 8 by 8 pixels at half their size: every pixel is the mean of four."""
    v = F.col("vec_id").cast("string")
    corners = {"x1": 0.0, "y1": 0.0, "x2": 8.0, "y2": 8.0}
    boxes = t.table("embeddings").select(v.alias("image_id"), v.alias("box_id"), *[F.lit(c).alias(n) for n, c in corners.items()])
    return images.crop_resize(_pixels(t), boxes, 4).select("image_id", F.hex("pixels").alias("pixels"))
