"""Queries that write folders of files from the given tables and read them back."""

from pyspark.sql import functions as F

from annospark.registry import sql as q
from annospark.registry.base import register
from annospark.registry.formats import _scratch
from annospark.sinks import named_files
from annospark.sources import images, labels

# customers stand for images, orders for their boxes; names are awkward on purpose
STEM = "concat(CASE WHEN c_custkey % 3 = 0 THEN '_a b' WHEN c_custkey % 3 = 1 THEN '.é%20' ELSE 'x=1+' END, c_custkey)"
FILED = (
    "filed",
    f"""SELECT {STEM} AS stem, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey)::INT - 1 AS box_ord, (o_orderkey % 7)::INT AS cls,
      (20 + o_orderkey % 60)::DOUBLE / 100 AS cx, (25 + o_orderkey % 50)::DOUBLE / 100 AS cy, (1 + o_orderkey % 19)::DOUBLE / 50 AS w, (1 + o_orderkey % 23)::DOUBLE / 50 AS h
      FROM customer JOIN orders ON o_custkey = c_custkey""",
)


def _stem():
    third = F.col("c_custkey") % 3
    return F.concat(F.when(third == 0, "_a b").when(third == 1, ".é%20").otherwise("x=1+"), "c_custkey")


def _label_folder(t):
    path = _scratch(t, "label-files")
    stems = t.table("customer").select("c_custkey", _stem().alias("stem"))
    o = F.col("o_orderkey")
    boxes = stems.join(t.table("orders"), F.col("o_custkey") == F.col("c_custkey")).select(
        "stem",
        o.alias("box_ord"),
        (o % 7).cast("int").alias("cls"),
        ((20 + o % 60).cast("double") / 100).alias("cx"),
        ((25 + o % 50).cast("double") / 100).alias("cy"),
        ((1 + o % 19).cast("double") / 50).alias("w"),
        ((1 + o % 23).cast("double") / 50).alias("h"),
    )
    named_files.write_label_files(stems, boxes, path)
    return path


@register("label_files_round_trip", q.query("SELECT stem, box_ord, cls, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM filed", FILED))
def label_files_round_trip(t):
    return labels.read_labels(t.spark, _label_folder(t))


@register("label_files_listed", f"SELECT {STEM} AS stem FROM customer")
def label_files_listed(t):
    """Customers without an order have an empty file."""
    return labels.label_files(t.spark, _label_folder(t))


@register(
    "label_file_join",
    q.query("SELECT concat(stem, ending) AS image_id, box_ord, cls, cx FROM filed, (VALUES ('.jpg'), ('.v2.png')) e(ending) WHERE ending = '.jpg'", FILED),
)
def label_file_join(t):
    """Two images for each customer: the label file belongs to the one with its stem."""
    names = t.table("customer").select(F.explode(F.array(F.concat(_stem(), F.lit(".jpg")), F.concat(_stem(), F.lit(".v2.png")))).alias("image_id"))
    return labels.for_images(names, labels.read_labels(t.spark, _label_folder(t))).select("image_id", "box_ord", "cls", "cx")


@register("label_texts", q.query(f"SELECT {STEM} AS stem, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_lines FROM customer"))
def label_texts(t):
    texts = labels.read_label_texts(t.spark, _label_folder(t))
    return texts.select("stem", F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"))


# parts stand for image files of several formats
ENDINGS = (".png", ".JPG", ".gif", ".bmp", ".Png", ".webp", ".tif", ".txt")


def _image_folder(t):
    """A header for each part: PNG, GIF, BMP by the part's number; every fourth file is no image."""
    path = _scratch(t, "images")
    key = F.col("p_partkey")
    bytes_of = lambda v, n: F.unhex(F.lpad(F.hex(v), 2 * n, "0"))
    wide, high = F.col("p_size") * 7, key % 1000 + 1
    little = lambda v, n: F.concat(*[bytes_of(F.shiftright(v, 8 * i) % 256, 1) for i in range(n)])
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), bytes_of(wide, 4), bytes_of(high, 4), F.unhex(F.lit("0802000000")))
    gif = F.concat(F.encode(F.lit("GIF89a"), "UTF-8"), little(wide, 2), little(high, 2), F.unhex(F.lit("000000")))
    bmp = F.concat(F.encode(F.lit("BM"), "UTF-8"), F.unhex(F.lit("00000000000000003600000028000000")), little(wide, 4), little(high, 4), F.unhex(F.lit("01001800")))
    bad = F.encode(F.col("p_name"), "UTF-8")
    content = F.when(key % 4 == 0, png).when(key % 4 == 1, gif).when(key % 4 == 2, bmp).otherwise(bad)
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (key % 8 + 1).cast("int"))
    named_files.write_named(t.table("part").select(F.concat(F.lit("p"), key, ending).alias("name"), content.alias("content"), key.alias("at")), path, "at")
    return path


IMAGE_FILES = ("image_files", f"SELECT concat('p', p_partkey, ({list(ENDINGS)})[p_partkey % 8 + 1]) AS image_id, p_partkey, p_size FROM part")


@register("list_images_in_folder", q.query("SELECT image_id FROM image_files WHERE p_partkey % 8 IN (0, 1, 3)", IMAGE_FILES))
def list_images_in_folder(t):
    return images.list_images(t.spark, _image_folder(t)).select("image_id")


@register("list_images_wide_in_folder", q.query("SELECT image_id FROM image_files WHERE p_partkey % 8 NOT IN (2, 7)", IMAGE_FILES))
def list_images_wide_in_folder(t):
    return images.list_images(t.spark, _image_folder(t), wide=True).select("image_id")


@register(
    "image_sizes",
    q.query(
        """SELECT image_id, CASE WHEN p_partkey % 4 <> 3 THEN (p_size * 7)::INT END AS width, CASE WHEN p_partkey % 4 <> 3 THEN (p_partkey % 1000 + 1)::INT END AS height,
      p_partkey % 4 <> 3 AS readable FROM image_files WHERE p_partkey % 8 NOT IN (2, 7)""",
        IMAGE_FILES,
    ),
)
def image_sizes(t):
    """Endings do not tell the format; the first bytes do."""
    return images.image_sizes(t.spark, _image_folder(t))
