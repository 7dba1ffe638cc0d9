"""Queries over readers, writers, datasets on disk and event streams."""

import uuid

from pyspark.sql import functions as F

from annospark import fixtures as fx
from annospark.operators import acceptance as ac, matching, status
from annospark.registry import sql as q
from annospark.registry.base import register
from annospark.session import cut_lineage, shared_dir
from annospark.sinks import documents, exports
from annospark.sources import catalog, images, labels, overlay
from annospark.streaming import events as ev


def _scratch(t, name):
    return f"{shared_dir(t.spark)}/annospark-{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# -- exports ------------------------------------------------------------------------------------
@register("coco_images", q.query("SELECT row_number() OVER (ORDER BY image_id) AS id, image_id AS file_name, width, height FROM images"))
def coco_images(t):
    return exports.coco_images(t.images)


@register(
    "coco_annotations",
    q.query(
        """SELECT row_number() OVER (ORDER BY no, box_ord) AS id, no AS image_id, cls+1 AS category_id, x1 AS x, y1 AS y, x2-x1 AS w, y2-y1 AS h,
      (x2-x1)*(y2-y1) AS area, 0 AS iscrowd FROM (
      SELECT no, box_ord, cls, greatest(0.0::DOUBLE, (cx-w/2)*640) AS x1, greatest(0.0::DOUBLE, (cy-h/2)*480) AS y1,
        least(640.0::DOUBLE, (cx+w/2)*640) AS x2, least(480.0::DOUBLE, (cy+h/2)*480) AS y2 FROM gold_norm
        JOIN (SELECT image_id, row_number() OVER (ORDER BY image_id) AS no FROM images) USING (image_id)) WHERE x2 > x1 AND y2 > y1"""
    ),
)
def coco_annotations(t):
    rows = exports.coco_annotations(exports.coco_images(t.images), fx.with_centre(t.gold))
    part = {name: F.col("bbox")[i] for i, name in enumerate(("x", "y", "w", "h"))}
    return rows.withColumns(part).drop("bbox")


@register("coco_categories", q.query("SELECT label+1 AS id, concat('class_', label) AS name FROM gold GROUP BY label"))
def coco_categories(t):
    return exports.coco_categories(status.infer_classes(fx.with_centre(t.gold)))


ACCEPTED = (
    "acc",
    """SELECT image_id, box_ord, x1, y1, x2, y2, p_good AS score, concat(image_id, ':', box_ord) AS box_id,
      coalesce((['cat','dog','bird'])[label+1], label::VARCHAR) AS class_name FROM candidates WHERE p_good >= 0.3""",
)
BAND = "CASE WHEN score >= 0.65 THEN 'green' WHEN score >= 0.35 THEN 'amber' WHEN score IS NOT NULL THEN 'red' END"


def _accepted(t):
    chosen = ac.with_score(t.candidates).where(F.col("score") >= 0.3)
    named = status.with_class_name(chosen, t.classes).withColumn("box_id", F.concat_ws(":", "image_id", "box_ord"))
    return named.select("image_id", "box_ord", "x1", "y1", "x2", "y2", "score", "box_id", "class_name")


def _metas(t):
    return t.images.withColumn("ref", F.concat(F.lit("images/"), "image_id", F.lit(".jpg")))


@register(
    "label_studio_regions",
    q.query(
        f"""SELECT i.image_id, concat('images/', i.image_id, '.jpg') AS ref, 640 AS original_width, 480 AS original_height, box_ord,
      x1*100.0::DOUBLE/640 AS x, y1*100.0::DOUBLE/480 AS y, (x2-x1)*100.0::DOUBLE/640 AS width, (y2-y1)*100.0::DOUBLE/480 AS height,
      class_name, box_id AS pg_box_id, score AS pg_score, {BAND} AS pg_band FROM images i LEFT JOIN acc a ON a.image_id = i.image_id""",
        ACCEPTED,
    ),
)
def label_studio_regions(t):
    return exports.label_studio_regions(_metas(t), _accepted(t))


@register(
    "label_studio_tasks",
    q.query(
        """SELECT i.image_id AS pg_image_id, concat('images/', i.image_id, '.jpg') AS image, 'annospark' AS model_version, count(a.image_id)::INT AS regions
      FROM images i LEFT JOIN acc a ON a.image_id = i.image_id GROUP BY i.image_id""",
        ACCEPTED,
    ),
)
def label_studio_tasks(t):
    tasks = exports.label_studio_tasks(exports.label_studio_regions(_metas(t), _accepted(t)))
    p = F.col("predictions")[0]
    return tasks.select("data.pg_image_id", "data.image", p["model_version"].alias("model_version"), F.size(p["result"]).alias("regions"))


@register(
    "cvat_boxes",
    q.query(
        f"""SELECT i.image_id, concat('images/', i.image_id, '.jpg') AS ref, 640 AS width, 480 AS height, box_ord, class_name, x1 AS xtl, y1 AS ytl,
      x2 AS xbr, y2 AS ybr, score AS pg_score, {BAND} AS pg_band FROM images i LEFT JOIN acc a ON a.image_id = i.image_id""",
        ACCEPTED,
    ),
)
def cvat_boxes(t):
    """Texts are read back as numbers, since engines print ties differently."""
    rows = exports.cvat_boxes(_metas(t), _accepted(t))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("xtl", "ytl", "xbr", "ybr", "pg_score")})


@register(
    "cvat_xml",
    q.query(
        """SELECT row_number() OVER (ORDER BY image_id) - 1 AS id, concat('images/', image_id, '.jpg') AS name, n AS boxes, w AS width_sum FROM (
      SELECT i.image_id, count(a.image_id)::INT AS n, coalesce(sum(x2-x1), 0) AS w FROM images i LEFT JOIN acc a ON a.image_id = i.image_id GROUP BY 1)""",
        ACCEPTED,
    ),
)
def cvat_xml(t):
    """Written as XML and read back."""
    path = _scratch(t, "cvat")
    exports.write_cvat(_metas(t), _accepted(t), path)
    box = "box array<struct<_xtl:double,_xbr:double>>"
    rows = t.spark.read.format("xml").schema(f"_id long, _name string, {box}").option("rowTag", "image").load(path)
    width = F.aggregate(F.coalesce("box", F.array().cast("array<struct<_xtl:double,_xbr:double>>")), F.lit(0.0), lambda s, b: s + b["_xbr"] - b["_xtl"])
    n = F.coalesce(F.nullif(F.size("box"), F.lit(-1)), F.lit(0))
    return rows.select(F.col("_id").alias("id"), F.col("_name").alias("name"), n.alias("boxes"), width.alias("width_sum"))


def _elements(t, path, schema):
    """The JSON elements of a document, one to a line, in any order."""
    line = F.regexp_replace("value", "^,", "")
    rows = t.spark.read.text(path).where(F.rlike(line, F.lit(r"^\{.*\}$")))
    return rows.select(F.from_json(line, schema).alias("e")).select("e.*")


@register(
    "coco_document",
    q.query(
        """SELECT row_number() OVER (ORDER BY no, box_ord) AS id, no AS image_id, cls+1 AS category_id, round(x1, 6) AS x, round(y1, 6) AS y,
      round(x2-x1, 6) AS w, round(y2-y1, 6) AS h, round((x2-x1)*(y2-y1), 4) AS area, 0 AS iscrowd FROM (
      SELECT no, box_ord, cls, greatest(0.0::DOUBLE, (cx-w/2)*640) AS x1, greatest(0.0::DOUBLE, (cy-h/2)*480) AS y1,
        least(640.0::DOUBLE, (cx+w/2)*640) AS x2, least(480.0::DOUBLE, (cy+h/2)*480) AS y2 FROM gold_norm
        JOIN (SELECT image_id, row_number() OVER (ORDER BY image_id) AS no FROM images) USING (image_id)) WHERE x2 > x1 AND y2 > y1"""
    ),
)
def coco_document(t):
    """The annotations of a COCO document written in parts and read back."""
    path = _scratch(t, "coco-document")
    documents.write_coco_document(t.images, fx.with_centre(t.gold), t.classes, path)
    kind = "id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int"
    rows = _elements(t, path, kind).where("bbox IS NOT NULL")
    part = {name: F.round(F.col("bbox")[i], 6) for i, name in enumerate(("x", "y", "w", "h"))}
    return rows.withColumns(part | {"area": F.round("area", 4)}).drop("bbox")


@register(
    "label_studio_document",
    q.query(
        f"""SELECT concat(image_id, ':', box_ord) AS box_id, class_name, 640 AS original_width, 480 AS original_height, round(x1*100/640, 6) AS x, round(y1*100/480, 6) AS y,
      round((x2-x1)*100/640, 6) AS width, round((y2-y1)*100/480, 6) AS height, score, {BAND} AS band FROM acc""",
        ACCEPTED,
    ),
)
def label_studio_document(t):
    """All fields of all regions of a task list written in parts and read back."""
    path = _scratch(t, "tasks-document")
    documents.write_label_studio_document(_metas(t), _accepted(t), path, compression="gzip")
    value = "value struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>"
    rows = _elements(t, path, f"original_width int, original_height int, {value}, meta struct<pg_box_id:string,pg_score:double,pg_band:string>")
    rows = rows.where("meta IS NOT NULL")
    side = [F.round(F.col("value")[c], 6).alias(c) for c in ("x", "y", "width", "height")]
    meta = [F.col("meta.pg_box_id").alias("box_id"), F.col("meta.pg_score").alias("score"), F.col("meta.pg_band").alias("band")]
    return rows.select(*meta, F.col("value.rectanglelabels")[0].alias("class_name"), "original_width", "original_height", *side)


# -- pixels -------------------------------------------------------------------------------------
CROP = """SELECT *, vec_id % 6 AS x1, vec_id % 5 AS y1, vec_id % 6 + 1 + vec_id % 2 AS x2, vec_id % 5 + 1 + vec_id % 3 AS y2,
      list_transform(embedding, lambda v: abs(floor(v::DOUBLE*100)::INT) % 256) AS px FROM embeddings"""


def _pixels(t):
    """Every embedding as a grey image of 8 x 8 pixels."""
    byte = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.lpad(F.hex(F.abs(F.floor(v * 100)) % 256), 2, "0"))
    e = t.table("embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.unhex(F.array_join(byte, "")).alias("data"))
    return e.withColumns({"width": F.lit(8), "height": F.lit(8), "channels": F.lit(1)})


@register(
    "extract_crops",
    q.query(
        """SELECT vec_id::VARCHAR AS image_id, (x2-x1)::INT AS width, (y2-y1)::INT AS height, array_to_string(list_transform(flatten(list_transform(
      range(y1, y2), lambda y: list_transform(range(x1, x2), lambda x: px[y*8+x+1]))), lambda v: repeat(printf('%02X', v), 3)), '') AS pixels FROM crop""",
        ("crop", CROP),
    ),
)
def extract_crops(t):
    """All pixel values of a crop, three planes each."""
    v = F.col("vec_id")
    corners = {"x1": v % 6, "y1": v % 5, "x2": v % 6 + 1 + v % 2, "y2": v % 5 + 1 + v % 3}
    boxes = t.table("embeddings").select(v.cast("string").alias("image_id"), v.cast("string").alias("box_id"), *[c.cast("double").alias(n) for n, c in corners.items()])
    crops = images.extract_crops(_pixels(t), boxes)
    return crops.select("image_id", "width", "height", F.hex("pixels").alias("pixels"))


# -- round trips through files ------------------------------------------------------------------
@register(
    "labels_round_trip",
    q.query(
        """SELECT image_id::VARCHAR AS stem, (row_number() OVER (PARTITION BY image_id ORDER BY box_ord) - 1)::INT AS box_ord, label AS cls,
      round((x1+x2)/2/640, 4) AS cx, round((y1+y2)/2/480, 4) AS cy FROM (SELECT image_id, box_ord, label, x1, y1, least(x2, 640) AS x2, least(y2, 480) AS y2
      FROM candidates)"""
    ),
)
def labels_round_trip(t):
    """Boxes written as a table of label text and read back; coordinates carry six decimals in the text."""
    path = _scratch(t, "labels")
    boxes = fx.with_centre(t.candidates).withColumn("stem", F.col("image_id").cast("string"))
    exports.write_label_table(t.images.select(F.col("image_id").cast("string").alias("stem")), boxes, path)
    return labels.read_label_table(t.spark, path).select(
        "stem", "box_ord", "cls", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy")
    )


OVERLAY = """SELECT image_id::VARCHAR AS image_id, concat(image_id, ':', box_ord) AS box_id, box_ord, x1, y1, x2, y2, label, det_conf, p_good FROM candidates"""


def _with_box_id(t):
    return t.candidates.withColumn("box_id", F.concat_ws(":", "image_id", "box_ord"))


@register("overlay_round_trip", q.query(OVERLAY))
def overlay_round_trip(t):
    path = _scratch(t, "overlay")
    exports.write_overlay(t.images, _with_box_id(t), path, "boxes")
    return overlay.read_overlay(t.spark, path, "boxes")


@register("overlay_round_trip_images", q.query(OVERLAY))
def overlay_round_trip_images(t):
    path = _scratch(t, "overlay")
    exports.write_overlay(t.images, _with_box_id(t), path, "images")
    return overlay.read_overlay(t.spark, path, "images")


@register("ownership_round_trip", q.query("SELECT image_id::VARCHAR AS image_id FROM owned"))
def ownership_round_trip(t):
    path = _scratch(t, "ownership")
    text = F.col("image_id").cast("string").alias("image_id")
    exports.write_ownership(t.ownership.select(text), path)
    return labels.read_ownership(t.spark, path, t.images.select(text), None, layout="lines")


@register(
    "stage_split",
    q.query(
        """SELECT CASE WHEN image_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, 0 AS cls, count(*) AS n, count(DISTINCT image_id) AS images
      FROM gold GROUP BY 1"""
    ),
)
def stage_split(t):
    path = _scratch(t, "staged")
    split = F.when(F.col("image_id") % 5 == 0, "val").otherwise("train")
    exports.stage_split(fx.with_centre(t.gold).withColumn("split", split), path, class_agnostic=True)
    rows = t.spark.read.parquet(path)
    return rows.groupBy("split", "cls").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"))


# -- datasets on disk ---------------------------------------------------------------------------
FILES = """SELECT concat('/data/', (['Set_A','set a','Bees','wbc/part 1','wbc/part 2','Plain'])[o_custkey % 6 + 1],
      CASE WHEN o_custkey % 6 = 5 THEN '/images/' WHEN o_orderkey % 10 = 0 THEN '/images/valid/' WHEN o_orderkey % 10 = 1 THEN '/images/test/' ELSE '/images/train/' END,
      o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '.PNG' WHEN o_orderkey % 4 = 1 THEN '.tif' WHEN o_orderkey % 4 = 2 THEN '.jpg' ELSE '.txt' END) AS path,
      o_custkey % 6 AS d, o_orderkey FROM orders"""
NAMES = ("Set_A", "set a", "Bees", "wbc/part 1", "wbc/part 2", "Plain")


def _files(t):
    o = t.table("orders")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_custkey") % 6 + 1).cast("int"))
    last, four = F.col("o_orderkey") % 10, F.col("o_orderkey") % 4
    folder = (
        F.when(F.col("o_custkey") % 6 == 5, "/images/").when(last == 0, "/images/valid/").when(last == 1, "/images/test/").otherwise("/images/train/")
    )
    ending = F.when(four == 0, ".PNG").when(four == 1, ".tif").when(four == 2, ".jpg").otherwise(".txt")
    return o.select(F.concat(F.lit("/data/"), name, folder, "o_orderkey", ending).alias("path"))


def _no_yamls(t):
    return t.images.limit(0).select(F.lit("").alias("path"), F.lit("").alias("text"))


@register(
    "dataset_catalog",
    q.query(
        """SELECT name, key, n_train, n_val, n_test, n_train+n_val+n_test AS n_images FROM (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_train+n_val+n_test DESC, root) AS place FROM sets) WHERE place = 1""",
        ("files", FILES),
        (
            "sets",
            """SELECT (['Set_A','set a','Bees','part 1','part 2','Plain'])[d+1] AS name, (['set-a','set-a','bees','part-1','part-2','plain'])[d+1] AS key,
      (['/data/Set_A','/data/set a','/data/Bees','/data/wbc/part 1','/data/wbc/part 2','/data/Plain'])[d+1] AS root,
      count(*) FILTER (d = 5 OR o_orderkey % 10 > 1) AS n_train, count(*) FILTER (d = 5 OR o_orderkey % 10 = 0) AS n_val,
      count(*) FILTER (d = 5 OR o_orderkey % 10 = 1) AS n_test FROM files WHERE o_orderkey % 4 <> 3 GROUP BY d""",
        ),
    ),
)
def dataset_catalog(t):
    """Two spellings of one name, nested datasets, an alias of a split and an unsplit dataset."""
    return catalog.dataset_catalog(_files(t), _no_yamls(t), "/data").drop("root", "yaml")


@register(
    "list_images",
    q.query("SELECT path FROM files WHERE o_orderkey % 4 IN (0, 1, 2)", ("files", FILES)),
)
def list_images(t):
    from annospark.functions.names import IMAGE_ENDINGS_WIDE, ends_with_any

    return _files(t).where(ends_with_any(F.col("path"), IMAGE_ENDINGS_WIDE, ignore_case=True))


@register(
    "expand_split",
    q.query(
        """SELECT path, 'images/train' AS entry FROM files WHERE d < 5 AND o_orderkey % 4 <> 3 AND o_orderkey % 10 > 1
      UNION ALL SELECT concat('/data/Bees/', o_orderkey, '.jpg') AS path, 'list.txt' AS entry FROM files WHERE d = 2""",
        ("files", FILES),
    ),
)
def expand_split(t):
    """A folder entry of every dataset and a list file of one of them, whose images are not on disk."""
    files = _files(t)
    roots = t.spark.createDataFrame([(f"/data/{n}", "images/train") for n in NAMES] + [("/data/Bees", "list.txt")], "root string, entry string")
    lines = files.where(F.startswith("path", F.lit("/data/Bees/"))).select(
        F.regexp_replace("path", "/images/.*$", "/list.txt").alias("path"), F.concat(F.lit("./"), F.regexp_extract("path", r"/([0-9]+)\.", 1), F.lit(".jpg ")).alias("line")
    )
    return catalog.expand_split(roots, files, lines).select("path", "entry")


# -- events -------------------------------------------------------------------------------------
def _events(t):
    return fx.telemetry(t.spark, t.sf_dir)


@register("valid_events", q.query("SELECT event_type, count(*) AS n FROM telemetry WHERE event_type IS NOT NULL GROUP BY 1"))
def valid_events(t):
    return ev.valid(_events(t)).groupBy("event_type").agg(F.count("*").alias("n"))


@register(
    "quarantined_events",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('hover', 'undo') GROUP BY 1",
)
def quarantined_events(t):
    """The raw types are outside the vocabulary, so all of them are set aside."""
    return ev.quarantined(t.table("events")).groupBy("event_type").agg(F.count("*").alias("n"))


SESSIONS = """SELECT session_id, min(ts_ms) AS start_ms, max(ts_ms) + 1800000 AS end_ms, count(*) AS events,
      count(*) FILTER (event_type = 'box_accept') AS accepts, count(*) FILTER (event_type = 'box_reject') AS rejects FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS part FROM (
      SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM telemetry))
      GROUP BY session_id, part"""


@register("session_activity", q.query(SESSIONS))
def session_activity(t):
    return ev.session_activity(_events(t))


DWELL = """SELECT image_id, ts_ms - ts_ms % 86400000 AS start_ms, sum(dwell_ms)::BIGINT AS dwell_ms, count(*) AS events
      FROM telemetry WHERE event_type = 'image_finalized' GROUP BY 1, 2"""


@register("dwell_by_image", q.query(DWELL))
def dwell_by_image(t):
    return ev.dwell_by_image(_events(t))


OUTCOME = """SELECT session_id, image_id, box_id, arg_max(event_type, concat(ts_ms, event_type)) AS outcome, max(ts_ms) AS last_ms, count(*) AS actions
      FROM telemetry WHERE event_type IN ('box_accept', 'box_reject') GROUP BY 1, 2, 3"""


@register("box_outcome", q.query(OUTCOME))
def box_outcome(t):
    return ev.box_outcome(_events(t))


MIX = """SELECT session_id, count(*) FILTER (event_type = 'box_accept') AS box_accept, count(*) FILTER (event_type = 'box_reject') AS box_reject,
      0::BIGINT AS box_adjust, 0::BIGINT AS class_change, 0::BIGINT AS box_delete, 0::BIGINT AS box_add FROM telemetry GROUP BY 1"""


@register("action_mix", q.query(MIX))
def action_mix(t):
    return ev.action_mix(_events(t))


@register(
    "outcome_vs_gold",
    q.query(
        """SELECT o.box_id, o.session_id, o.image_id, o.outcome, o.last_ms, o.actions, c.p_good AS score,
      coalesce(m.pred_label = m.gold_label, false) AS correct, m.iou FROM outcome o
      JOIN candidates c ON concat(c.image_id, ':', c.box_ord) = o.box_id LEFT JOIN m ON m.image_id = c.image_id AND m.pi = c.box_ord""",
        ("outcome", OUTCOME),
        q.match("m", "candidates", "gold", 0.5),
    ),
)
def outcome_vs_gold(t):
    scored = ac.with_score(_with_box_id(t))
    return ev.outcome_vs_gold(ev.box_outcome(_events(t)), scored, matching.match_boxes(t.candidates, t.gold))


# -- the same as streams ------------------------------------------------------------------------
def _stream(t):
    raw = t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.sf_dir}/events.parquet*")
    return fx.telemetry_from(raw)


@register(
    "stream_outcome_vs_gold",
    q.query(
        """SELECT e.session_id, e.image_id, e.box_id, e.event_type, e.ts_ms, c.p_good AS score, coalesce(m.pred_label = m.gold_label, false) AS correct, m.iou
      FROM telemetry e JOIN candidates c ON concat(c.image_id, ':', c.box_ord) = e.box_id LEFT JOIN m ON m.image_id = c.image_id AND m.pi = c.box_ord
      WHERE e.event_type IN ('box_accept', 'box_reject', 'box_delete')""",
        q.match("m", "candidates", "gold", 0.5),
    ),
)
def stream_outcome_vs_gold(t):
    """A stream of decisions joined to the static table of boxes."""
    boxes = cut_lineage(ev.boxes_vs_gold(ac.with_score(_with_box_id(t)), matching.match_boxes(t.candidates, t.gold)))
    path = _scratch(t, "stream-vs-gold")
    ev.write_stream(ev.stream_outcome_vs_gold(_stream(t), boxes), f"{path}/out", f"{path}/state")
    return t.spark.read.parquet(f"{path}/out")


CLOSED = "(SELECT max(ts_ms) - 600000 FROM telemetry)"


@register(
    "stream_session_activity",
    q.query(f"SELECT * FROM sessions WHERE end_ms <= {CLOSED}", ("sessions", SESSIONS)),
)
def stream_session_activity(t):
    """Sessions are written once the watermark has passed their end."""
    path = _scratch(t, "sessions")
    ev.write_stream(ev.stream_session_activity(ev.watermarked(_stream(t))), f"{path}/out", f"{path}/state")
    return t.spark.read.parquet(f"{path}/out")


@register(
    "stream_dwell_by_image",
    q.query(f"SELECT * FROM dwell WHERE start_ms + 86400000 <= {CLOSED}", ("dwell", DWELL)),
)
def stream_dwell_by_image(t):
    path = _scratch(t, "dwell")
    ev.write_stream(ev.dwell_by_image(ev.watermarked(_stream(t))), f"{path}/out", f"{path}/state")
    return t.spark.read.parquet(f"{path}/out")


@register("stream_box_outcome", q.query(OUTCOME))
def stream_box_outcome(t):
    """Kept current in update mode; the reader takes the latest row of each box."""
    path = _scratch(t, "outcome")
    ev.write_latest(ev.stream_box_outcome(ev.watermarked(_stream(t))), f"{path}/out", f"{path}/state")
    daily = ev.latest(t.spark.read.parquet(f"{path}/out"), "session_id", "image_id", "box_id", "start_ms")
    return ev.combine_outcomes(daily)


@register("stream_last_outcome", q.query("SELECT * FROM outcome WHERE last_ms + 1800000 <= (SELECT max(last_ms) - 600000 FROM outcome)", ("outcome", OUTCOME)))
def stream_last_outcome(t):
    """Boxes that nobody has touched for half an hour, each given out once by keyed state with timers."""
    path, provider = _scratch(t, "last-outcome"), "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    ev.keyed_state(t.spark)
    try:
        ev.write_stream(ev.stream_last_outcome(_stream(t)), f"{path}/out", f"{path}/state")
    finally:
        t.spark.conf.set(provider, before)
    return ev.combine_outcomes(t.spark.read.parquet(f"{path}/out"))


@register("stream_action_mix", q.query(MIX))
def stream_action_mix(t):
    path = _scratch(t, "mix")
    ev.write_latest(ev.stream_action_mix(ev.watermarked(_stream(t))), f"{path}/out", f"{path}/state")
    return ev.combine_mix(ev.latest(t.spark.read.parquet(f"{path}/out"), "session_id", "start_ms"))


@register(
    "stream_event_log",
    q.query("SELECT session_id, event_type, count(*) AS n, sum(dwell_ms)::BIGINT AS dwell_ms FROM telemetry GROUP BY 1, 2"),
)
def stream_event_log(t):
    """Events logged as JSON lines by a stream and read back."""
    path = _scratch(t, "log")
    ev.log_events(_stream(t), f"{path}/out", f"{path}/state")
    rows = overlay.read_events(t.spark, f"{path}/out/valid")
    dwell = F.element_at("payload", F.lit("dwell_ms")).cast("long")
    return rows.groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.sum(dwell).alias("dwell_ms"))
