"""Queries over single boxes and box pairs."""

import functools

from pyspark.sql import functions as F

from annospark import fixtures as fx
from annospark.functions import geometry as geo
from annospark.functions.geometry import box, named
from annospark.functions.names import label_path, normal_name, stem
from annospark.functions.scores import band, crop_label
from annospark.operators import overlap, status, views
from annospark.registry import sql as q
from annospark.registry.base import register

PX = "x1, y1, x2, y2"


@register(
    "iou_pairs",
    q.query(
        f"""SELECT a.image_id, a.box_ord AS first, b.box_ord AS second, {q.iou('a', 'b')} AS iou
    FROM candidates a JOIN candidates b ON a.image_id = b.image_id AND a.box_ord < b.box_ord WHERE {q.iou('a', 'b')} > 0.45"""
    ),
)
def iou_pairs(t):
    value = geo.iou(box("a"), box("b"))
    columns = [F.col("a.box_ord").alias("first"), F.col("b.box_ord").alias("second"), value.alias("iou")]
    return overlap.self_pairs(t.candidates, value > geo.NMS_OVER, columns, ordered=False)


@register(
    "containment_pairs",
    q.query(
        f"""SELECT a.image_id, a.box_ord AS inner_ord, b.box_ord AS outer_ord, {q.containment('a', 'b')} AS share
    FROM candidates a JOIN candidates b ON a.image_id = b.image_id AND a.box_ord <> b.box_ord
    WHERE {q.containment('a', 'b')} >= 0.8"""
    ),
)
def containment_pairs(t):
    share = geo.containment(box("a"), box("b"))
    columns = [F.col("a.box_ord").alias("inner_ord"), F.col("b.box_ord").alias("outer_ord"), share.alias("share")]
    return overlap.self_pairs(t.candidates, share >= geo.CONTAINED_FROM, columns)


@register(
    "nested_pairs",
    q.query(
        f"""SELECT a.image_id, a.box_ord AS first, b.box_ord AS second
    FROM candidates a JOIN candidates b ON a.image_id = b.image_id AND a.box_ord < b.box_ord
    WHERE {q.containment('a', 'b')} >= 0.8 OR {q.containment('b', 'a')} >= 0.8"""
    ),
)
def nested_pairs(t):
    columns = [F.col("a.box_ord").alias("first"), F.col("b.box_ord").alias("second")]
    return overlap.self_pairs(t.candidates, geo.nested(box("a"), box("b")), columns, ordered=False)


@register(
    "pair_boxes",
    q.query(
        f"""SELECT a.image_id, a.box_ord AS pi, b.box_ord AS gi, {q.iou('a', 'b')} AS iou
    FROM candidates a JOIN gold b ON a.image_id = b.image_id WHERE {q.iou('a', 'b')} >= 0.5"""
    ),
)
def pair_boxes(t):
    value = geo.iou(box("a"), box("b"))
    columns = [F.col("a.box_ord").alias("pi"), F.col("b.box_ord").alias("gi"), value.alias("iou")]
    return overlap.pairs(t.candidates, t.gold, value >= 0.5, columns)


@register(
    "clip_boxes",
    q.query(
        """SELECT image_id, box_ord, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h FROM (
    SELECT image_id, box_ord, least(greatest(cx-w/2,0.0::DOUBLE),1.0::DOUBLE) AS x1, least(greatest(cy-h/2,0.0::DOUBLE),1.0::DOUBLE) AS y1,
      least(greatest(cx+w/2,0.0::DOUBLE),1.0::DOUBLE) AS x2, least(greatest(cy+h/2,0.0::DOUBLE),1.0::DOUBLE) AS y2 FROM
      (SELECT image_id, box_ord, cx*1.3::DOUBLE AS cx, cy*1.3::DOUBLE AS cy, w, h FROM cand_norm))
    WHERE x2-x1 > 1e-6 AND y2-y1 > 1e-6"""
    ),
)
def clip_boxes(t):
    """Boxes pushed to the right and down, so that many cross the edge and some leave the image."""
    from annospark.sinks.exports import clipped_labels

    moved = fx.with_centre(t.candidates).withColumns({"cx": F.col("cx") * 1.3, "cy": F.col("cy") * 1.3})
    return clipped_labels(moved).drop("cls")


@register(
    "clamp_boxes",
    q.query(
        """SELECT * FROM (SELECT image_id, box_ord,
      greatest(0, least(CAST(trunc(x1) AS INT), 639)) AS x1, greatest(0, least(CAST(trunc(y1) AS INT), 479)) AS y1,
      greatest(0, least(CAST(trunc(x2) AS INT), 640)) AS x2, greatest(0, least(CAST(trunc(y2) AS INT), 480)) AS y2
      FROM (SELECT image_id, box_ord, x1*1.7::DOUBLE-150.5::DOUBLE AS x1, y1*1.7::DOUBLE-150.5::DOUBLE AS y1,
        x2*1.7::DOUBLE-150.5::DOUBLE AS x2, y2*1.7::DOUBLE-150.5::DOUBLE AS y2 FROM candidates))
    WHERE x2 > x1 AND y2 > y1"""
    ),
)
def clamp_boxes(t):
    b = box()
    moved = geo.Box(*(v * 1.7 - 150.5 for v in b))
    w = geo.crop_window(moved, F.lit(fx.WIDTH), F.lit(fx.HEIGHT))
    return t.candidates.select("image_id", "box_ord", *named(w)).where(geo.has_extent(b))


@register(
    "clamp_float",
    q.query(
        """SELECT image_id, box_ord, greatest(0.0::DOUBLE, least(least(a,c), 640.0::DOUBLE)) AS x1,
      greatest(0.0::DOUBLE, least(least(b,d), 480.0::DOUBLE)) AS y1, greatest(0.0::DOUBLE, least(greatest(a,c), 640.0::DOUBLE)) AS x2,
      greatest(0.0::DOUBLE, least(greatest(b,d), 480.0::DOUBLE)) AS y2
      FROM (SELECT image_id, box_ord, x2*1.5::DOUBLE AS a, y1-100 AS b, x1-100 AS c, y2 AS d FROM candidates)"""
    ),
)
def clamp_float(t):
    b = box()
    turned = geo.Box(b.x2 * 1.5, b.y1 - 100, b.x1 - 100, b.y2)
    w = geo.crop_window_float(turned, F.lit(fx.WIDTH), F.lit(fx.HEIGHT))
    return t.candidates.select("image_id", "box_ord", *named(w))


@register(
    "px_norm",
    q.query(
        """SELECT image_id, box_ord, greatest(0.0::DOUBLE, least(l, 1280.0::DOUBLE)) AS x1, greatest(0.0::DOUBLE, least(u, 720.0::DOUBLE)) AS y1,
      greatest(0.0::DOUBLE, least(l+bw, 1280.0::DOUBLE)) AS x2, greatest(0.0::DOUBLE, least(u+bh, 720.0::DOUBLE)) AS y2 FROM (
      SELECT image_id, box_ord, w*1280 AS bw, h*720 AS bh, cx*1280-(w*1280)/2 AS l, cy*720-(h*720)/2 AS u FROM cand_norm)
      WHERE greatest(0.0::DOUBLE, least(l+bw, 1280.0::DOUBLE)) > greatest(0.0::DOUBLE, least(l, 1280.0::DOUBLE))
        AND greatest(0.0::DOUBLE, least(u+bh, 720.0::DOUBLE)) > greatest(0.0::DOUBLE, least(u, 720.0::DOUBLE))"""
    ),
)
def px_norm(t):
    """Pixel boxes to normalised ones and back into a frame of another size."""
    n = fx.with_centre(t.candidates)
    b = geo.pixels_from_centre(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.lit(1280), F.lit(720))
    return n.select("image_id", "box_ord", *named(b)).where(geo.has_extent(box()))


@register(
    "box_formats",
    q.query(
        """SELECT image_id, box_ord, cx, cy, w, h, (cx-w/2)*0.5::DOUBLE AS x1, (cy-h/2)*2.0::DOUBLE AS y1, (cx+w/2)*0.5::DOUBLE AS x2,
      (cy+h/2)*2.0::DOUBLE AS y2, area FROM (SELECT image_id, box_ord, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS w, y2-y1 AS h,
      (x2-x1)*(y2-y1) AS area FROM candidates)"""
    ),
)
def box_formats(t):
    """Corner to centre form, back, and into a resized frame."""
    cx, cy, w, h = geo.corners_to_centre(box())
    c = t.candidates.select(
        "image_id", "box_ord", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), geo.area(box()).alias("area")
    )
    back = geo.centre_to_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    return c.select("*", *named(geo.rescale(back, 0.5, 2.0)))


@register(
    "tta_unmap",
    q.query(
        """SELECT image_id, box_ord, view,
      CASE view WHEN 'hflip' THEN 640-x2 WHEN 'scale_0.8' THEN x1*(640/512.0::DOUBLE) WHEN 'scale_1.2' THEN x1*(640/768.0::DOUBLE) ELSE x1 END AS x1,
      CASE view WHEN 'scale_0.8' THEN y1*(480/384.0::DOUBLE) WHEN 'scale_1.2' THEN y1*(480/576.0::DOUBLE) ELSE y1 END AS y1,
      CASE view WHEN 'hflip' THEN 640-x1 WHEN 'scale_0.8' THEN x2*(640/512.0::DOUBLE) WHEN 'scale_1.2' THEN x2*(640/768.0::DOUBLE) ELSE x2 END AS x2,
      CASE view WHEN 'scale_0.8' THEN y2*(480/384.0::DOUBLE) WHEN 'scale_1.2' THEN y2*(480/576.0::DOUBLE) ELSE y2 END AS y2
      FROM (SELECT *, (['original','hflip','scale_0.8','scale_1.2'])[box_ord % 4 + 1] AS view FROM candidates)"""
    ),
)
def tta_unmap(t):
    names = F.array(*[F.lit(v) for v in geo.VIEW_FACTORS])
    seen = t.candidates.withColumn("view", F.element_at(names, (F.col("box_ord") % 4 + 1).cast("int")))
    b = geo.to_original_frame(box(), F.col("view"), F.lit(fx.WIDTH), F.lit(fx.HEIGHT))
    return seen.select("image_id", "box_ord", "view", *named(b))


UNITED = [
    (
        "seen",
        """SELECT image_id, box_ord AS view_ord, no, view, p_good - no / 1000.0::DOUBLE AS p_good, y1, y2, x1 + no AS x1, x2 + no AS x2, label
      FROM candidates, (VALUES (0, 'original'), (1, 'hflip'), (2, 'scale_0.8'), (3, 'scale_1.2')) v(no, view) WHERE (image_id + box_ord + no) % 4 <> 3""",
    ),
    (
        "united",
        """SELECT image_id, view, view_ord, label, p_good, row_number() OVER (PARTITION BY image_id ORDER BY no, view_ord) - 1 AS box_ord,
      CASE no WHEN 1 THEN 640 - (640 - x1) WHEN 2 THEN x1 * 0.8::DOUBLE * (640/512.0::DOUBLE) WHEN 3 THEN x1 * 1.2::DOUBLE * (640/768.0::DOUBLE) ELSE x1 END AS x1,
      CASE no WHEN 2 THEN y1 * 0.8::DOUBLE * (480/384.0::DOUBLE) WHEN 3 THEN y1 * 1.2::DOUBLE * (480/576.0::DOUBLE) ELSE y1 END AS y1,
      CASE no WHEN 1 THEN 640 - (640 - x2) WHEN 2 THEN x2 * 0.8::DOUBLE * (640/512.0::DOUBLE) WHEN 3 THEN x2 * 1.2::DOUBLE * (640/768.0::DOUBLE) ELSE x2 END AS x2,
      CASE no WHEN 2 THEN y2 * 0.8::DOUBLE * (480/384.0::DOUBLE) WHEN 3 THEN y2 * 1.2::DOUBLE * (480/576.0::DOUBLE) ELSE y2 END AS y2 FROM seen""",
    ),
]


@register("tta_union", q.query("SELECT image_id, box_ord, view, view_ord, label, x1, y1, x2, y2 FROM kept", UNITED, q.fold("kept", "united", "p_good DESC, box_ord", 0.45)))
def tta_union(t):
    """Four views that each find most boxes, a little apart, in their own frames; one suppression over all of them."""
    parts = []
    for no, (view, factor) in enumerate(geo.VIEW_FACTORS.items()):
        seen = t.candidates.where((F.col("image_id") + F.col("box_ord") + no) % 4 != 3)
        b = box()
        x1, x2 = b.x1 + no, b.x2 + no
        if view == "hflip":
            x1, x2 = fx.WIDTH - x2, fx.WIDTH - x1
        scale = F.lit(factor or 1.0)
        corners = geo.Box(x1 * scale, b.y1 * scale, x2 * scale, b.y2 * scale)
        parts.append(
            seen.select("image_id", "box_ord", "label", (F.col("p_good") - no / F.lit(1000.0)).alias("p_good"), F.lit(view).alias("view"), *named(corners))
        )
    passes = functools.reduce(lambda a, c: a.unionByName(c), parts).withColumns({"width": F.lit(fx.WIDTH), "height": F.lit(fx.HEIGHT)})
    return views.unite_views(passes).select("image_id", "box_ord", "view", "view_ord", "label", *geo.Box._fields)


@register(
    "score_bands",
    q.query(
        """SELECT image_id, box_ord, CASE WHEN p_good >= 0.65 THEN 'green' WHEN p_good >= 0.35 THEN 'amber' ELSE 'red' END AS band,
      CASE WHEN det_conf > 0.7 THEN 1 WHEN det_conf < 0.5 THEN 0 END AS crop_label FROM candidates"""
    ),
)
def score_bands(t):
    return t.candidates.select(
        "image_id", "box_ord", band(F.col("p_good")).alias("band"), crop_label(F.col("det_conf")).alias("crop_label")
    )


@register(
    "class_names",
    q.query(
        """SELECT image_id, box_ord, coalesce((['cat','dog','bird'])[label+1], CAST(label AS VARCHAR)) AS class_name FROM candidates"""
    ),
)
def class_names(t):
    return status.with_class_name(t.candidates, t.classes).select("image_id", "box_ord", "class_name")


@register(
    "label_paths",
    """SELECT o_orderkey AS image_id,
      CASE WHEN o_orderkey % 3 = 0 THEN concat('/data/set/labels/train/', o_orderkey, '.a.txt')
        ELSE concat('/data/set/labels/', o_orderkey, '.a.txt') END AS label_path,
      concat(o_orderkey, '.a') AS stem, concat('set-', lower(replace(o_orderpriority, ' ', '-'))) AS set_name FROM orders""",
)
def label_paths(t):
    """Label files of images inside and outside an ``images`` folder, and normalised dataset names."""
    o = t.table("orders")
    name = F.concat("o_orderkey", F.lit(".a.jpg"))
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/data/set/images/train/"), name)).otherwise(
        F.concat(F.lit("/data/set/photos/"), name)
    )
    return o.select(
        F.col("o_orderkey").alias("image_id"),
        label_path(path, F.lit("/data/set")).alias("label_path"),
        stem(path).alias("stem"),
        normal_name(F.concat(F.lit("Set_"), "o_orderpriority")).alias("set_name"),
    )


@register(
    "overlaps_any",
    q.query(
        f"""SELECT image_id, box_ord FROM candidates c WHERE EXISTS (SELECT 1 FROM gold g WHERE g.image_id = c.image_id
      AND {q.iou('c', 'g')} > 0.1)"""
    ),
)
def overlaps_any(t):
    return overlap.overlaps_any(t.candidates, t.gold, 0.1).select("image_id", "box_ord")


@register("nms_plain", q.query("SELECT image_id, box_ord FROM kept", q.fold("kept", "candidates", "p_good DESC, box_ord", 0.45)))
def nms_plain(t):
    return overlap.nms(t.candidates, False).select("image_id", "box_ord")


@register(
    "nms_containment",
    q.query("SELECT image_id, box_ord FROM kept", q.fold("kept", "candidates", "p_good DESC, box_ord", 0.45, "true")),
)
def nms_containment(t):
    return overlap.nms(t.candidates, True).select("image_id", "box_ord")


@register("dedup_plain", q.query("SELECT image_id, box_ord FROM kept", q.fold("kept", "candidates", "box_ord", 0.55)))
def dedup_plain(t):
    return overlap.dedup(t.candidates, False).select("image_id", "box_ord")


@register(
    "dedup_containment",
    q.query(
        "SELECT image_id, box_ord FROM clean",
        q.fold("kept", "candidates", "box_ord", 0.55),
        q.contained_sweep("clean", "kept"),
    ),
)
def dedup_containment(t):
    return overlap.dedup(t.candidates, True).select("image_id", "box_ord")


@register(
    "drop_contained_ai",
    q.query(
        f"""SELECT image_id, box_ord FROM candidates i WHERE NOT (box_ord % 4 <> 0 AND EXISTS (SELECT 1 FROM candidates o
      WHERE o.image_id = i.image_id AND o.box_ord <> i.box_ord AND o.box_ord % 4 <> 0 AND {q.area('o')} > {q.area('i')}
      AND {q.containment('i', 'o')} >= 0.8))"""
    ),
)
def drop_contained_ai(t):
    """Every fourth box counts as drawn by a human."""
    return overlap.drop_contained(t.candidates, F.col("box_ord") % 4 != 0).select("image_id", "box_ord")


@register(
    "merge_proposals",
    q.query(
        "SELECT image_id, box_ord FROM added",
        ("fresh", f"""SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.image_id = c.image_id
      AND g.box_ord % 2 = 0 AND {q.iou('c', 'g')} > 0.55)"""),
        q.fold("added", "fresh", "box_ord", 0.55),
    ),
)
def merge_proposals(t):
    """Every second gold box is already on the image."""
    return overlap.merge_proposals(t.gold.where(F.col("box_ord") % 2 == 0), t.candidates).select("image_id", "box_ord")


@register("targets_anti", q.query("SELECT image_id FROM targets"))
def targets_anti(t):
    return status.targets(t.images, t.ownership).select("image_id")


@register(
    "fit_pool",
    q.query("SELECT image_id FROM targets UNION SELECT image_id FROM images WHERE image_id = 40"),
)
def fit_pool(t):
    return status.fit_pool(t.images, t.ownership, 40)


@register(
    "images_left_accepted",
    q.query(
        """SELECT i.image_id, count(c.image_id) AS n FROM images i LEFT JOIN (SELECT * FROM candidates WHERE p_good >= 0.8) c
      ON i.image_id = c.image_id GROUP BY i.image_id"""
    ),
)
def images_left_accepted(t):
    """Images without a proposal stay in the result."""
    accepted = t.candidates.where(F.col("p_good") >= 0.8).groupBy("image_id").agg(F.count("*").alias("n"))
    return t.images.join(accepted, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"))
