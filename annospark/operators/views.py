"""Detections of one image from several augmented views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.geometry import VIEW_FACTORS, box, to_original_frame
from annospark.operators import hot_images
from annospark.operators.order_stats import numbered
from annospark.operators.overlap import nms


def view_number(view: Column) -> Column:
    """Place of a view in the order in which views are taken; names that are no view are an error."""
    place = F.array_position(F.array(*[F.lit(v) for v in VIEW_FACTORS]), view)
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("no view: "), F.coalesce(view, F.lit("null")))).cast("long"))


def in_original_frame(passes: DataFrame) -> DataFrame:
    """Boxes of all views back in the frame of their image. ``passes`` has ``image_id, view, box_ord``, corners, ``width`` and ``height`` of the image.

    The views stay apart: a box is still named by ``(image_id, view, box_ord)``.
    """
    return passes.withColumns(dict(zip(("x1", "y1", "x2", "y2"), to_original_frame(box(), F.col("view"), F.col("width"), F.col("height")))))


def unite_views(passes: DataFrame, use_containment: bool = False, hot_limit: int | None = hot_images.HOT_IMAGE) -> DataFrame:
    """One list of candidates per image from the passes of all its views, suppressed across views at once.

    Boxes are numbered anew in ``box_ord``, view by view; ``view`` and ``view_ord`` say where a box comes from. Equal scores fall to the
    earlier view. An image may lack views or have any number of boxes in them.
    """
    framed = in_original_frame(passes).withColumn("view_ord", F.col("box_ord")).withColumn("__view", view_number(F.col("view")))
    hot = None if hot_limit is None else hot_images.crowded(framed, hot_limit)
    united = numbered(framed.drop("box_ord"), ["__view", "view_ord"], "box_ord", hot).drop("__view", "width", "height")
    # without a large image nothing has to be counted again
    return nms(united, use_containment, None if hot is None else hot_limit)
