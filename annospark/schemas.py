"""Explicit table schemas. Readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

CORNERS = ("x1", "y1", "x2", "y2")

LABEL_BOX = T.StructType(
    [
        T.StructField("stem", T.StringType()),
        T.StructField("box_ord", T.IntegerType()),
        T.StructField("cls", T.IntegerType()),
        T.StructField("cx", T.DoubleType()),
        T.StructField("cy", T.DoubleType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
    ]
)

OVERLAY_RECORD = T.StructType(
    [
        T.StructField("box_id", T.StringType()),
        T.StructField("box_xyxy", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("det_conf", T.DoubleType()),
        T.StructField("p_good", T.DoubleType()),
    ]
)

OVERLAY_DOCUMENT = T.MapType(T.StringType(), T.ArrayType(OVERLAY_RECORD))

EVENT = T.StructType(
    [
        T.StructField("ts_ms", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("box_id", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    ]
)

# what a reader makes of a line that is no event
CORRUPT = "_corrupt_record"
EVENT_LINE = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])

# The closed vocabulary of annotator events.
EVENT_TYPES = (
    "session_start",
    "seed_labeled",
    "automate_clicked",
    "candidate_rendered",
    "box_accept",
    "box_reject",
    "box_adjust",
    "box_add",
    "box_delete",
    "class_change",
    "hover",
    "image_finalized",
    "undo",
    "session_end",
)
