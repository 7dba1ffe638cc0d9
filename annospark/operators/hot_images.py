"""Images that hold very many boxes.

One image may hold a large share of a table. Such an image is found by counting, and from then on

* joins inside it run on a grid of cells, one key per ``(image, cell)`` instead of one key per image. The grid has
  levels, each with cells ``FACTOR`` times as wide as the one below; a box lies on the level of its own size, where it
  covers few cells, and is also entered on the coarser levels, where larger boxes look for it. So neither a large box
  among tiny ones nor the reverse covers many cells;
* suppression takes the boxes of a tile in blocks of at most ``BLOCK`` by rank (see ``overlap.Suppression``); what reaches from
  tile to tile is joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annospark.session import cut_lineage

HOT_IMAGE = 2_000
BLOCK = 2_000
GRID = 256  # cells per axis on the finest level
FACTOR = 4
LEVELS = 5  # a cell of the last level is as large as the image

# how two sides meet: both boxes on their own level, or one of them on the coarser level of the other
BOTH_OWN, LEFT_OWN, RIGHT_OWN, CENTRE = range(4)
OWN = {"a": (BOTH_OWN, LEFT_OWN), "b": (BOTH_OWN, RIGHT_OWN)}
GUEST = {"a": (RIGHT_OWN,), "b": (LEFT_OWN,)}
AXIS, SHIFTED = 20, 1 << 18  # bits of a cell number on one axis; added to it, since a widened box may leave the image


def find(boxes: DataFrame, limit: int | None, other: DataFrame | None = None) -> DataFrame | None:
    """Images with more than ``limit`` boxes with their grid, or None when there is none.

    Only counts and box sizes are aggregated, with map-side combine. A caller that knows its images to
    be small passes None and saves the count.
    """
    if limit is None:
        return None
    every = boxes.select("image_id", "x1", "y1", "x2", "y2")
    if other is not None:
        every = every.unionByName(other.select("image_id", "x1", "y1", "x2", "y2"))
    hot = (
        every.groupBy("image_id")
        .agg(
            F.count("*").alias("n"),
            F.min("x1").alias("left"),
            F.min("y1").alias("top"),
            (F.max("x2") - F.min("x1")).alias("span_x"),
            (F.max("y2") - F.min("y1")).alias("span_y"),
        )
        .where(F.col("n") > limit)
        .select(
            "image_id",
            F.col("left").alias("__left"),
            F.col("top").alias("__top"),
            F.greatest(F.col("span_x") / GRID, F.lit(1e-9)).alias("__wide"),
            F.greatest(F.col("span_y") / GRID, F.lit(1e-9)).alias("__high"),
        )
    )
    hot = cut_lineage(hot)  # written first, so that looking for a row does not count all boxes twice
    return hot if hot.limit(1).count() else None


def crowded(rows: DataFrame, limit: int, key: str = "image_id", groups: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there is none.

    With ``groups`` rows are first counted in that many hashed groups of keys, and single keys only in groups with more than
    ``limit`` rows. This saves the shuffle of all keys where a group holds far fewer rows than that.
    """
    if groups is not None:
        group = F.pmod(F.hash(key), F.lit(groups))
        full = rows.groupBy(group.alias("__group")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("__group")
        full = cut_lineage(full)
        if not full.limit(1).count():
            return None
        rows = rows.join(full, group == F.col("__group"), "left_semi")
    many = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(key))
    return many if many.limit(1).count() else None


def _code(level, tag, gx, gy):
    """A cell of a level, and the way of meeting in it, as one number."""
    head = (level * 4 + tag).cast("long")
    return (F.shiftleft(head, 2 * AXIS) + (gx + SHIFTED) * (1 << AXIS) + gy + SHIFTED).cast("long")


def _at(value, origin: str, size: str, level, alias: str = ""):
    return F.floor((value - F.col(alias + origin)) / (F.col(alias + size) * F.pow(F.lit(float(FACTOR)), level)))


def _covered(level, tags, x1, y1, x2, y2):
    """The cells of a level that a box touches, once for each tag."""
    gx1, gx2 = _at(x1, "__left", "__wide", level), _at(x2, "__left", "__wide", level)
    gy1, gy2 = _at(y1, "__top", "__high", level), _at(y2, "__top", "__high", level)
    rows = F.sequence(gy1, F.greatest(gy1, gy2))
    cell = lambda gx: F.flatten(F.transform(rows, lambda gy: F.array(*[_code(level, F.lit(t), gx, gy) for t in tags])))
    return F.flatten(F.transform(F.sequence(gx1, F.greatest(gx1, gx2)), cell))


def cells(boxes: DataFrame, hot: DataFrame | None, side: str = "a", widen: float | None = None) -> DataFrame:
    """One row per cell that a box is entered in; boxes of ordinary images stay single rows in cell 0.

    Rows of side ``a`` meet rows of side ``b`` on the level of the larger box only. With ``widen`` a box also
    covers that share of its size on every side, on its own level, and meets rows of ``centre_cells``.
    """
    if hot is None:
        return boxes.withColumn("__cell", F.lit(0).cast("long"))
    placed = boxes.join(hot, "image_id", "left")
    more = widen or 0.0
    more_x, more_y = (F.col("x2") - F.col("x1")) * more, (F.col("y2") - F.col("y1")) * more
    corners = (F.col("x1") - more_x, F.col("y1") - more_y, F.col("x2") + more_x, F.col("y2") + more_y)
    size = F.greatest((corners[2] - corners[0]) / F.col("__wide"), (corners[3] - corners[1]) / F.col("__high"), F.lit(1.0))
    level = F.least(F.lit(LEVELS - 1), F.ceil(F.log(size) / F.log(F.lit(float(FACTOR))))).cast("int")
    found = _covered(level, (CENTRE,) if widen is not None else OWN[side], *corners)
    if widen is None:
        above = F.filter(F.array(*[F.lit(i) for i in range(LEVELS)]), lambda i: i > level)
        found = F.concat(found, F.flatten(F.transform(above, lambda i: _covered(i, GUEST[side], *corners))))
    ordinary = F.array(F.lit(0).cast("long"))
    return placed.withColumn("__cell", F.explode(F.when(F.col("__wide").isNull(), ordinary).otherwise(found)))


def same_cell(a: str, b: str, hot: DataFrame | None):
    """Rows of two aliases meet. Without large images all are in one cell, and the join is by image alone."""
    same = F.col(f"{a}.image_id") == F.col(f"{b}.image_id")
    return same if hot is None else same & (F.col(f"{a}.__cell") == F.col(f"{b}.__cell"))


def begins_here(a: str, b: str):
    """The upper left corner of the overlap of two boxes lies in the cell the rows meet in."""
    x = F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    y = F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    cell = F.col(f"{a}.__cell")
    head = F.shiftright(cell, 2 * AXIS)
    level, tag = F.shiftright(head, 2), head % 4
    here = _code(level, tag, _at(x, "__left", "__wide", level, f"{a}."), _at(y, "__top", "__high", level, f"{a}."))
    return F.col(f"{a}.__wide").isNull() | (cell == here)


def centre_cells(boxes: DataFrame, hot: DataFrame) -> DataFrame:
    """One row per level for every box, in the cell of its centre. Only for boxes of hot images."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    levels = [F.lit(i) for i in range(LEVELS)]
    codes = [_code(i, F.lit(CENTRE), _at(x, "__left", "__wide", i), _at(y, "__top", "__high", i)) for i in levels]
    placed = boxes.join(hot, "image_id")
    return placed.withColumn("__cell", F.explode(F.array(*codes))).drop(*[c for c in hot.columns if c != "image_id"])
