"""Duplicate removal per image: non-maximum suppression, saved-box clean-up and proposal merging.

Images are small in practice (a detector keeps at most a hundred boxes), so their boxes are folded in
one sorted array without leaving the JVM. An image with more than ``HOT_IMAGE`` boxes never reaches
an array: ``Suppression`` works it off in tiles, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.functions.geometry import (
    CONTAINED_FROM,
    DEDUP_OVER,
    NMS_OVER,
    area,
    box,
    containment,
    iou,
    shared_area,
    touches,
)
from annospark.operators import hot_images
from annospark.operators.hot_images import BLOCK, HOT_IMAGE
from annospark.operators.tile_fold import KEPT, OPEN, fold
from annospark.session import cut_by, cut_lineage

LEAST_OVER = 0.05  # the smallest overlap limit of any suppression

STATE = "array<struct<rank:double,box_ord:bigint,x1:double,y1:double,x2:double,y2:double,area:double>>"


def blocks(k: Column, c: Column, over: float, use_containment: bool) -> Column:
    """A kept box ``k`` keeps the later box ``c`` out."""
    both = shared_area(box(k), box(c))
    hit = F.try_divide(both, k["area"] + c["area"] - both) > over
    if use_containment:
        hit = hit | ((c["area"] <= k["area"]) & (F.try_divide(both, c["area"]) >= CONTAINED_FROM))
    return (both > 0) & hit


def evicts(c: Column, k: Column) -> Column:
    """An accepted box ``c`` removes the strictly smaller kept box ``k`` that is nested with it."""
    both = shared_area(box(k), box(c))
    return (both > 0) & (k["area"] < c["area"]) & (F.try_divide(both, k["area"]) >= CONTAINED_FROM)


def suppress(ordered: Column, over: float, use_containment: bool) -> Column:
    """Greedy suppression over one image's boxes, an array in processing order."""

    def step(kept: Column, c: Column) -> Column:
        room = F.filter(kept, lambda k: ~evicts(c, k)) if use_containment else kept
        free = ~F.exists(kept, lambda k: blocks(k, c, over, use_containment))
        return F.when(free, F.concat(room, F.array(c))).otherwise(kept)

    return F.aggregate(ordered, F.array().cast(STATE), step)


def _lean(boxes: DataFrame, rank: Column) -> DataFrame:
    return boxes.select(
        "image_id",
        rank.cast("double").alias("rank"),
        F.col("box_ord").cast("long").alias("box_ord"),
        "x1",
        "y1",
        "x2",
        "y2",
        area(box()).alias("area"),
    )


def _contested(lean: DataFrame, hot: DataFrame | None, over: float, use_containment: bool) -> DataFrame:
    """Boxes that could block, be blocked or be evicted: all others are kept without a fold."""
    a, b = box("a"), box("b")
    both = shared_area(a, b)
    clash = F.try_divide(both, F.col("a.area") + F.col("b.area") - both) > over
    if use_containment:
        clash = clash | (F.try_divide(both, F.least("a.area", "b.area")) >= CONTAINED_FROM)
    grid, looked_up = hot_images.cells(lean, hot, "a"), hot_images.cells(lean, hot, "b")
    same = hot_images.same_cell("a", "b", hot)
    if hot is None:
        others, apart = looked_up, F.col("a.box_ord") != F.col("b.box_ord")
    else:  # equal boxes count once on the looked-up side, with the range of their positions
        others = looked_up.groupBy("image_id", "__cell", "x1", "y1", "x2", "y2", "area").agg(
            F.min("box_ord").alias("first"), F.max("box_ord").alias("last")
        )
        apart = (F.col("a.box_ord") != F.col("b.first")) | (F.col("a.box_ord") != F.col("b.last"))
    met = grid.alias("a").join(others.alias("b"), same & apart & touches(a, b) & (both > 0) & clash, "left_semi")
    met = met.select(*lean.columns)
    return met if hot is None else met.dropDuplicates(["image_id", "box_ord"])


def _losers(contested: DataFrame, over: float, use_containment: bool) -> DataFrame:
    """Keys of contested boxes that the array fold does not keep."""
    state = F.struct(*[c for c in contested.columns if c != "image_id"])
    per_image = contested.groupBy("image_id").agg(F.array_sort(F.collect_list(state)).alias("b"))
    kept = suppress(F.col("b"), over, use_containment).getField("box_ord")
    return per_image.select("image_id", F.explode(F.array_except("b.box_ord", kept)).alias("box_ord"))


def greedy(
    boxes: DataFrame,
    rank: Column,
    over: float,
    use_containment: bool,
    hot_limit: int | None = HOT_IMAGE,
    block: int = BLOCK,
) -> DataFrame:
    """Boxes that survive greedy suppression in ascending ``(rank, box_ord)`` order."""
    if over < LEAST_OVER:
        raise ValueError(f"an overlap limit below {LEAST_OVER}")
    lean = _lean(boxes, rank)
    hot = hot_images.find(boxes, hot_limit)
    contested = _contested(lean, hot, over, use_containment)
    if hot is None:
        losers = _losers(contested, over, use_containment)
    else:
        contested = cut_lineage(contested)
        small = contested.join(hot, "image_id", "left_anti")
        large = contested.join(hot, "image_id", "left_semi")
        tiles = Suppression(over, use_containment)
        losers = _losers(small, over, use_containment).unionByName(tiles.losers(large, hot, block))
    return _without(boxes, losers, hot)


def _without(boxes: DataFrame, gone: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``boxes`` without the keys ``gone``. Small images gather theirs: the join is then by image, like all before it."""
    if hot is not None:
        return boxes.join(gone, ["image_id", "box_ord"], "left_anti")
    lost = gone.groupBy("image_id").agg(F.collect_set("box_ord").alias("__lost"))
    found = F.array_contains("__lost", F.col("box_ord"))
    return boxes.join(lost, "image_id", "left").where(F.coalesce(~found, F.lit(True))).select(*boxes.columns)


class Suppression:
    """Greedy suppression of images that are too large for one array.

    The image is dealt into tiles. Each round a task takes the first ``block`` boxes of a tile by rank and has them take
    their turns (``tile_fold``). What hangs on an undecided box of another tile stays open, everything else is final, so a chain of boxes that
    wait for each other is followed through a whole tile at once. Rounds therefore grow with the number of tiles such a
    chain crosses; tiles are as many as the open boxes need, and shift by half a tile from round to round. The best open box of an
    image is always decided.

    With containment a box accepted in its turn may be evicted later. It is kept with the position of the first box that evicts
    it (``dead``): it blocks those in between. Whether it still blocks is open while an undecided box may evict it before.
    """

    def __init__(self, over: float, use_containment: bool):
        self.over, self.use_containment = over, use_containment
        # two boxes that overlap by ``over`` share that part of each side, so the centre of one lies at most
        # this part of the other's side outside of it
        self.widen = max(0.25, 0.5 / over - 1)

    def losers(self, boxes: DataFrame, hot: DataFrame, block: int) -> DataFrame:
        boxes = boxes.withColumn("rank", F.coalesce("rank", F.lit(float("-inf"))))  # no score sorts first
        never = F.lit(None).cast("struct<rank:double,box_ord:bigint>")
        waiting = cut_lineage(self._dealt(boxes.withColumns({"unsure": F.lit(False), "dead": never}), boxes, hot, block, 0))
        kept = waiting.limit(0).select(*boxes.columns, "dead")
        turn = 0
        while waiting.limit(1).count():
            turn += 1
            folded = cut_lineage(self._folded(waiting, hot, block))
            chosen = folded.where(F.col("fate") == KEPT).select(*kept.columns)
            rest = waiting.where(F.col("turn") > block).select(*kept.columns)
            rest = rest.unionByName(folded.where(F.col("fate") == OPEN).select(*kept.columns)).drop("dead")
            kept = kept.unionByName(chosen)
            if self.use_containment:
                kept = cut_lineage(self._with_deaths(kept, chosen, hot))
                rest = self._judged(rest, kept, hot)
            else:
                rest = self._unblocked(rest, chosen, hot).withColumns({"unsure": F.lit(False), "dead": never})
            waiting = cut_lineage(self._dealt(rest, waiting, hot, block, turn))
        return boxes.join(kept.where("dead IS NULL"), ["image_id", "box_ord"], "left_anti").select("image_id", "box_ord")

    # -- one round ------------------------------------------------------------------------------
    def _dealt(self, waiting: DataFrame, counted: DataFrame, hot: DataFrame, block: int, turn: int) -> DataFrame:
        """Boxes with the tile of their centre and their place in it by rank. Tiles hold about half a block on average."""
        counts = counted.groupBy("image_id").agg(F.ceil(F.sqrt(F.count("*") * 2 / block)).alias("__tiles"))
        placed = waiting.join(hot, "image_id").join(counts, "image_id")
        shift = 0.5 * (turn % 2)
        at = lambda low, high, origin, cell: F.floor(((F.col(low) + F.col(high)) / 2 - F.col(origin)) / (F.col(cell) * hot_images.GRID) * F.col("__tiles") + shift)
        tile = at("x1", "x2", "__left", "__wide") * (1 << 30) + at("y1", "y2", "__top", "__high")
        order = Window.partitionBy("image_id", "tile").orderBy("rank", "box_ord")
        return placed.withColumn("tile", tile.cast("long")).withColumn("turn", F.row_number().over(order)).select(*waiting.columns, "tile", "turn")

    def _folded(self, waiting: DataFrame, hot: DataFrame, block: int) -> DataFrame:
        """The first boxes of every tile with their fate."""
        first = waiting.where(F.col("turn") <= block)
        elsewhere = F.col("w.tile") != F.col("k.tile")
        blocked = self._hits(first, waiting, hot, self.widen, elsewhere & _before("k", "w") & self._blocks("k", "w"))
        blocked = blocked.select("w.image_id", "w.box_ord", F.lit(True).alias("__blocked")).distinct()
        first = first.join(blocked, ["image_id", "box_ord"], "left")
        threat = F.lit(None).cast("struct<rank:double,box_ord:bigint>")
        if self.use_containment:
            behind = elsewhere | (F.col("k.turn") > block)
            found = self._hits(first, waiting, hot, 0.25, behind & _before("w", "k") & evicts(_row("k"), _row("w")))
            found = found.groupBy("w.image_id", "w.box_ord").agg(F.min(_at("k")).alias("__threat"))
            first, threat = first.join(found, ["image_id", "box_ord"], "left"), F.col("__threat")
        columns = ["image_id", "rank", "box_ord", "x1", "y1", "x2", "y2", "area"]
        ready = first.select(
            *columns,
            "tile",
            (F.col("unsure") | F.col("__blocked").isNotNull()).alias("unsure"),
            *[struct[f].alias(f"{name}_{short}") for name, struct in (("dead", F.col("dead")), ("threat", threat)) for f, short in (("rank", "rank"), ("box_ord", "ord"))],
        )
        over, use_containment = self.over, self.use_containment
        kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
        schema = ", ".join(f"{c} {kinds[c]}" for c in [*columns, "dead_rank", "dead_ord"]) + ", fate int"

        def run(table):
            return fold(table, over, use_containment).select([*columns, "dead_rank", "dead_ord", "fate"])

        dead = F.when(F.col("dead_ord").isNotNull(), F.struct(F.col("dead_rank").alias("rank"), F.col("dead_ord").alias("box_ord")))
        return ready.groupBy("image_id", "tile").applyInArrow(run, schema).select(*columns, dead.alias("dead"), "fate")

    def _with_deaths(self, kept: DataFrame, chosen: DataFrame, hot: DataFrame) -> DataFrame:
        """Accepted boxes with the first position of a box that evicts them; ``chosen`` are the new ones."""
        found = self._hits(kept, chosen, hot, 0.25, _before("w", "k") & evicts(_row("k"), _row("w")))
        found = found.groupBy("w.image_id", "w.box_ord").agg(F.min(_at("k")).alias("__by"))
        both = kept.join(found, ["image_id", "box_ord"], "left")
        return both.withColumn("dead", F.least("dead", "__by")).select(*kept.columns)

    def _judged(self, waiting: DataFrame, kept: DataFrame, hot: DataFrame) -> DataFrame:
        """Open boxes without those an accepted box blocks, and what the accepted boxes mean for the others."""
        threat = self._hits(kept, waiting, hot, 0.25, _before("w", "k") & evicts(_row("k"), _row("w")))
        threat = threat.groupBy("w.image_id", "w.box_ord").agg(F.min(_at("k")).alias("threat"))
        dated = kept.join(threat, ["image_id", "box_ord"], "left")
        there = F.col("k.dead").isNull() | (_at("w") < F.col("k.dead"))
        surely = F.col("k.threat").isNull() | (_at("w") <= F.col("k.threat"))  # a box does not hang on itself
        blocked = self._hits(waiting, dated, hot, self.widen, _before("k", "w") & there & self._blocks("k", "w"))
        blocked = blocked.groupBy("w.image_id", "w.box_ord").agg(F.bool_or(surely).alias("__surely"))
        dead = self._hits(waiting, kept, hot, 0.25, _before("w", "k") & evicts(_row("k"), _row("w")))
        dead = dead.groupBy("w.image_id", "w.box_ord").agg(F.min(_at("k")).alias("dead"))
        both = waiting.join(blocked, ["image_id", "box_ord"], "left").where("__surely IS NULL OR NOT __surely").join(dead, ["image_id", "box_ord"], "left")
        return both.select(*waiting.columns, F.col("__surely").isNotNull().alias("unsure"), "dead")

    def _unblocked(self, waiting: DataFrame, kept: DataFrame, hot: DataFrame) -> DataFrame:
        hits = self._hits(waiting, kept, hot, self.widen, self._blocks("k", "w"), "left_semi").select("w.image_id", "w.box_ord").distinct()
        return waiting.join(hits, ["image_id", "box_ord"], "left_anti")

    def _blocks(self, k: str, c: str) -> Column:
        return blocks(_row(k), _row(c), self.over, self.use_containment)

    def _hits(self, w: DataFrame, k: DataFrame, hot: DataFrame, widen: float, condition: Column, how: str = "inner") -> DataFrame:
        """Pairs ``w, k`` of one image that meet ``condition``.

        ``w`` is looked up by the cell of its centre, which ``k``, made wider by ``widen`` of its sides, must cover.
        """
        w = hot_images.centre_cells(w, hot).alias("w")
        k = hot_images.cells(k, hot, widen=widen).alias("k")
        same = (F.col("w.image_id") == F.col("k.image_id")) & (F.col("w.__cell") == F.col("k.__cell"))
        return w.join(k, same & touches(box("w"), box("k")) & condition, how)


def _at(alias: str) -> Column:
    return F.struct(f"{alias}.rank", f"{alias}.box_ord")


def _before(a: str, b: str) -> Column:
    return _at(a) < _at(b)


class _row:
    """Lets the rules that read struct fields read the columns of a join alias."""

    def __init__(self, alias):
        self.alias = alias

    def __getitem__(self, name):
        return F.col(f"{self.alias}.{name}")

    getField = __getitem__


def nms(candidates: DataFrame, use_containment: bool, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Class-blind suppression by falling ``p_good``; equal scores keep their list order."""
    return greedy(candidates, -F.col("p_good"), NMS_OVER, use_containment, hot_limit)


def dedup(boxes: DataFrame, use_containment: bool, order: Column | None = None, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Clean-up before saving: near-duplicates in list order, then boxes inside larger ones."""
    order = F.lit(0.0) if order is None else order
    kept = greedy(boxes, order, DEDUP_OVER, False, hot_limit)
    return drop_contained(cut(kept, hot_limit), hot_limit=hot_limit) if use_containment else kept


def cut(boxes: DataFrame, hot_limit: int | None) -> DataFrame:
    """A lineage cut, in buckets of images when all of them are known to be small."""
    return cut_lineage(boxes) if hot_limit is not None else cut_by(boxes, "image_id")


def drop_contained(boxes: DataFrame, flag: Column | None = None, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Remove a box that lies to 80% inside a strictly larger box of the same image.

    With ``flag`` only flagged boxes (model proposals) are removed, and only because of flagged ones.
    All boxes are judged at once against the input, so removal is a plain anti join.
    """
    mine = boxes.withColumn("__on", F.lit(True) if flag is None else flag)
    hot = hot_images.find(mine, hot_limit)
    grid = hot_images.cells(mine, hot, "a")
    outer = hot_images.cells(mine, hot, "b").where("__on").select("image_id", "__cell", "x1", "y1", "x2", "y2")
    outer = outer if hot is None else outer.distinct()  # equal boxes never contain each other
    inner, o = box("i"), box("o")
    inside = (
        hot_images.same_cell("i", "o", hot)
        & touches(inner, o)
        & (area(o) > area(inner))
        & (containment(inner, o) >= CONTAINED_FROM)
    )
    gone = grid.where("__on").alias("i").join(outer.alias("o"), inside, "left_semi").select("image_id", "box_ord")
    return _without(boxes, gone.distinct(), hot)


def merge_proposals(existing: DataFrame, new: DataFrame, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Proposals that overlap neither a box already on the image nor an earlier added proposal."""
    taken = overlapping(new, existing, iou(box("a"), box("b")) > DEDUP_OVER, hot_limit)
    free = cut_lineage(new.join(taken, ["image_id", "box_ord"], "left_anti"))
    return greedy(free, F.lit(0.0), DEDUP_OVER, False, hot_limit)


def overlapping(left: DataFrame, right: DataFrame, condition: Column, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Keys of ``left`` boxes for which some ``right`` box of the image meets ``condition``.

    The condition uses the aliases ``a`` and ``b`` and must imply a positive shared area.
    """
    return overlapping_on(hot_images.find(left, hot_limit, right), left, right, condition)


def overlapping_on(hot: DataFrame | None, left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """``overlapping`` with the grid of the hot images already at hand."""
    a = hot_images.cells(left, hot).alias("a")
    b = hot_images.cells(right, hot, "b").select("image_id", "__cell", "x1", "y1", "x2", "y2")
    b = (b if hot is None else b.distinct()).alias("b")
    same = hot_images.same_cell("a", "b", hot)
    hit = a.join(b, same & touches(box("a"), box("b")) & condition, "left_semi").select("image_id", "box_ord")
    return hit if hot is None else hit.distinct()


def overlaps_any(boxes: DataFrame, others: DataFrame, over: float = 0.1, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Boxes whose overlap with any other-table box of the image is above ``over``."""
    hit = overlapping(boxes, others, iou(box("a"), box("b")) > over, hot_limit)
    return boxes.join(hit, ["image_id", "box_ord"], "left_semi")


def pairs(left: DataFrame, right: DataFrame, condition: Column, columns, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """All box pairs of an image that meet ``condition`` (aliases ``a`` and ``b``, shared area > 0)."""
    hot = hot_images.find(left, hot_limit, right)
    a, b = hot_images.cells(left, hot, "a").alias("a"), hot_images.cells(right, hot, "b").alias("b")
    same = hot_images.same_cell("a", "b", hot)
    if hot is not None:  # a pair meets in every shared cell; report it where its overlap begins
        same = same & hot_images.begins_here("a", "b")
    return a.join(b, same & touches(box("a"), box("b")) & condition).select(F.col("a.image_id").alias("image_id"), *columns)


def self_pairs(boxes: DataFrame, condition: Column, columns, ordered: bool = True, hot_limit: int | None = HOT_IMAGE) -> DataFrame:
    """Pairs of two different boxes of one image: both directions, or each pair once."""
    apart = (F.col("a.box_ord") != F.col("b.box_ord")) if ordered else (F.col("a.box_ord") < F.col("b.box_ord"))
    return pairs(boxes, boxes, apart & condition, columns, hot_limit)
