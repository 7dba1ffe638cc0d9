"""Matching inside images that hold very many boxes, copies of one box among them.

Equal boxes of one class are one group with a count. Groups are paired and matched, not their copies: a
group always gives away its copies from the largest position down, so a match of two groups is a run of
copies on either side. Positions come back in at the end. The result is that of the pairwise rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annospark.functions.geometry import Box
from annospark.operators.order_stats import running
from annospark.session import cut_lineage


def _group():
    return F.struct(*Box._fields, "label")


def copies(boxes: DataFrame, scope, group: str, position: str, carry=()) -> DataFrame:
    """Every box with its group and its place in it, from the largest position down (0 first)."""
    keyed = boxes.withColumn(group, _group())
    placed = running(keyed, [F.desc("box_ord")], {"place": F.lit(1).cast("long")}, [*scope, group])
    return cut_lineage(
        placed.select(*scope, group, (F.col("place") - 1).alias("place"), F.col("box_ord").cast("long").alias(position), *carry)
    )


def groups(boxes: DataFrame, scope, group: str, size: str) -> DataFrame:
    """One box per group with the number of its copies."""
    counted = boxes.groupBy(*scope, *Box._fields, "label").agg(F.count("*").alias(size))
    return counted.withColumn(group, _group()).withColumn("box_ord", F.lit(0))


def match_groups(edges: DataFrame, pred_copies: DataFrame, gold_copies: DataFrame, keys, scope) -> DataFrame:
    """Greedy matching of group pairs ``(keys, iou, pg, gg, n_pred, n_gold, labels)``.

    Groups whose best overlaps are with each other go next. Where several groups of both sides all overlap by the same best
    value (a plateau), their copies go in order of position, whatever group they are of: the k-th copy of one side with the k-th of the other,
    as many as the smaller side has. A plateau with gaps, where some of its groups do not tie with others, gives
    away one copy of each group at a time.
    """
    zero = F.lit(0).cast("long")
    open_pairs, found = cut_lineage(edges.withColumns({"used_p": zero, "used_g": zero})), None
    while open_pairs.limit(1).count():
        marked = cut_lineage(_plateaus(open_pairs, keys))
        whole = _in_order(marked.where("whole"), pred_copies, gold_copies, keys, scope)
        won = cut_lineage(whole.unionByName(_one_each(marked, pred_copies, gold_copies, keys, scope)))
        found = won if found is None else found.unionByName(won)
        count = lambda group, name: won.groupBy(*keys, group).agg(F.count("*").alias(name))
        moved = open_pairs.join(count("pg", "more_p"), [*keys, "pg"], "left").join(count("gg", "more_g"), [*keys, "gg"], "left")
        moved = moved.withColumn("used_p", F.col("used_p") + F.coalesce("more_p", zero))
        moved = moved.withColumn("used_g", F.col("used_g") + F.coalesce("more_g", zero)).drop("more_p", "more_g")
        open_pairs = cut_lineage(moved.where((F.col("used_p") < F.col("n_pred")) & (F.col("used_g") < F.col("n_gold"))))
    if found is None:
        found = _in_order(_plateaus(open_pairs, keys), pred_copies, gold_copies, keys, scope)
    labels = edges.select(*keys, "pg", "gg", "iou", "pred_label", "gold_label")
    return found.join(labels, [*keys, "pg", "gg"]).drop("pg", "gg")


def _plateaus(pairs: DataFrame, keys) -> DataFrame:
    """The pairs, and whether a pair is the best of both groups and all groups it is connected with by such pairs tie with each other (``whole``)."""

    def sides(df, values):
        return {g: df.groupBy(*keys, g).agg(*[v.alias(f"{g}_{n}") for n, v in values(g).items()]) for g in ("pg", "gg")}

    def with_sides(df, values):
        for g, side in sides(df, values).items():
            df = df.join(side, [*keys, g])
        return df

    other = {"pg": "gg", "gg": "pg"}
    best = with_sides(pairs, lambda g: {"best": F.max("iou")})
    mine = {g: F.col("iou") == F.col(f"{g}_best") for g in other}
    best = best.withColumn("tied", mine["pg"] & mine["gg"])
    # with whom a group ties, as a sum of hashes; a group all of whose best pairs are best for the others too is settled
    names = lambda g: F.when(F.col("tied"), F.xxhash64(other[g]).cast("decimal(38,0)"))
    flags = lambda g: {"mates": F.sum(names(g)), "settled": F.min(F.when(mine[g], F.col("tied"))), "first": F.min(F.when(F.col("tied"), F.col(other[g])))}
    known = with_sides(best, flags)
    theirs = lambda g, name: F.when(F.col("tied"), F.col(f"{other[g]}_{name}"))
    even = lambda g: {"even": (F.min(theirs(g, "mates")) == F.max(theirs(g, "mates"))) & F.min(theirs(g, "settled"))}
    known = with_sides(known, even)
    whole = F.col("tied") & F.col("pg_settled") & F.col("gg_settled") & F.col("pg_even") & F.col("gg_even")
    return known.select(*pairs.columns, F.coalesce(whole, F.lit(False)).alias("whole"), F.col("pg_first").alias("plateau"))


def _in_order(pairs: DataFrame, pred_copies: DataFrame, gold_copies: DataFrame, keys, scope) -> DataFrame:
    """``keys, pg, gg, pi, gi`` (and carried columns): the k-th open copy of a plateau's predictions with the k-th of its gold boxes."""

    def ranked(side, group, used, copies, on, position):
        groups = pairs.select(*keys, "plateau", group, used).distinct()
        open_ = copies.join(groups, [*on, group]).where(F.col("place") >= F.col(used)).drop("place", used)
        return running(open_, [F.desc(position)], {"turn": F.lit(1).cast("long")}, [*keys, "plateau"])

    left = ranked("p", "pg", "used_p", pred_copies, scope, "pi")
    right = ranked("g", "gg", "used_g", gold_copies, ["image_id"], "gi").select(*keys, "plateau", "turn", "gg", "gi")
    return left.join(right, [*keys, "plateau", "turn"]).drop("plateau", "turn")


def _one_each(pairs: DataFrame, pred_copies: DataFrame, gold_copies: DataFrame, keys, scope) -> DataFrame:
    """The next copies of two groups outside of whole plateaus that are each other's first choice by overlap and position."""
    next_p = pred_copies.withColumnRenamed("place", "used_p")
    next_g = gold_copies.withColumnRenamed("place", "used_g")
    live = pairs.join(next_p, [*scope, "pg", "used_p"]).join(next_g, ["image_id", "gg", "used_g"])
    live = cut_lineage(live.withColumn("order", F.struct("iou", "pi", "gi")))
    top = lambda group: live.groupBy(*keys, group).agg(F.max("order").alias("order"))
    won = live.where("NOT whole").join(top("pg"), [*keys, "pg", "order"]).join(top("gg"), [*keys, "gg", "order"])
    carried = [c for c in pred_copies.columns if c not in (*scope, "pg", "place", "pi")]
    return won.select(*keys, *[c for c in scope if c not in keys], "pg", "pi", *carried, "gg", "gi")
