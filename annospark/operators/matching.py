"""One-to-one matching of predicted and gold boxes by falling overlap.

Pairs above the limit come from a join; the assignment works on those pairs only. Ties fall to the
larger prediction position, then to the larger gold position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.geometry import box, iou
from annospark.operators import hot_images
from annospark.operators.match_copies import copies, groups, match_groups

MATCH_HOT = 400


def overlap_pairs(
    pred: DataFrame,
    gold: DataFrame,
    at_least: float,
    class_aware: bool = False,
    hot: DataFrame | None = None,
    extra=(),
) -> DataFrame:
    """Pairs ``(image_id, pi, gi, iou, pred_label, gold_label)`` with overlap >= ``at_least`` > 0."""
    if at_least <= 0:
        raise ValueError("the overlap limit must be positive")
    value = iou(box("a"), box("b"))
    condition = value >= at_least
    if class_aware:
        condition = condition & (F.col("a.label") == F.col("b.label"))
    a, b = hot_images.cells(pred, hot, "a").alias("a"), hot_images.cells(gold, hot, "b").alias("b")
    same = hot_images.same_cell("a", "b", hot)
    if hot is not None:
        same = same & hot_images.begins_here("a", "b")
    return a.join(b, same & condition).select(
        F.col("a.image_id").alias("image_id"),
        F.col("a.box_ord").cast("long").alias("pi"),
        F.col("b.box_ord").cast("long").alias("gi"),
        value.alias("iou"),
        F.col("a.label").alias("pred_label"),
        F.col("b.label").alias("gold_label"),
        *extra,
    )


ORDER = ("iou", "pi", "gi")  # by falling overlap; ties to the later prediction, then the later gold box


def _fields(pairs: DataFrame, keys) -> list[str]:
    return [*ORDER, *[c for c in pairs.columns if c not in (*ORDER, *keys)]]


def assign(pairs: DataFrame, keys=("image_id",)) -> DataFrame:
    """Greedy one-to-one assignment inside each key, as an array fold over the sorted pairs."""
    keys = list(keys)
    fields = _fields(pairs, keys)
    ranked = F.sort_array(F.collect_list(F.struct(*fields)), asc=False)
    kind = "array<" + pairs.select(F.struct(*fields).alias("s")).schema["s"].dataType.simpleString() + ">"

    def step(done: Column, p: Column) -> Column:
        taken = F.exists(done, lambda m: (m["pi"] == p["pi"]) | (m["gi"] == p["gi"]))
        return F.when(taken, done).otherwise(F.concat(done, F.array(p)))

    folded = F.aggregate("ranked", F.array().cast(kind), step)
    return (
        pairs.groupBy(*keys)
        .agg(ranked.alias("ranked"))
        .select(*keys, F.explode(folded).alias("m"))
        .select(*keys, "m.*")
    )


def _match(pred, gold, hot, at_least, class_aware, keys=("image_id",), carry=()) -> DataFrame:
    """Matches inside ``keys``: an array fold for ordinary images, matching of copies for those in ``hot``.

    ``keys`` may name a column of ``pred`` besides the image.
    """
    scope = list(keys)
    own = [F.col(f"a.{c}").alias(c) for c in (*[k for k in scope if k != "image_id"], *carry)]

    if hot is None:
        return assign(overlap_pairs(pred, gold, at_least, class_aware, None, own), keys)
    small = [t.join(hot.select("image_id"), "image_id", "left_anti") for t in (pred, gold)]
    large = [t.join(hot.select("image_id"), "image_id", "left_semi") for t in (pred, gold)]
    done = assign(overlap_pairs(*small, at_least, class_aware, None, own), keys)
    own = [F.col(f"a.{c}").alias(c) for c in scope if c != "image_id"]
    own += [F.col("a.pg").alias("pg"), F.col("a.n_pred").alias("n_pred"), F.col("b.gg").alias("gg"), F.col("b.n_gold").alias("n_gold")]
    p, g = groups(large[0], scope, "pg", "n_pred"), groups(large[1], ["image_id"], "gg", "n_gold")
    edges = overlap_pairs(p, g, at_least, class_aware, hot, own).drop("pi", "gi")
    rest = match_groups(edges, copies(large[0], scope, "pg", "pi", carry), copies(large[1], ["image_id"], "gg", "gi"), keys, scope)
    return done.unionByName(rest.select(*done.columns))


def match_boxes(
    pred: DataFrame,
    gold: DataFrame,
    at_least: float = 0.5,
    class_aware: bool = False,
    hot_limit: int | None = MATCH_HOT,
) -> DataFrame:
    """Matches ``(image_id, iou, pi, gi, pred_label, gold_label)``; ``pi``/``gi`` are ``box_ord`` values.

    With ``class_aware`` only pairs of one class compete. Otherwise classes are ignored here and
    graded by the caller.
    """
    return _match(pred, gold, hot_images.find(pred, hot_limit, gold), at_least, class_aware)


def right_at_cuts(pred: DataFrame, gold: DataFrame, cuts, at_least: float = 0.5, hot_limit: int = MATCH_HOT) -> DataFrame:
    """``tau, correct``: matches of the right class per score cut, each cut matched anew among predictions with score >= tau.

    The pairs of an image are gathered and sorted once and folded for every cut in the row, so no pair is repeated and only one
    number per cut leaves an image. A cut that no prediction of an image reaches costs nothing there.
    """
    hot = hot_images.find(pred, hot_limit, gold)
    right = lambda m: m["pred_label"] == m["gold_label"]
    if hot is not None:
        matched = match_at_cuts(pred, gold, cuts, at_least, hot_limit, hot)
        return matched.groupBy("tau").agg(F.sum((F.col("pred_label") == F.col("gold_label")).cast("long")).alias("correct"))
    pairs = overlap_pairs(pred, gold, at_least, False, None, [F.col("a.score").alias("score")])
    fields = F.struct(*ORDER, "score", "pred_label", "gold_label")
    per_image = pairs.groupBy("image_id").agg(F.sort_array(F.collect_list(fields), asc=False).alias("ranked"))
    empty = F.struct(F.array().cast("array<bigint>").alias("pi"), F.array().cast("array<bigint>").alias("gi"), F.lit(0).alias("n"))

    def step(done: Column, p: Column) -> Column:
        taken = F.array_contains(done["pi"], p["pi"]) | F.array_contains(done["gi"], p["gi"])
        more = F.struct(
            F.concat(done["pi"], F.array(p["pi"])).alias("pi"),
            F.concat(done["gi"], F.array(p["gi"])).alias("gi"),
            (done["n"] + right(p).cast("int")).alias("n"),
        )
        return F.when(taken, done).otherwise(more)

    at = lambda tau: F.aggregate(F.filter("ranked", lambda p: p["score"] >= tau), empty, step, lambda done: done["n"])
    steps = [F.lit(float(t)) for t in cuts]
    counts = per_image.select(F.transform(F.array(*steps), at).alias("n"))
    sums = counts.agg(F.array(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(len(steps))]).alias("n"))
    return sums.select(F.explode(F.arrays_zip(F.array(*steps).alias("tau"), F.col("n").alias("correct"))).alias("r")).select("r.tau", "r.correct")


def match_at_cuts(pred: DataFrame, gold: DataFrame, cuts, at_least: float = 0.5, hot_limit: int = MATCH_HOT, hot: DataFrame | None = None) -> DataFrame:
    """Matches per score cut ``tau``: the assignment is redone among predictions with score >= tau."""
    hot = hot_images.find(pred, hot_limit, gold) if hot is None else hot
    steps = F.array(*[F.lit(float(t)) for t in cuts])
    reached = F.explode(F.filter(steps, lambda t: t <= F.col("score")))
    if hot is None:  # overlaps once; a pair is then repeated for every cut its prediction reaches
        pairs = overlap_pairs(pred, gold, at_least, False, None, [F.col("a.score").alias("score")])
        return assign(pairs.withColumn("tau", reached).drop("score"), ("tau", "image_id"))
    return _match(pred.withColumn("tau", reached), gold, hot, at_least, False, ("tau", "image_id"))


def match_at_limits(pred: DataFrame, gold: DataFrame, limits, hot_limit: int = MATCH_HOT) -> DataFrame:
    """Class-aware matches with their ``score`` per overlap limit ``iou_limit``.

    Pairs are taken by falling overlap, so what is matched at a limit is what the lowest limit matches with at
    least that overlap: one assignment serves all limits.
    """
    hot = hot_images.find(pred, hot_limit, gold)
    matched = _match(pred, gold, hot, min(limits), True, carry=("score",))
    steps = F.array(*[F.lit(float(x)) for x in limits])
    return matched.withColumn("iou_limit", F.explode(F.filter(steps, lambda x: x <= F.col("iou"))))
