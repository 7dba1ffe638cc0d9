"""Label quality: count fidelity, defect taxonomy, operating curves, accuracy and average precision.

Every metric starts from the one-to-one matches and from per-image counts, which are aggregated with
map-side combine. Input tables are ``(image_id, box_ord, x1, y1, x2, y2, label)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annospark.functions.names import stem
from annospark.operators.matching import match_at_limits, match_boxes, right_at_cuts
from annospark.operators.order_stats import running


def per_image_counts(boxes: DataFrame, name: str) -> DataFrame:
    return boxes.groupBy("image_id").agg(F.count("*").alias(name))


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    return df.fillna(0, list(columns))


def image_grades(accepted: DataFrame, gold: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Per image of either table: accepted and gold boxes, and matches of the right class.

    Boxes are matched class-blind; the class is graded afterwards.
    """
    right = (F.col("pred_label") == F.col("gold_label")).cast("long")
    correct = match_boxes(accepted, gold, at_least).groupBy("image_id").agg(F.sum(right).alias("correct"))
    both = per_image_counts(accepted, "accepted").join(per_image_counts(gold, "gold"), "image_id", "full")
    return _filled(both.join(correct, "image_id", "left"), "accepted", "gold", "correct")


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def count_fidelity(accepted_counts: DataFrame, gold_counts: DataFrame) -> DataFrame:
    """Do accepted counts follow gold counts? Blind to which boxes they are.

    Inputs are ``(image_id, n)``; an image missing on one side counts as zero there.
    """
    both = accepted_counts.select("image_id", F.col("n").alias("accepted")).join(
        gold_counts.select("image_id", F.col("n").alias("gold")), "image_id", "full"
    )
    off = _filled(both, "accepted", "gold").select((F.col("accepted") - F.col("gold")).alias("off"))
    mean = lambda value: F.coalesce(F.avg(value), F.lit(0.0))
    return off.agg(
        mean(F.col("off")).alias("mean_signed_dev"),
        mean(F.abs("off")).alias("mean_abs_dev"),
        mean((F.col("off") > 0).cast("double")).alias("over_rate"),
        mean((F.col("off") < 0).cast("double")).alias("under_rate"),
    )


def correct_count_fidelity(accepted: DataFrame, gold: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Counts of accepted and correct boxes against gold. An empty side counts as fully covered."""
    g = image_grades(accepted, gold, at_least)
    mean = lambda value: F.coalesce(F.avg(value), F.lit(0.0))
    return g.agg(
        mean(F.col("correct") - F.col("gold")).alias("mean_correct_dev"),
        mean(_share(F.col("correct"), F.col("gold"), 1.0)).alias("mean_recall"),
        mean(_share(F.col("correct"), F.col("accepted"), 1.0)).alias("mean_precision"),
    )


def true_object_suppression(
    accepted: DataFrame, gold: DataFrame, seed_median: float, at_least: float = 0.5, gold_images: DataFrame | None = None
) -> DataFrame:
    """Recall on gold images that are denser than the seed median, and on the others.

    ``gold_images`` adds annotated images without a box; their recall counts as 1.
    """
    g = image_grades(accepted, gold, at_least)
    g = g.where(F.col("gold") > 0) if gold_images is None else _filled(
        gold_images.select("image_id").join(g, "image_id", "left"), "accepted", "gold", "correct"
    )
    dense = F.col("gold") > seed_median
    recall = _share(F.col("correct"), F.col("gold"), 1.0)
    return g.agg(
        F.avg(F.when(dense, recall)).alias("recall_dense_images"),
        F.count(F.when(dense, 1)).alias("n_dense"),
        F.avg(F.when(~dense, recall)).alias("recall_sparse_images"),
        F.count(F.when(~dense, 1)).alias("n_sparse"),
    ).withColumn("seed_median", F.lit(float(seed_median)))


DEFECTS = ("spurious", "mislocalized", "misclassified", "missed")


def image_defects(admitted: DataFrame, gold: DataFrame, at_least: float = 0.5, loose: float = 0.1) -> DataFrame:
    """Per image: admitted boxes by defect, and gold boxes without a partner.

    Boxes are matched loosely and the matches are then graded by overlap and class.
    """
    poor = F.col("iou") < at_least
    graded = match_boxes(admitted, gold, loose).groupBy("image_id").agg(
        F.count("*").alias("matched"),
        F.count(F.when(poor, 1)).alias("mislocalized"),
        F.count(F.when(~poor & (F.col("pred_label") != F.col("gold_label")), 1)).alias("misclassified"),
    )
    both = per_image_counts(admitted, "n_admitted").join(per_image_counts(gold, "n_gold"), "image_id", "full")
    every = _filled(
        both.join(graded, "image_id", "left"), "n_admitted", "n_gold", "matched", "mislocalized", "misclassified"
    )
    return every.select(
        "image_id",
        "n_admitted",
        (F.col("n_admitted") - F.col("matched")).alias("spurious"),
        "mislocalized",
        "misclassified",
        (F.col("n_gold") - F.col("matched")).alias("missed"),
    )


def defect_escape(defects: DataFrame, *group: str) -> DataFrame:
    """Escape rate and taxonomy, rolled up over ``group`` down to the grand total."""
    grouped = defects.rollup(*group) if group else defects.groupBy()
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_admitted", *DEFECTS)]
    wrong = F.col("spurious") + F.col("mislocalized") + F.col("misclassified")
    return (
        grouped.agg(*sums)
        .withColumn("n_defect", wrong)
        .withColumn("escape_rate", _share(F.col("n_defect"), F.col("n_admitted"), 0.0))
    )


def operating_curve(scored: DataFrame, gold: DataFrame, cuts, at_least: float = 0.5) -> DataFrame:
    """Precision and recall per score cut; recall is over all gold boxes."""
    cuts = [float(t) for t in cuts]
    correct = right_at_cuts(scored, gold, cuts, at_least)
    reached = F.explode(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= F.col("score")))
    accepted = scored.select(reached.alias("tau")).groupBy("tau").agg(F.count("*").alias("n_accepted"))
    asked = scored.sparkSession.createDataFrame([(t,) for t in cuts], "tau double")
    rows = _filled(asked.join(accepted, "tau", "left").join(correct, "tau", "left"), "n_accepted", "correct")
    total = gold.agg(F.count("*")).scalar()
    return rows.select(
        "tau",
        _share(F.col("correct"), F.col("n_accepted"), 0.0).alias("precision"),
        _share(F.col("correct"), total, 0.0).alias("recall"),
        "n_accepted",
    )


def image_accuracy(pseudo: DataFrame, gold: DataFrame, at_least: float = 0.5, class_agnostic: bool = False) -> DataFrame:
    """Per image with a box on either side: precision, recall, F1, matches and their overlap sum.

    Unlike the fidelity metrics a missing side scores 0 here, and only boxes of one class compete.
    """
    hits = match_boxes(pseudo, gold, at_least, class_aware=not class_agnostic).groupBy("image_id").agg(
        F.count("*").alias("matched"), F.sum("iou").alias("matched_iou_sum")
    )
    both = per_image_counts(pseudo, "pseudo_count").join(per_image_counts(gold, "gt_count"), "image_id", "full")
    rows = _filled(both.join(hits, "image_id", "left"), "pseudo_count", "gt_count", "matched", "matched_iou_sum")
    return with_f1(rows, "matched", "pseudo_count", "gt_count")


def pseudo_gt_join(unlabelled: DataFrame, pseudo: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pseudo labels and ground truth of the unlabelled images, both found by the image's stem.

    ``pseudo`` and ``gold`` have ``stem``; the results have ``image_id`` instead, ready for ``image_accuracy``.
    Two images that share a stem both get its labels; boxes of other images are left out.
    """
    keyed = unlabelled.select("image_id", stem(F.col("image_id")).alias("stem"))
    both = [keyed.join(rows, "stem").drop("stem") for rows in (pseudo, gold)]
    return both[0], both[1]


def with_f1(rows: DataFrame, matched: str, predicted: str, actual: str, prefix: str = "") -> DataFrame:
    precision, recall = _share(F.col(matched), F.col(predicted), 0.0), _share(F.col(matched), F.col(actual), 0.0)
    p, r = F.col(prefix + "precision"), F.col(prefix + "recall")
    return (
        rows.withColumn(prefix + "precision", precision)
        .withColumn(prefix + "recall", recall)
        .withColumn(prefix + "f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    )


def batch_accuracy(per_image: DataFrame, *group: str) -> DataFrame:
    """Micro precision, recall and F1 over ``image_accuracy`` rows, and the mean overlap of matches."""
    sums = per_image.groupBy(*group).agg(
        F.coalesce(F.sum("matched"), F.lit(0)).alias("total_matched"),
        F.coalesce(F.sum("gt_count"), F.lit(0)).alias("total_gt"),
        F.coalesce(F.sum("pseudo_count"), F.lit(0)).alias("total_pseudo"),
        F.coalesce(F.sum("matched_iou_sum"), F.lit(0.0)).alias("iou_sum"),
    )
    return (
        with_f1(sums, "total_matched", "total_pseudo", "total_gt", "micro_")
        .withColumn("mean_matched_iou", _share(F.col("iou_sum"), F.col("total_matched"), 0.0))
        .drop("iou_sum")
    )


def macro_average(per_dataset: DataFrame, *metrics: str) -> DataFrame:
    """Unweighted mean over datasets."""
    return per_dataset.agg(F.count("*").alias("datasets"), *[F.avg(m).alias(m) for m in metrics])


def confusion(rows: DataFrame, actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """Two-class confusion counts as one row."""
    cell = lambda y, p: F.count(F.when((F.col(actual) == y) & (F.col(predicted) == p), 1))
    return rows.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def validator_metrics(rows: DataFrame, actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """Accuracy, precision, recall and F1 of the good class with the confusion counts."""
    c = confusion(rows, actual, predicted)
    c = c.withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    c = c.withColumn("accuracy", _share(F.col("tp") + F.col("tn"), F.col("n"), 0.0))
    c = c.withColumn("__said", F.col("tp") + F.col("fp")).withColumn("__are", F.col("tp") + F.col("fn"))
    return with_f1(c, "tp", "__said", "__are").drop("__said", "__are")


# Overlap limits averaged by the stricter detection score.
AP_LIMITS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def average_precision(scored: DataFrame, gold: DataFrame, limits=AP_LIMITS) -> DataFrame:
    """Average precision per overlap limit and class: area under the interpolated curve.

    Detections are matched class-aware at every limit. Precision is made non-increasing from the right,
    and recall steps are summed. Running counts work on distinct scores, so tied detections move
    together; a class may hold any share of the detections.
    """
    limits = [float(x) for x in limits]
    detected = scored.groupBy("label", "score").agg(F.count("*").alias("n"))
    detected = running(detected, [F.desc("score")], {"cum_n": F.col("n")}, ["label"]).drop("n")
    key = ["iou_limit", "label"]
    hits = match_at_limits(scored, gold, limits).groupBy("iou_limit", F.col("pred_label").alias("label"), "score")
    hits = running(hits.agg(F.count("*").alias("tp")), [F.desc("score")], {"cum_tp": F.col("tp")}, key)
    # between two hits precision only falls, so the envelope is decided at the hits
    curve = hits.join(detected, ["label", "score"]).withColumn("precision", F.col("cum_tp") / F.col("cum_n"))
    best = running(curve, ["score"], {"envelope": F.col("precision")}, key, largest=True)
    area = best.groupBy(*key).agg(F.sum(F.col("tp") * F.col("envelope")).alias("area"))
    asked = F.explode(F.array(*[F.lit(x) for x in limits]))
    objects = gold.groupBy("label").agg(F.count("*").alias("n_gold")).select(asked.alias("iou_limit"), "label", "n_gold")
    return objects.join(area, key, "left").select(
        *key, "n_gold", F.coalesce(F.col("area") / F.col("n_gold"), F.lit(0.0)).alias("ap")
    )


def mean_average_precision(per_class: DataFrame) -> DataFrame:
    """``map50`` and the mean over all limits, averaged over classes that have gold boxes."""
    per_limit = per_class.groupBy("iou_limit").agg(F.avg("ap").alias("ap"))
    return per_limit.agg(
        F.max(F.when(F.col("iou_limit") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95")
    )
