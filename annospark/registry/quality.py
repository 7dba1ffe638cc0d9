"""Queries over matches, label quality, progress and labels."""

from pyspark.sql import functions as F

from annospark import fixtures as fx
from annospark.operators import matching, metrics, sampling, scoring, status
from annospark.plans import study
from annospark.operators import acceptance as ac
from annospark.registry import sql as q
from annospark.registry.base import register
from annospark.sources.labels import parse_lines

MATCHED = "SELECT image_id, pi, gi, iou, pred_label, gold_label FROM m"


@register("match_greedy", q.query(MATCHED, q.match("m", "candidates", "gold", 0.5)))
def match_greedy(t):
    return matching.match_boxes(t.candidates, t.gold, 0.5)


@register("match_loose", q.query(MATCHED, q.match("m", "candidates", "gold", 0.1)))
def match_loose(t):
    return matching.match_boxes(t.candidates, t.gold, 0.1)


@register("match_class_aware", q.query(MATCHED, q.match("m", "candidates", "gold", 0.5, True)))
def match_class_aware(t):
    return matching.match_boxes(t.candidates, t.gold, 0.5, class_aware=True)


ACCEPTED = ("acc", "SELECT * FROM candidates WHERE p_good >= 0.5")
COUNTS = """SELECT coalesce(a.image_id, g.image_id) AS image_id, coalesce(a.n, 0) AS acc, coalesce(g.n, 0) AS gold FROM
      (SELECT image_id, count(*) AS n FROM acc GROUP BY 1) a FULL JOIN (SELECT image_id, count(*) AS n FROM gold GROUP BY 1) g
      ON a.image_id = g.image_id"""


def _accepted(t):
    return t.candidates.where(F.col("p_good") >= 0.5)


@register(
    "count_fidelity",
    q.query(
        """SELECT avg(acc-gold) AS mean_signed_dev, avg(abs(acc-gold)) AS mean_abs_dev, avg((acc > gold)::INT) AS over_rate,
      avg((acc < gold)::INT) AS under_rate FROM counts""",
        ACCEPTED, ("counts", COUNTS),
    ),
)
def count_fidelity(t):
    n = lambda df: df.groupBy("image_id").agg(F.count("*").alias("n"))
    return metrics.count_fidelity(n(_accepted(t)), n(t.gold))


GRADED = [
    ACCEPTED,
    ("counts", COUNTS),
    *q.match("m", "acc", "gold", 0.5),
    ("right_ones", "SELECT image_id, count(*) AS correct FROM m WHERE pred_label = gold_label GROUP BY 1"),
    ("grades", "SELECT c.*, coalesce(correct, 0) AS correct FROM counts c LEFT JOIN right_ones USING (image_id)"),
]


@register(
    "correct_count_fidelity",
    q.query(
        """SELECT avg(correct-gold) AS mean_correct_dev, round(avg(CASE WHEN gold > 0 THEN correct/gold ELSE 1 END), 9) AS mean_recall,
      round(avg(CASE WHEN acc > 0 THEN correct/acc ELSE 1 END), 9) AS mean_precision FROM grades""",
        GRADED,
    ),
)
def correct_count_fidelity(t):
    return _rounded(metrics.correct_count_fidelity(_accepted(t), t.gold), "mean_recall", "mean_precision")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@register(
    "true_object_suppression",
    q.query(
        """SELECT round(avg(r) FILTER (gold > 3), 9) AS recall_dense_images, count(*) FILTER (gold > 3) AS n_dense,
      round(avg(r) FILTER (gold <= 3), 9) AS recall_sparse_images, count(*) FILTER (gold <= 3) AS n_sparse, 3.0::DOUBLE AS seed_median
      FROM (SELECT gold, correct/gold AS r FROM grades WHERE gold > 0)""",
        GRADED,
    ),
)
def true_object_suppression(t):
    rows = metrics.true_object_suppression(_accepted(t), t.gold, t.seed.median)
    return _rounded(rows, "recall_dense_images", "recall_sparse_images")


DEFECTS = [
    ACCEPTED,
    ("counts", COUNTS),
    *q.match("m", "acc", "gold", 0.1),
    (
        "graded",
        """SELECT image_id, count(*) AS matched, count(*) FILTER (iou < 0.5) AS mislocalized,
      count(*) FILTER (iou >= 0.5 AND pred_label <> gold_label) AS misclassified FROM m GROUP BY 1""",
    ),
    (
        "defects",
        """SELECT image_id, image_id % 7 AS dataset, acc AS n_admitted, acc - coalesce(matched, 0) AS spurious,
      coalesce(mislocalized, 0) AS mislocalized, coalesce(misclassified, 0) AS misclassified, gold - coalesce(matched, 0) AS missed
      FROM counts LEFT JOIN graded USING (image_id)""",
    ),
]
SUMS = """sum(n_admitted)::BIGINT AS n_admitted, sum(spurious)::BIGINT AS spurious, sum(mislocalized)::BIGINT AS mislocalized,
      sum(misclassified)::BIGINT AS misclassified, sum(missed)::BIGINT AS missed,
      sum(spurious+mislocalized+misclassified)::BIGINT AS n_defect,
      CASE WHEN sum(n_admitted) > 0 THEN sum(spurious+mislocalized+misclassified)/sum(n_admitted) ELSE 0 END AS escape_rate"""


@register(
    "image_defects",
    q.query("SELECT image_id, n_admitted, spurious, mislocalized, misclassified, missed FROM defects", DEFECTS),
)
def image_defects(t):
    return metrics.image_defects(_accepted(t), t.gold)


@register("defect_escape", q.query(f"SELECT dataset, {SUMS} FROM defects GROUP BY ROLLUP(dataset)", DEFECTS))
def defect_escape(t):
    """Images belong to one of seven datasets; the row without a dataset is the total."""
    per_image = metrics.image_defects(_accepted(t), t.gold).withColumn("dataset", F.col("image_id") % 7)
    return metrics.defect_escape(per_image, "dataset")


CUTS = (0.1, 0.3, 0.5, 0.7, 0.9)
CUT_ROWS = "(VALUES " + ",".join(f"({c}::DOUBLE)" for c in CUTS) + ") c(tau)"


@register(
    "operating_curve",
    q.query(
        f"""SELECT tau, CASE WHEN n > 0 THEN coalesce(tp, 0)/n ELSE 0 END AS precision,
      coalesce(tp, 0)/(SELECT count(*) FROM gold) AS recall, n AS n_accepted FROM {CUT_ROWS}
      JOIN (SELECT tau, count(*) AS n FROM {CUT_ROWS} JOIN candidates ON p_good >= tau GROUP BY 1) USING (tau)
      LEFT JOIN (SELECT tau, count(*) AS tp FROM m WHERE pred_label = gold_label GROUP BY 1) USING (tau)""",
        (
            "p",
            f"""SELECT *, row_number() OVER (PARTITION BY tau, image_id ORDER BY iou DESC, pi DESC, gi DESC) AS rk FROM (
        SELECT tau, a.image_id, a.box_ord AS pi, b.box_ord AS gi, {q.iou('a', 'b')} AS iou, a.label AS pred_label, b.label AS gold_label
        FROM candidates a JOIN gold b ON a.image_id = b.image_id JOIN {CUT_ROWS} ON a.p_good >= tau WHERE {q.iou('a', 'b')} >= 0.5)""",
        ),
        q.match_pairs("m", "p", ["tau", "image_id"]),
    ),
)
def operating_curve(t):
    return metrics.operating_curve(ac.with_score(t.candidates), t.gold, CUTS)


ACCURACY = [
    ACCEPTED,
    ("counts", COUNTS),
    *q.match("m", "acc", "gold", 0.5, True),
    ("hits", "SELECT image_id, count(*) AS matched, sum(iou) AS s FROM m GROUP BY 1"),
    (
        "rates",
        """SELECT image_id, acc AS pseudo_count, gold AS gt_count, coalesce(matched, 0) AS matched, coalesce(s, 0.0::DOUBLE) AS s,
      CASE WHEN acc > 0 THEN coalesce(matched, 0)/acc ELSE 0 END AS p, CASE WHEN gold > 0 THEN coalesce(matched, 0)/gold ELSE 0 END AS r
      FROM counts LEFT JOIN hits USING (image_id)""",
    ),
]


@register(
    "image_accuracy",
    q.query(
        """SELECT image_id, pseudo_count, gt_count, matched, round(s, 6) AS matched_iou_sum, p AS precision, r AS recall,
      CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0 END AS f1 FROM rates""",
        ACCURACY,
    ),
)
def image_accuracy(t):
    rows = metrics.image_accuracy(_accepted(t), t.gold)
    return rows.withColumn("matched_iou_sum", F.round("matched_iou_sum", 6))


MICRO = """total_matched, total_gt, total_pseudo, total_matched/total_pseudo AS micro_precision, total_matched/total_gt AS micro_recall,
      2*(total_matched/total_pseudo)*(total_matched/total_gt)/(total_matched/total_pseudo+total_matched/total_gt) AS micro_f1,
      round(s/total_matched, 9) AS mean_matched_iou"""
TOTALS = """sum(matched)::BIGINT AS total_matched, sum(gt_count)::BIGINT AS total_gt, sum(pseudo_count)::BIGINT AS total_pseudo, sum(s) AS s"""


@register("batch_accuracy", q.query(f"SELECT {MICRO} FROM (SELECT {TOTALS} FROM rates)", ACCURACY))
def batch_accuracy(t):
    return _rounded(metrics.batch_accuracy(metrics.image_accuracy(_accepted(t), t.gold)), "mean_matched_iou")


@register(
    "pseudo_gt_join",
    q.query(
        f"SELECT {MICRO} FROM (SELECT {TOTALS} FROM rates WHERE image_id % 20 <> 0)", ACCURACY
    ),
)
def pseudo_gt_join(t):
    """Accuracy on the images that no human owns; labels are found by the stem of the image's file."""
    names = t.images.where(F.col("image_id") % 20 != 0).select(F.concat("image_id", F.lit(".jpg")).alias("image_id"))
    by_stem = lambda rows: rows.withColumn("stem", F.col("image_id").cast("string")).drop("image_id")
    pseudo, gold = metrics.pseudo_gt_join(names, by_stem(_accepted(t)), by_stem(t.gold))
    return _rounded(metrics.batch_accuracy(metrics.image_accuracy(pseudo, gold)), "mean_matched_iou")


@register(
    "macro_over_datasets",
    q.query(
        f"""SELECT count(*) AS datasets, round(avg(micro_f1), 9) AS micro_f1, round(avg(mean_matched_iou), 9) AS mean_matched_iou FROM (
      SELECT dataset, {MICRO.replace('round(s/total_matched, 9)', 's/total_matched')} FROM (
      SELECT image_id % 7 AS dataset, {TOTALS} FROM rates GROUP BY 1))""",
        ACCURACY,
    ),
)
def macro_over_datasets(t):
    per_image = metrics.image_accuracy(_accepted(t), t.gold).withColumn("dataset", F.col("image_id") % 7)
    macro = metrics.macro_average(metrics.batch_accuracy(per_image, "dataset"), "micro_f1", "mean_matched_iou")
    return _rounded(macro, "micro_f1", "mean_matched_iou")


@register(
    "class_agnostic_accuracy",
    q.query(
        """SELECT count(*) AS total_matched FROM m""", ACCEPTED, q.match("m", "acc", "gold", 0.5)
    ),
)
def class_agnostic_accuracy(t):
    per_image = metrics.image_accuracy(_accepted(t), t.gold, class_agnostic=True)
    return metrics.batch_accuracy(per_image).select("total_matched")


LIMITS = "(VALUES " + ",".join(f"({c}::DOUBLE)" for c in metrics.AP_LIMITS) + ") l(iou_limit)"
AP = [
    (
        "p",
        f"""SELECT *, row_number() OVER (PARTITION BY iou_limit, image_id ORDER BY iou DESC, pi DESC, gi DESC) AS rk FROM (
        SELECT iou_limit, a.image_id, a.box_ord AS pi, b.box_ord AS gi, {q.iou('a', 'b')} AS iou
        FROM candidates a JOIN gold b ON a.image_id = b.image_id AND a.label = b.label JOIN {LIMITS} ON {q.iou('a', 'b')} >= iou_limit)""",
    ),
    *q.match_pairs("m", "p", ["iou_limit", "image_id"]),
    (
        "steps",
        f"""SELECT l.iou_limit, c.label, c.p_good, count(*) AS n, count(m.pi) AS tp FROM candidates c JOIN {LIMITS} ON true
      LEFT JOIN m ON m.iou_limit = l.iou_limit AND m.image_id = c.image_id AND m.pi = c.box_ord GROUP BY 1, 2, 3""",
    ),
    (
        "curve",
        """SELECT *, sum(tp) OVER (PARTITION BY iou_limit, label ORDER BY p_good DESC)
      / sum(n) OVER (PARTITION BY iou_limit, label ORDER BY p_good DESC) AS pr FROM steps""",
    ),
    ("envelope", "SELECT *, max(pr) OVER (PARTITION BY iou_limit, label ORDER BY p_good) AS best FROM curve"),
    (
        "ap",
        """SELECT e.iou_limit, e.label, n_gold, round(sum(tp*best)/n_gold, 9) AS ap FROM envelope e
      JOIN (SELECT label, count(*) AS n_gold FROM gold GROUP BY 1) USING (label) GROUP BY 1, 2, 3""",
    ),
]


@register("average_precision", q.query("SELECT iou_limit, label, n_gold, ap FROM ap", AP))
def average_precision(t):
    return _rounded(metrics.average_precision(ac.with_score(t.candidates), t.gold), "ap")


@register(
    "mean_average_precision",
    q.query(
        """SELECT round(max(a) FILTER (iou_limit = 0.5), 6) AS map50, round(avg(a), 6) AS map50_95
      FROM (SELECT iou_limit, avg(ap) AS a FROM ap GROUP BY 1)""",
        AP,
    ),
)
def mean_average_precision(t):
    rows = metrics.mean_average_precision(metrics.average_precision(ac.with_score(t.candidates), t.gold))
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns})


@register(
    "compare_methods",
    q.query(
        f"""SELECT * FROM (SELECT 'conf50' AS method, {SUMS} FROM d1 UNION ALL SELECT 'validator50' AS method, {SUMS} FROM d2)""",
        *[
            part
            for i, column in ((1, "det_conf"), (2, "p_good"))
            for part in (
                (f"a{i}", f"SELECT * FROM candidates WHERE {column} >= 0.5"),
                q.match(f"m{i}", f"a{i}", "gold", 0.1),
                (
                    f"d{i}",
                    f"""SELECT (SELECT count(*) FROM a{i}) AS n_admitted, (SELECT count(*) FROM a{i}) - count(*) AS spurious,
      count(*) FILTER (iou < 0.5) AS mislocalized, count(*) FILTER (iou >= 0.5 AND pred_label <> gold_label) AS misclassified,
      (SELECT count(*) FROM gold) - count(*) AS missed FROM m{i}""",
                ),
            )
        ],
    ),
)
def compare_methods(t):
    chosen = {
        "conf50": ac.fixed(ac.with_score(t.candidates, "confidence"), 0.5)[0],
        "validator50": ac.fixed(ac.with_score(t.candidates), 0.5)[0],
    }
    return study.compare_methods(chosen, t.gold)


# -- progress and labels ------------------------------------------------------------------------
STATUS = (
    "status",
    """SELECT i.image_id, coalesce(b.n, 0) AS n_boxes, coalesce(b.classes, '') AS classes, coalesce(c.classes, '') AS ai_classes,
      CASE WHEN i.image_id % 20 = 0 THEN 'human' WHEN coalesce(b.n, 0) > 0 THEN 'auto' ELSE 'none' END AS owner FROM images i
      LEFT JOIN (SELECT image_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT label)), ',') AS classes FROM gold GROUP BY 1) b
        ON b.image_id = i.image_id
      LEFT JOIN (SELECT image_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS classes FROM candidates GROUP BY 1) c
        ON c.image_id = i.image_id""",
)


def _status(t):
    return status.label_status(t.images, fx.with_centre(t.gold), t.ownership, t.candidates)


@register("label_status", q.query("SELECT * FROM status", STATUS))
def label_status(t):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _status(t).withColumns({"classes": text("classes"), "ai_classes": text("ai_classes")})


@register(
    "status_totals",
    q.query(
        "SELECT count(*) FILTER (n_boxes > 0) AS labeled, count(*) FILTER (owner = 'human') AS human, count(*) AS total FROM status", STATUS
    ),
)
def status_totals(t):
    return status.status_totals(_status(t))


BY_CLASS = ("by_class", "SELECT DISTINCT image_id, label AS cls FROM (SELECT image_id, label FROM gold UNION ALL SELECT image_id, label FROM candidates)")


@register("images_with_class", q.query("SELECT image_id FROM by_class WHERE cls = 2", BY_CLASS))
def images_with_class(t):
    by_class = status.images_by_class(fx.with_centre(t.gold), t.candidates)
    return status.images_with_class(t.images, by_class, 2).select("image_id")


@register("class_image_counts", q.query("SELECT cls, count(*) AS images FROM by_class GROUP BY 1", BY_CLASS))
def class_image_counts(t):
    return status.images_by_class(fx.with_centre(t.gold), t.candidates).groupBy("cls").agg(F.count("*").alias("images"))


@register(
    "label_stats",
    q.query(
        """SELECT label AS cls, count(*) AS objects, (SELECT count(DISTINCT image_id) FROM gold) AS n_label_files,
      (SELECT count(*) FROM images) AS n_images FROM gold GROUP BY GROUPING SETS ((label), ())"""
    ),
)
def label_stats(t):
    files = t.gold.select("image_id").distinct()
    return status.label_stats(fx.with_centre(t.gold), files, t.images)


@register("per_class_image_counts", q.query("SELECT label AS cls, count(DISTINCT image_id) AS images FROM gold GROUP BY 1"))
def per_class_image_counts(t):
    return sampling.per_class_image_counts(fx.with_centre(t.gold))


@register(
    "prediction_summary",
    q.query(
        """SELECT (SELECT count(*) FROM images) AS images, count(*) AS candidates, round_even(avg(p_good), 4) AS mean_p_good FROM candidates"""
    ),
)
def prediction_summary(t):
    return status.prediction_summary(t.images, t.candidates)


@register(
    "infer_classes",
    q.query("SELECT c::INT AS cls, concat('class_', c) AS name FROM range((SELECT max(label)+1 FROM gold)) r(c)"),
)
def infer_classes(t):
    return status.infer_classes(fx.with_centre(t.gold))


@register(
    "add_class",
    q.query("SELECT label::INT AS cls, concat('class_', label) AS name FROM (SELECT DISTINCT label FROM gold) UNION ALL SELECT (max(label)+1)::INT, 'big cat' FROM gold"),
)
def add_class(t):
    return status.add_class(status.infer_classes(fx.with_centre(t.gold)), " big,cat ")


@register("seed_images_human", q.query("SELECT image_id, box_ord, label AS cls FROM human"))
def seed_images_human(t):
    return status.seed_images(t.images, fx.with_centre(t.gold), t.ownership).select("image_id", "box_ord", "cls")


@register("seed_images_all", q.query("SELECT image_id, box_ord, label AS cls FROM gold"))
def seed_images_all(t):
    return status.seed_images(t.images, fx.with_centre(t.gold), t.ownership, "all").select("image_id", "box_ord", "cls")


@register("own_after_save", q.query("SELECT image_id FROM owned UNION SELECT image_id FROM images WHERE image_id % 33 = 0"))
def own_after_save(t):
    return status.own(t.ownership, t.images.where(F.col("image_id") % 33 == 0))


LINES = """SELECT image_id, box_ord, CASE WHEN (image_id + box_ord) % 13 = 0 THEN concat(label, ' 0.5 0.5')
      WHEN image_id % 17 = 0 AND box_ord = 1 THEN concat(label, ' 0.5 x 0.1 0.1') ELSE
      concat(label, '.0  ', cx, ' ', cy, ' ', w, ' ', h, CASE WHEN box_ord % 2 = 0 THEN ' 0.9' ELSE '' END) END AS line FROM gold_norm"""


def _lines(t):
    """Label text with short lines, a bad word on some, and a sixth word on others."""
    n, word = fx.with_centre(t.gold), F.col("cls").cast("string")
    full = F.concat_ws(" ", F.concat(word, F.lit(".0 ")), "cx", "cy", "w", "h", F.when(F.col("box_ord") % 2 == 0, "0.9"))
    line = F.when((F.col("image_id") + F.col("box_ord")) % 13 == 0, F.concat(word, F.lit(" 0.5 0.5"))).when(
        (F.col("image_id") % 17 == 0) & (F.col("box_ord") == 1), F.concat(word, F.lit(" 0.5 x 0.1 0.1"))
    )
    return n.select("image_id", F.col("box_ord").alias("line_no"), F.coalesce(line, full).alias("line"))


PARSED = """SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY box_ord) - 1)::INT AS box_ord, cls, cx, cy, w, h FROM gold_norm
      WHERE (image_id + box_ord) % 13 <> 0 AND {extra}"""


@register("parse_labels_drop_row", q.query(PARSED.format(extra="NOT (image_id % 17 = 0 AND box_ord = 1)")))
def parse_labels_drop_row(t):
    return parse_lines(_lines(t), "drop_row", key="image_id")


@register(
    "parse_labels_drop_file",
    q.query(
        PARSED.format(
            extra="""image_id NOT IN (SELECT image_id FROM gold_norm WHERE image_id % 17 = 0 AND box_ord = 1 AND (image_id + box_ord) % 13 <> 0)"""
        )
    ),
)
def parse_labels_drop_file(t):
    return parse_lines(_lines(t), "drop_file", key="image_id")


@register(
    "parse_labels_strict",
    q.query(
        """SELECT image_id, box_ord::INT AS box_ord, cls, cx, cy, w, h FROM cand_norm"""
    ),
)
def parse_labels_strict(t):
    n = fx.with_centre(t.candidates)
    line = F.concat_ws(" ", "cls", "cx", "cy", "w", "h")
    return parse_lines(n.select("image_id", F.col("box_ord").alias("line_no"), line.alias("line")), key="image_id")


# -- validator ----------------------------------------------------------------------------------
@register(
    "validator_metrics",
    """SELECT *, (tp+tn)/n AS accuracy, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall,
      2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) AS f1 FROM (SELECT count(*) FILTER (quality = 0 AND toxic <> 0) AS tn,
      count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn,
      count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) AS n FROM labels)""",
)
def validator_metrics(t):
    rows = t.table("labels").select(F.col("quality").alias("y"), F.when(F.col("toxic") == 0, 1).otherwise(0).alias("yhat"))
    return metrics.validator_metrics(rows)


@register(
    "class_distribution",
    "SELECT count(*) FILTER (quality = 0) AS noise, count(*) FILTER (quality = 1) AS good, count(*) AS total FROM labels",
)
def class_distribution(t):
    return status.class_distribution(t.table("labels").withColumn("y", F.col("quality")))


def _features(t):
    e = t.table("embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).alias("y"))


VALIDATOR_FLOOR = 0.8


@register(
    "train_validator",
    f"""WITH e AS (SELECT vec_id, CAST(embedding[1] > 0 AS INT) AS y FROM embeddings),
    p AS (SELECT y, count(*) OVER (PARTITION BY y) AS n, row_number() OVER (PARTITION BY y ORDER BY {q.order_key(42, 'vec_id')}, vec_id) AS place FROM e),
    s AS (SELECT y, CASE WHEN place <= least(greatest(1, round_even(round(n*0.2::DOUBLE, 9), 0)), n-1) THEN 'val' ELSE 'train' END AS split FROM p)
    SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'train' AND y = 1) AS good_train,
      count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'val' AND y = 1) AS good_val,
      count(*) FILTER (split = 'val' AND y = 0) AS noise_val, true AS accurate FROM s""",
)
def train_validator(t):
    """Train on four fifths of each class and report figures on the rest.

    A crop is good here when its first feature is positive, so the accuracy that a linear model must reach is known.
    """
    crops = _features(t).withColumn("y", (F.col("features")[0] > 0).cast("int"))
    crops = sampling.stratified_split(crops, "vec_id", "y", 0.2, 42)
    train, held = crops.where("split = 'train'"), crops.where("split = 'val'")
    figures = metrics.validator_metrics(scoring.validate(scoring.train_validator(train), held))
    trained = train.agg(F.count("*").alias("n_train"), F.count(F.when(F.col("y") == 1, 1)).alias("good_train"))
    figures = figures.select("n", (F.col("tp") + F.col("fn")).alias("good"), (F.col("tn") + F.col("fp")).alias("noise"), "accuracy")
    row, other = figures.first(), trained.first()
    shown = (other["n_train"], other["good_train"], row["n"], row["good"], row["noise"], row["accuracy"] > VALIDATOR_FLOOR)
    names = "n_train long, good_train long, n_val long, good_val long, noise_val long, accurate boolean"
    return t.spark.createDataFrame([shown], names)


@register(
    "assign_class",
    """SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS label FROM embeddings""",
)
def assign_class(t):
    probs = t.table("embeddings").select("vec_id", F.col("embedding").alias("class_probs"))
    return scoring.assign_class(probs).select("vec_id", "label")


@register(
    "score_candidates",
    """SELECT vec_id, round(1/(1+exp(-list_sum(list_transform(embedding, lambda x: x::DOUBLE)))), 6) AS p_good FROM embeddings""",
)
def score_candidates(t):
    """A stand-in model that squashes the feature sum, run through the pluggable boundary."""

    def load():
        import numpy as np

        def predict(batch):
            total = np.stack(batch["features"].to_numpy()).astype(float).sum(axis=1)
            return batch[["vec_id"]].assign(p_good=1.0 / (1.0 + np.exp(-total)))

        return predict

    scored = scoring.score_candidates(_features(t), load, "vec_id long, p_good double")
    return scored.withColumn("p_good", F.round("p_good", 6))
