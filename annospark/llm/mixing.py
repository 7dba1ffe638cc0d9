"""Mix datasets to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.llm.tables import in_order, words_in
from annospark.session import cut_lineage

DATASETS = 100_000  # a mix names its datasets one by one; more than this many is an error


def fair_targets(sizes: dict, weights: dict, budget: float, passes: int) -> dict:
    """How much of each dataset a mix of ``budget`` takes: shares by weight, none above ``passes`` times its size.

    What a full dataset cannot take is shared again by weight among the others.
    """
    targets, live, left = {}, {k for k in sizes if weights.get(k, 0) > 0}, float(budget)
    while live:
        unit = left / sum(weights[k] for k in live)
        full = {k for k in live if weights[k] * unit > passes * sizes[k]}
        if not full:
            targets |= {k: weights[k] * unit for k in live}
            break
        targets |= {k: float(passes * sizes[k]) for k in full}
        left -= sum(passes * sizes[k] for k in full)
        live -= full
    return {k: targets.get(k, 0.0) for k in sizes}


def _running(rows: DataFrame, amount: str, *keys: str) -> DataFrame:
    """``__sum``: the sum of ``amount`` up to and with each row of ``in_order`` rows, per ``keys``.

    Each part is summed on its own; the totals of the parts before it come from one row per part and key.
    """
    inside = Window.partitionBy("__part", *keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.groupBy("__part", *keys).agg(F.sum(amount).alias("__held"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("__part", *keys, F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__before"))
    summed = rows.withColumn("__in", F.sum(amount).over(inside)).join(before, ["__part", *keys])
    return summed.withColumn("__sum", F.col("__in") + F.col("__before")).drop("__in", "__before")


def _cut(queue: DataFrame, budget: float):
    """The last row of a queue in order of ``at`` that a budget still pays for, as ``(at, lane, turn, size)``."""
    parts = queue.groupBy("__part").agg(F.sum("size").alias("held"))
    upto = parts.withColumn("upto", F.sum("held").over(Window.orderBy("__part")))  # one row for each part
    over = upto.where(F.col("upto") > budget).agg(F.min_by(F.struct("__part", "upto", "held"), "__part")).first()[0]
    if over is None:
        return None
    here = queue.where(F.col("__part") == over["__part"])
    paid = F.sum("size").over(Window.partitionBy("__part").orderBy("__pos")) + (over["upto"] - over["held"])
    rest = here.withColumn("paid", paid).where(F.col("paid") > budget)
    return rest.agg(F.min(F.struct("at", "lane", "turn", "size"))).first()[0]


def mix_datasets(
    files: DataFrame,
    weights: dict,
    stem: str = "stem",
    dataset: str = "dataset",
    size: Column | None = None,
    share: float = 1.0,
    passes: int = 3,
    seed: int = 0,
) -> DataFrame:
    """How much of each label file a mix takes: ``stem, dataset, size, source_size, target, taken``.

    ``weights`` gives each dataset (None for rows without one) its weight; a dataset that is not named is not
    taken. ``size`` is the amount a file counts for, by default the words of column ``text``. The budget is
    ``share`` of all sizes. No file is taken more than ``passes`` times; ``taken`` counts repeats.

    The files of a dataset queue in a reproducible random order, pass after pass. A file's virtual finish time
    is what its dataset has delivered when half of the file is through, divided by the weight. The queue of all
    datasets is sorted by finish time, by range, and cut where the budget is spent. A full dataset simply
    stops, so the others share what it leaves; each dataset comes within one file of ``target``.

    Running sums are taken per part of a range-sorted table, so a dataset with a third of all files is no
    problem; per dataset only its sum reaches the driver. Null and empty texts have size 0 and nothing taken.
    Repeated rows queue one after the other. Equal finish times go by weight order and hash, so reruns agree.
    An empty table gives an empty result. Other columns are not read.
    """
    if len(weights) > DATASETS:
        raise ValueError(f"more than {DATASETS} datasets in one mix")
    spark = files.sparkSession
    lanes = {k: i for i, k in enumerate(weights)}
    size = words_in("text") if size is None else size
    rows = files.select(F.col(stem).alias("stem"), F.col(dataset).alias("dataset"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("turn", F.xxhash64(F.lit(seed), "stem", "size"))
    named = spark.createDataFrame(
        [(k, i, float(weights[k])) for k, i in lanes.items()] or [(None, -1, 0.0)], "__name string, lane int, weight double"
    )
    name = F.col("dataset").cast("string").eqNullSafe(F.col("__name"))
    stored = cut_lineage(rows.join(F.broadcast(named), name, "left").drop("__name").fillna({"lane": -1, "weight": 0.0}))
    sizes = {r["lane"]: r["n"] for r in stored.groupBy("lane").agg(F.sum("size").alias("n")).collect()}
    budget = share * sum(sizes.values())
    by_lane = {lanes[k]: float(w) for k, w in weights.items()}
    targets = fair_targets(sizes, by_lane, budget, passes)

    figures = spark.createDataFrame([(k, int(n), targets[k]) for k, n in sizes.items()] or [(-1, 0, 0.0)], "lane int, source_size long, target double")
    lined = _running(in_order(stored, "lane", "turn", "stem", "size"), "size", "lane").join(F.broadcast(figures), "lane")
    # written: the queue is cut and then read again, and both must see the same sums
    lined = cut_lineage(lined.select("stem", "dataset", "lane", "weight", "turn", "size", "source_size", "target", "__sum"))
    finish = lambda p: (p * F.col("source_size") + F.col("__sum") - F.col("size") / 2) / F.col("weight")
    queued = lined.where("weight > 0 AND size > 0")
    each = queued.select("lane", "turn", "size", F.explode(F.array(*[finish(F.lit(p)) for p in range(passes)])).alias("at"))
    end = _cut(in_order(each, "at", "lane", "turn", "size"), budget)
    turn = lambda p: F.struct(finish(F.lit(p)).alias("at"), F.col("lane").alias("lane"), F.col("turn").alias("turn"), F.col("size").alias("size"))
    if end is None:
        times = F.lit(passes)
    else:
        stop = F.struct(F.lit(end["at"]), F.lit(end["lane"]), F.lit(end["turn"]).cast("long"), F.lit(end["size"]).cast("long"))
        times = sum((turn(p) < stop).cast("int") for p in range(passes))
    taken = F.when((F.col("weight") > 0) & (F.col("size") > 0), F.col("size") * times).otherwise(0).cast("long")
    return lined.select("stem", "dataset", "size", "source_size", "target", taken.alias("taken"))
