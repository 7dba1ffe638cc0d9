"""Exact order statistics and dense numbering without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.session import cut_lineage

BINS = 4096
FINE_ENOUGH = 50_000
ONE_TASK = 200_000


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest value (1-based), None when there are fewer values.

    The value range is narrowed by counting: each pass counts ``BINS`` equal slices and keeps the
    slice the k-th value lies in. Only the counts of one slice reach the driver. Passes end when the
    slice has few distinct values, which are then counted with their multiplicity.
    """
    if k < 1:
        return None
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if n < k:
        return None
    part = values
    while low < high and n > FINE_ENOUGH:
        width = (high - low) / BINS
        if not low < low + width < high:
            break
        piece = F.least(F.lit(BINS - 1), F.floor((F.col("v") - low) / width).cast("int"))
        slices = part.groupBy(piece.alias("piece")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        above = F.sum("n").over(Window.orderBy(F.desc("piece")))  # at most BINS rows
        hit = (
            slices.withColumn("reached", above)
            .where(F.col("reached") >= k)
            .orderBy(F.desc("piece"))
            .first()
        )
        k -= hit["reached"] - hit["n"]
        low, high, n = hit["low"], hit["high"], hit["n"]
        part = values.where(F.col("v").between(low, high))
    if low == high:
        return low
    counted = part.groupBy("v").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(Window.orderBy(F.desc("v")))  # at most FINE_ENOUGH rows
    return counted.withColumn("reached", reached).where(F.col("reached") >= k).agg(F.max("v")).first()[0]


def running(df: DataFrame, order, totals: dict, keys=(), largest: bool = False) -> DataFrame:
    """Running sums (or, with ``largest``, running maxima) of columns in ``order``, including the row.

    With ``keys`` the runs start anew for each key. A key may hold any share of the rows: rows are
    range-partitioned by key and order, each partition is summed on its own, and what the partitions
    before it hold of the same key is added. Those sums have about one row per partition. A table of
    at most ``ONE_TASK`` rows is summed by a plain window.
    """
    total = F.max if largest else F.sum
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # written first: its size is then known, and finding the range bounds does not compute it again
    stored = cut_lineage(df.withColumns({f"__v_{n}": c for n, c in totals.items()}))
    if stored.count() <= ONE_TASK:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return stored.select(*df.columns, *[total(f"__v_{n}").over(upto).alias(n) for n in totals])
    ranged = stored.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id())
    # written as well: the bounds are sampled, so both uses below must see the same partitions
    ranged = cut_lineage(ranged)
    held = ranged.groupBy("__part", *keys).agg(*[total(f"__v_{n}").alias(f"__t_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)]
    sums = [total(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in totals]
    before = held.select(F.col("__part").alias("__at"), *own, *sums)
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__part") == F.col("__at")  # null is a key like any other
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    out = ranged.withColumns({n: total(f"__v_{n}").over(inside) for n in totals}).join(before, same)
    joined = F.greatest if largest else (lambda x, y: x + F.coalesce(y, F.lit(0)))
    out = out.withColumns({n: joined(F.col(n), F.col(f"__b_{n}")) for n in totals})
    return out.select(*df.columns, *totals)


def dense_ids(df: DataFrame, order, name: str = "id") -> DataFrame:
    """Number rows 1..n in ``order``, which must be unique."""
    return running(df, order, {name: F.lit(1).cast("long")})


def numbered(rows: DataFrame, order, name: str, hot: DataFrame | None, key: str = "image_id") -> DataFrame:
    """Number the rows of each ``key`` from 0.

    ``hot`` names the keys that hold too many rows for one task; those are numbered across tasks.
    """
    order = [order] if isinstance(order, str) else list(order)
    window = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")
    if hot is None:
        return rows.withColumn(name, window)
    hot = hot.select(F.col(key).alias("__hot"))
    same = F.col(key).eqNullSafe(F.col("__hot"))
    small = rows.join(hot, same, "left_anti").withColumn(name, window)
    large = running(rows.join(hot, same, "left_semi"), order, {name: F.lit(1).cast("long")}, [key])
    return small.unionByName(large.withColumn(name, F.col(name) - 1))


def numbered_once(rows: DataFrame, order, name: str, hot: DataFrame | None, key: str = "image_id") -> DataFrame:
    """``numbered`` for rows of ``key`` and ``order`` alone that may repeat; equal rows count once.

    Without large keys the sort that numbers them also finds the repeats: the first of equal rows is the one whose rank is its place.
    """
    if hot is not None:
        return numbered(rows.distinct(), order, name, hot, key)
    window = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumns({"__place": F.row_number().over(window), "__rank": F.rank().over(window), name: F.dense_rank().over(window)})
    return placed.where("__place = __rank").withColumn(name, (F.col(name) - 1).cast("long")).drop("__place", "__rank")
