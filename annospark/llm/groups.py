"""Connected components of links, and handing results back to the members of large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annospark.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; ``root`` is the smallest node that it reaches.

    Union by stars: a round points all larger neighbours of a node to its smallest one, then all smaller ones.
    The number of rounds grows with the logarithm of the longest chain; each is two joins over the links, which
    stay on the executors, and ends in a written table.
    """
    stars = cut_lineage(_ordered(links.where("a <> b"), F.col("a"), F.col("b")))
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        before = state
        both = stars.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
            stars.select(F.col("low").alias("u"), F.col("high").alias("v"))
        )
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high")
        small = small.select("high", F.col("m").alias("low")).unionByName(
            small.where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        )
        stars = cut_lineage(small.distinct())


def _ordered(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()


def hand_back(rows: DataFrame, found: DataFrame, key: str, salt: Column) -> DataFrame:
    """``rows`` inner-joined to ``found`` on ``key``, which is unique in ``found`` and may be very frequent in ``rows``.

    What was found goes to the pairs of key and salt that occur, then the rows join on both, so no task gets
    all rows of a key.
    """
    salted = rows.withColumn("__salt", salt)
    occurring = salted.groupBy(key, "__salt").agg(F.lit(1).alias("__one")).drop("__one")
    return salted.join(occurring.join(found, key), [key, "__salt"]).drop("__salt")
