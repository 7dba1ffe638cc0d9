"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_in(column: str) -> Column:
    """The number of words of a text, 0 for a null or empty one."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in the given order, dealt over all partitions, with ``__part`` and ``__pos`` added.

    Ordering by ``(__part, __pos)`` is the order asked for, and positions inside a part have no gaps. The
    result is written, so every later use sees the same parts.
    """
    dealt = df.repartitionByRange(partitions_of(df.sparkSession), *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    return cut_lineage(dealt.withColumns({"__part": F.spark_partition_id(), "__pos": row.bitwiseAND(F.lit((1 << 33) - 1))}))
