"""Awkward label files: nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f g"),
    (2, "A  b\tc d e f g"),
    (2, "A  b\tc d e f g"),
    (3, "a b c d e f g"),
    (None, "a b c d e f g"),
    (None, "only here, without an id"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "line one\nline two\n line ONE \n"),
    (10, "one"),
    (10, "another text under the same id"),
    (11, "ünïcode – “quotes” 日本語 😀"),
]
CLASHES = "node kept size shard slot digest salt band key text_key content hash target taken score predicted spans copies stem_id".split()


def files(spark, rows=None, id_name="stem"):
    df = spark.createDataFrame([(*r, "src" if r[0] is None or r[0] % 2 else None) for r in (ROWS if rows is None else rows)], f"{id_name} long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return files(spark).limit(0)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
