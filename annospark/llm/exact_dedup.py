"""Exact copies, found by digests that are combined in stages and confirmed on the full content."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from annospark.llm.tables import BLANKS, partitions_of, text_of
from annospark.session import cut_lineage


def exact_copies(files: DataFrame, stem: str = "stem", text: str = "text", salts: int | None = None) -> DataFrame:
    """For every label file the copy that stays: ``stem, keep_stem, group_size, kept, text_sha256``.

    Two files are copies when their texts are identical without white space (``[\\x20\\x09-\\x0D]``). The copy
    with the most code points stays, of those the one with the smallest stem. ``text_sha256`` is the digest of
    the text without white space.

    1. Digests are counted per (digest, salt) and then per digest. A digest that occurs once needs no more.
    2. The files of the other digests are dealt by (digest, salt): one group of copies may hold a third of all
       files and still spreads over ``salts`` tasks. There, identical rows become one row with a count, and
       each content names its winner.
    3. The winners of the salts are combined in bundles of about the square root of ``salts``, then per
       (digest, content), and handed back the same way, so of the hottest group no task holds more contents than that.

    From step 2 on every grouping and join compares the content itself, so files whose digests agree by
    accident stay apart.

    A null text counts as empty, and empty files are copies of each other. A null stem comes after all others.
    Rows that repeat with the same stem and text count each in ``group_size``; at most one of them is kept. An
    empty table gives an empty result. Other columns are not read, whatever their names.
    """
    salts = salts or 4 * partitions_of(files.sparkSession)
    body = text_of(text)
    rows = files.select(F.col(stem).alias("stem"), F.length(body).cast("long").alias("n_chars"), F.regexp_replace(body, BLANKS, "").alias("content"))
    rows = rows.select(
        "stem",
        "n_chars",
        "content",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.pmod(F.xxhash64("stem"), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = cut_lineage(rows.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.min("stem").alias("stem")))
    total = salted.groupBy("digest").agg(F.sum("n").alias("n"), F.min("stem").alias("stem"))
    alone = total.where("n = 1").select(
        "stem", F.col("stem").alias("keep_stem"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )

    several = salted.select("digest", "salt").join(total.where("n > 1").select("digest"), "digest")
    shared = rows.join(several.hint("shuffle_hash"), ["digest", "salt"])
    same = ["digest", "salt", "content"]
    local = cut_lineage(shared.groupBy("stem", *same, "n_chars").agg(F.count("*").alias("copies")))
    best = F.struct((-F.col("n_chars")).alias("n"), F.isnull("stem").alias("none"), F.col("stem").alias("stem"))
    by_salt = local.groupBy(*same).agg(F.min(best).alias("best"), F.sum("copies").alias("copies"))
    by_salt = cut_lineage(by_salt.withColumn("bundle", F.floor(F.col("salt") / math.isqrt(salts)).cast("int")))
    in_bundle = ["digest", "bundle", "content"]
    by_bundle = cut_lineage(by_salt.groupBy(*in_bundle).agg(F.min("best").alias("best"), F.sum("copies").alias("copies")))
    by_text = by_bundle.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("copies").alias("group_size"))
    to_bundles = by_bundle.select(*in_bundle).join(by_text, ["digest", "content"])
    back = by_salt.select(*same, "bundle").join(to_bundles, in_bundle).drop("bundle")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    spread = local.join(back, same).select("stem", "n_chars", "best", "group_size", "digest", each)
    wins = F.col("stem").eqNullSafe(F.col("best.stem")) & (F.col("n_chars") == -F.col("best.n")) & (F.col("copy") == 1)
    copies = spread.select("stem", F.col("best.stem").alias("keep_stem"), "group_size", wins.alias("kept"), "digest")
    return alone.unionByName(copies).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
