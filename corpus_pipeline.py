"""From raw documents to sharded training data, in five stages that each call one operator of ``annospark.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns rows of ``docs`` with all their columns. It tells rows apart by
their ``doc_id`` and a hash of their text, so null and repeated ids get a decision of their own. Rows that repeat with
one id and one text are told apart only by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from annospark.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from annospark.llm.queries import held_out, repeating_weights, table
from annospark.llm.tables import text_of
from annospark.session import cut_lineage


def _unused(docs: DataFrame) -> str:
    """A name that no column of ``docs`` begins with."""
    name = "__row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def _key():
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of("text")).alias("text"))


def _files(docs: DataFrame, *columns) -> DataFrame:
    """Documents as label files whose stem is id and text hash."""
    return docs.select(_key().alias("stem"), "text", *columns)


def _joined(docs: DataFrame, decisions: DataFrame, how: str, numbered: bool = True, by_turn: bool = False) -> tuple[DataFrame, str]:
    """``docs`` joined with ``decisions(stem, ...)`` of their rows, and the name of the columns that were added.

    ``<name>`` holds ``id, text`` and, if ``numbered``, ``turn``, the number among rows equal in both; ``<name>said`` what was
    decided, as one struct, so no column of ``docs`` can clash. With ``by_turn`` decisions carry a ``turn`` as well.
    """
    name = _unused(docs)
    found = F.col(name)
    alike = Window.partitionBy(found["id"], found["text"]).orderBy(found["id"])
    keyed = docs.withColumn(name, _key())
    if numbered:
        keyed = keyed.withColumn(name, F.struct(found["id"].alias("id"), found["text"].alias("text"), F.row_number().over(alike).alias("turn")))
    said = decisions.select(F.struct(*decisions.columns).alias(f"{name}said"))
    other = F.col(f"{name}said")
    same = found["id"].eqNullSafe(other["stem"]["id"]) & (found["text"] == other["stem"]["text"])
    if by_turn:
        same = same & (found["turn"] == other["turn"])
    return keyed.join(said, same, how), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on labels outside the held-out third, scores below 0.7."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select(F.col("doc_id").alias("stem"), "toxic")
    grammar = toxicity.fit_grammar(docs.select(F.col("doc_id").alias("stem"), "text"), labels)
    return toxicity.drop_toxic(docs, grammar, cut=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that shares 80 percent of its five-word shingles."""
    found = near_dedup.near_copies(_files(docs), near_dedup.Likeness(words=5, percent=80))
    kept = found.where("kept").groupBy("stem").agg(F.max("n_shingles").alias("n"))
    both, name = _joined(docs, kept, "inner")
    return both.where((F.col(name)["turn"] == 1) | (F.col(f"{name}said")["n"] == 0)).drop(name, f"{name}said")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, also without one under other numbers, names or units."""
    found = decontaminate.contaminated(_files(docs), table(spark, sf_dir, "benchmark"))
    both, name = _joined(docs, found.select("stem").distinct(), "left_anti", numbered=False)
    return both.drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, dealt to sources by the weights 5, 2, 1 in turn; no document more than three times."""
    files = _files(docs, F.col("source").alias("dataset"))
    mixed = mixing.mix_datasets(files, repeating_weights(files, (5, 2, 1)), passes=3)
    times = mixed.where("taken > 0").groupBy("stem").agg(F.sum(F.expr("taken div size")).alias("times"), F.count("*").alias("rows"))
    both, name = _joined(docs, times, "inner")
    turn, said = F.col(name)["turn"], F.col(f"{name}said")
    own = F.floor(said["times"] / said["rows"]) + (turn <= said["times"] % said["rows"]).cast("int")
    taken = both.withColumn(name, own.cast("int")).where(F.col(name) > 0).drop(f"{name}said")
    return taken.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).drop(name)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``shard`` (0 to 15, nearly equal in bytes) and ``slot``; columns of those names are replaced."""
    placed = sharding.histogram_shards(_files(docs), n_shards=16)
    turn = F.row_number().over(Window.partitionBy("stem").orderBy("shard", "slot"))
    placed = placed.select("stem", "shard", "slot", turn.alias("turn"))
    both, name = _joined(docs.drop("shard", "slot"), placed, "inner", by_turn=True)
    said = F.col(f"{name}said")
    return both.withColumns({"shard": said["shard"], "slot": said["slot"]}).drop(name, f"{name}said")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # learned scores, signatures and hash orders have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
