"""Toxicity scores from a grammar of abusive clauses that labelled texts calibrate."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm.grammar import LEAST, ODDS, Grammar, fragments_of, lexicon, weighted, with_lexicon
from annospark.llm.tables import text_of
from annospark.session import cut_lineage

SAMPLE = 12_000  # labelled files that a grammar is fitted on


def fit_grammar(files: DataFrame, labels: DataFrame, stem: str = "stem", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """A grammar fitted on at most ``sample`` labelled files, chosen by a hash of their stem.

    ``labels(stem, label)`` marks files 1 (toxic) or 0; rows without a stem or a label are left out, and of
    several labels of a stem the largest counts. The chosen labels are few enough to be sent to every task. Their
    texts stay with the tasks, which count fragments and signs; what is clear and the distinct signs reach the driver. Without labels of both kinds the built-in grammar is returned.
    """
    marks = labels.select(F.col(stem).alias("__stem"), F.col(label).cast("int").alias("__toxic")).where("__stem IS NOT NULL AND __toxic IS NOT NULL")
    marks = marks.groupBy("__stem").agg(F.max("__toxic").alias("__toxic")).orderBy(F.xxhash64("__stem"), "__stem").limit(sample)
    chosen = files.select(F.col(stem).alias("__stem"), text_of(text).alias("text")).join(F.broadcast(marks), "__stem")
    chosen = cut_lineage(chosen.groupBy("text").agg((F.max("__toxic") > 0).cast("int").alias("toxic")))  # copies teach once
    totals = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Grammar()
    met = chosen.mapInArrow(_fragments, "fragment string, toxic int, place long")
    counted = met.groupBy("fragment").agg(
        F.count_distinct("place").alias("around"),
        *[F.count_if(F.col("place").isNull() & (F.col("toxic") == y)).alias(name) for y, name in ((1, "dirty"), (0, "clean"))],
    )
    odds = ((F.col("dirty") + 0.5) / (totals[1] + 1)) / ((F.col("clean") + 0.5) / (totals[0] + 1))
    clear = counted.where((F.col("around") >= LEAST) & (F.col("dirty") >= LEAST) & (odds >= ODDS)).select("fragment", "around")
    model = with_lexicon(*lexicon({r["fragment"]: r["around"] for r in clear.collect()}))
    signs = chosen.mapInArrow(_features(model), "toxic int, signs array<double>").groupBy("signs", "toxic").agg(F.count("*").alias("n"))
    rows = sorted((r["signs"], r["toxic"], r["n"]) for r in signs.collect())
    return weighted(model, *map(list, zip(*rows)))


ROWS = 100_000  # fragments handed on at once


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = fragments_of(text, y)
            while part := list(islice(found, ROWS)):
                columns = [pa.array([f for f, _ in part], pa.string()), pa.array([y] * len(part), pa.int32()), pa.array([p for _, p in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["fragment", "toxic", "place"])


def _features(grammar: Grammar):
    given = _arguments(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Grammar(*given)
        for batch in batches:
            signs = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(signs, pa.list_(pa.float64()))], names=["toxic", "signs"])

    return run


def score_files(files: DataFrame, grammar: Grammar, stem: str = "stem", text: str = "text", cut: float = 0.7) -> DataFrame:
    """``stem, score, predicted`` for every label file.

    ``score`` in (0, 1) grows with the insults and threats in the file's clauses; a clause that aims at someone
    weighs more, a negated or reported one less. ``predicted`` is 1 from ``cut`` on. Only the text is looked at,
    to its end. Null and empty texts get the score of a text without any sign. Repeated rows are scored each;
    null stems stay null; an empty table gives an empty result; other columns are not read.
    """
    rows = files.select(F.col(stem).alias("stem"), text_of(text).alias("text"))
    kind = rows.schema["stem"].dataType.simpleString()
    scored = rows.mapInArrow(_scores(grammar, "stem"), f"stem {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(files: DataFrame, grammar: Grammar, text: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of ``files`` that score below ``cut``, with all their columns."""
    score = _score_column(grammar)
    return files.where(score(text_of(text)) < cut)


def _arguments(grammar: Grammar):
    return grammar.words, grammar.stems, grammar.weights, grammar.bias


def _scores(grammar: Grammar, key: str):
    given = _arguments(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Grammar(*given)
        for batch in batches:
            values = [model.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values, pa.float64())], names=[key, "score"])

    return run


def _score_column(grammar: Grammar):
    given = _arguments(grammar)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Grammar(*given)
        for t in texts:
            yield t.map(model.score).astype(float)

    return score
