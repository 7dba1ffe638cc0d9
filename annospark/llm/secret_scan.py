"""Secrets in label files and dataset descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm.secret_spans import SecretFinder
from annospark.llm.tables import text_of

SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def scan_secrets(files: DataFrame, stem: str = "stem", text: str = "text", least_novelty: float = 0.62) -> DataFrame:
    """``stem, spans`` for every label file, ``spans`` being an array of ``(kind, start, end, novelty)``.

    Kinds ``assign``, ``access`` and ``hex`` are fixed patterns and always reported. Kind ``novel`` adds strings of 16
    or more letters and digits, or of letters in changing case, whose place is sensitive by the lines around it
    (``secret_spans.Places``), and all of that length in the body of a private key: the compressor is primed with common
    identifiers and given the text around the string, and the string is reported when it still costs at least
    ``least_novelty`` compressed bytes for each of its own. ``novelty`` gives that figure for all spans. Positions
    are code points, the end is exclusive; spans are ordered by start, then kind in the order named here.

    Whole texts are scanned. Null and empty texts have no spans; repeated rows are scanned each; null stems stay
    null; an empty table gives an empty result; other columns are not read.
    """
    rows = files.select(F.col(stem).alias("stem"), text_of(text).alias("text"))
    kind = rows.schema["stem"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SecretFinder(least_novelty)
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "novelty"), s)) for s in finder.spans(t)] for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("stem"), pa.array(spans, SPAN)], names=["stem", "spans"])

    return rows.mapInArrow(run, f"stem {kind}, spans array<struct<kind:string,start:long,end:long,novelty:double>>")
