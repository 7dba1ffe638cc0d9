"""Token counts of label files, without splitting them into tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm.longest_match import PieceCounter
from annospark.llm.tables import text_of

VOCABULARY = 500_000  # pieces that are sent to every task; a larger vocabulary is an error


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a vocabulary file in the ``sentencepiece`` format."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not odd(i)]


def count_tokens(files: DataFrame, pieces: list[str], stem: str = "stem", text: str = "text") -> DataFrame:
    """``stem, n_words, n_tokens`` for every label file.

    A text is split into words at ``[\\x20\\x09-\\x0D]``; each word, with its start mark, is split into the longest
    vocabulary pieces from left to right (see ``PieceCounter``), and only their number is kept. Whole texts are
    counted. Null and empty texts have none; repeated rows are counted each; null stems stay null; an empty
    table gives an empty result; other columns are not read. ``pieces`` is sent to every task and must not
    have more than ``VOCABULARY`` entries.
    """
    if len(pieces) > VOCABULARY:
        raise ValueError(f"a vocabulary of more than {VOCABULARY} pieces")
    rows = files.select(F.col(stem).alias("stem"), text_of(text).alias("text"))
    kind = rows.schema["stem"].dataType.simpleString()
    shipped = rows.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shipped.value)
        for batch in batches:
            words, tokens = [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                found = [w.decode() for w in raw.split()]
                words.append(len(found))
                tokens.append(counter.pieces_of(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("stem"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["stem", "n_words", "n_tokens"]
            )

    return rows.mapInArrow(run, f"stem {kind}, n_words long, n_tokens long")
