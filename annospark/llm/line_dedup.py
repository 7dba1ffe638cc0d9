"""Drop lines that many label files share, with an index that can take files in and out again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm.cuckoo import CuckooFilter
from annospark.llm.tables import text_of
from annospark.session import cut_lineage

EDGE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 50_000  # common lines that one filter shard holds on average
SHIPPED = 64 << 20  # bytes of filters up to which every task gets all of them
KEEP = "stem {kind}, text_key long"


def line_keys(text: bytes | None, least: int) -> list[bytes | None]:
    """A 16-byte digest for each line of a text, None where the line is too short to be dropped.

    The digest is taken of the line without white space at its ends and with A-Z in lower case.
    """
    bare = [line.strip(EDGE) for line in (text or b"").lower().split(b"\n")]
    return [hashlib.sha256(k).digest()[:16] if k and (least <= 1 or len(k.decode("utf-8", "replace")) >= least) else None for k in bare]


def _distinct(texts, least: int) -> list[list[bytes]]:
    return [list(dict.fromkeys(k for k in line_keys(t, least) if k is not None)) for t in texts]


def _counted(least: int):
    """One row for each file and distinct line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for own in _distinct(batch.column("text").cast(pa.binary()).to_pylist(), least) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["line_key"])

    return run


def _screened(least: int, shards: dict[int, bytes] | None, n_shards: int):
    """``stem, text_key, line_key`` of the lines that a filter may hold; of all lines without filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = None if shards is None else {s: CuckooFilter.of_bytes(raw) for s, raw in shards.items()}
        for batch in batches:
            own = _distinct(batch.column("text").cast(pa.binary()).to_pylist(), least)
            owner = [i for i, keys in enumerate(own) for _ in keys]
            flat = [k for keys in own for k in keys]
            if filters is not None and flat:
                by_shard: dict[int, list[int]] = {}
                for i, k in enumerate(flat):
                    by_shard.setdefault(shard_of(k, n_shards), []).append(i)
                hit = sorted(
                    i for s, at in by_shard.items() if s in filters for i, yes in zip(at, filters[s].has([flat[i] for i in at])) if yes
                )
                owner, flat = [owner[i] for i in hit], [flat[i] for i in hit]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("stem").take(at), batch.column("text_key").take(at), pa.array(flat, pa.binary())],
                names=["stem", "text_key", "line_key"],
            )

    return run


def _cleaned(least: int):
    """Texts without the lines whose keys are listed in ``drops``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, drops in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("drops").to_pylist()):
                lines = (text or b"").split(b"\n")
                if drops:
                    bad = set(drops)
                    kept = [line for line, key in zip(lines, line_keys(text, least)) if key is None or key not in bad]
                else:
                    kept = lines
                texts.append(b"\n".join(kept))
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("stem"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["stem", "n_lines", "n_dropped", "text"],
            )

    return run


def shard_of(key: bytes, n_shards: int) -> int:
    return int.from_bytes(key[8:12], "big") % n_shards


def _shard(n_shards: int):
    return F.conv(F.hex(F.substring("line_key", 9, 4)), 16, 10).cast("long") % n_shards


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard from its common lines."""
    keys = [bytes(k) for k in pdf["line_key"]]
    room = len(keys)
    while True:
        made = CuckooFilter.for_keys(room)
        if made.add(keys):
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [made.to_bytes()]})
        room *= 2


def _updated(filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after lines became common or stopped being so; without bytes if it has to be built anew."""
    shard = (filters if len(filters) else changes)["shard"].iloc[0]
    held = CuckooFilter.of_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.for_keys(2 * len(changes))
    held.remove([bytes(k) for k in changes.loc[~changes["added"], "line_key"]])
    ok = held.add([bytes(k) for k in changes.loc[changes["added"], "line_key"]])
    return pd.DataFrame({"shard": [shard], "filter": [held.to_bytes() if ok else None]})


@dataclass(frozen=True)
class LineIndex:
    """Which lines are common among the label files taken in so far.

    ``counts(shard, line_key, n_files)`` counts exactly how many files hold each line; ``filters(shard,
    filter)`` has a cuckoo filter of each shard's common lines, those in ``min_files`` files or more. ``insert``
    and ``remove`` give a new index; both change the counts and, in the filters, only the lines that became
    common or stopped being so. Taking files out that were taken in restores the former counts.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased, as the first 128
    bits of its SHA-256. Lines whose key has fewer than ``min_chars`` code points are never common.
    """

    counts: DataFrame
    filters: DataFrame
    min_files: int
    min_chars: int
    n_shards: int

    @classmethod
    def of(cls, files: DataFrame, min_files: int = 10, min_chars: int = 1, text: str = "text") -> LineIndex:
        """An index of ``files``, with as many shards as their common lines need."""
        counts = cut_lineage(_per_line(files, text, min_chars))
        common = counts.where(F.col("n_files") >= min_files)
        n_shards = max(1, -(-common.count() // SHARD_KEYS))
        counts = counts.withColumn("shard", _shard(n_shards))
        return cls(counts, cls._filters(counts, min_files), min_files, min_chars, n_shards)

    @staticmethod
    def _filters(counts: DataFrame, min_files: int) -> DataFrame:
        common = counts.where(F.col("n_files") >= min_files).select("shard", "line_key")
        return cut_lineage(common.groupBy("shard").applyInPandas(_built, "shard long, filter binary"))

    def insert(self, files: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(_per_line(files, text, self.min_chars))

    def remove(self, files: DataFrame, text: str = "text") -> LineIndex:
        """The index without ``files``, which must have been taken in; a count that would fall below 0 is an error."""
        return self._changed(_per_line(files, text, self.min_chars).withColumn("n_files", -F.col("n_files")))

    def _changed(self, delta: DataFrame) -> LineIndex:
        shard = _shard(self.n_shards)
        both = self.counts.select("line_key", "n_files", F.lit(True).alias("old")).unionByName(delta.select("line_key", "n_files", F.lit(False).alias("old")))
        was = F.coalesce(F.sum(F.when(F.col("old"), F.col("n_files"))), F.lit(0)).alias("was")
        merged = both.groupBy("line_key").agg(F.sum("n_files").alias("n_files"), was)
        wrong = F.raise_error("lines of files that are not in the index were removed").cast("long")
        merged = cut_lineage(merged.withColumn("n_files", F.when(F.col("n_files") < 0, wrong).otherwise(F.col("n_files"))))
        now, before = F.col("n_files") >= self.min_files, F.col("was") >= self.min_files
        crossed = merged.where(now != before).select(shard.alias("shard"), "line_key", now.alias("added"))
        counts = merged.where("n_files > 0").select("line_key", "n_files", shard.alias("shard"))
        filters = self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_updated, "shard long, filter binary")
        filters = cut_lineage(filters)
        if filters.where("filter IS NULL").limit(1).count():
            filters = self._filters(counts, self.min_files)
        return replace(self, counts=counts, filters=filters)

    def drop_common(self, files: DataFrame, stem: str = "stem", text: str = "text") -> DataFrame:
        """``stem, n_lines, n_dropped, text``: the files without their common lines.

        Texts are split at ``\\n``; the lines that stay are joined by it. Tasks screen the lines of their files with
        the cuckoo filters where those take at most ``SHIPPED`` bytes together (beyond it, all lines go on); the
        lines that pass are looked up in the exact counts, so a false alarm drops nothing.

        A null or empty text is one empty line, which is never common. Rows that repeat with the same stem and
        text get the same result each. An empty table gives an empty result. Other columns are not read.
        """
        body = text_of(text)
        rows = files.select(F.col(stem).alias("stem"), F.xxhash64(body).alias("text_key"), body.alias("text"))
        kind = KEEP.format(kind=rows.schema["stem"].dataType.simpleString())
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        shards = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()} if size <= SHIPPED else None
        passed = rows.mapInArrow(_screened(self.min_chars, shards, self.n_shards), f"{kind}, line_key binary")
        common = self.counts.where(F.col("n_files") >= self.min_files).select("line_key")
        hits = passed.join(common, "line_key").groupBy("stem", "text_key").agg(F.collect_set("line_key").alias("drops"))
        hits = hits.select(F.col("stem").alias("__stem"), F.col("text_key").alias("__key"), "drops")
        same = F.col("stem").eqNullSafe(F.col("__stem")) & (F.col("text_key") == F.col("__key"))
        marked = rows.join(hits, same, "left").select("stem", "text", "drops")
        return marked.mapInArrow(_cleaned(self.min_chars), f"{kind.split(',')[0]}, n_lines long, n_dropped long, text string")


def _per_line(files: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``line_key, n_files``: in how many rows of ``files`` each line occurs."""
    lines = files.select(text_of(text).alias("text")).mapInArrow(_counted(min_chars), "line_key binary")
    return lines.groupBy("line_key").agg(F.count("*").alias("n_files"))
