"""Files in folders, listed and read in tasks, so that no name passes through the driver.

Folders that Python can open are listed one level after the other: each task lists folders and streams what it finds. Other stores
are left to Spark's own file index.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annospark.functions.names import decoded
from annospark.session import cut_lineage, spread_out

BATCH = 10_000
STAGED = "_staged-"  # folders of writes that are not finished
OPENED = 256
RANGE = 64 << 20  # bytes of a file that are read at once
FOUND = "path string, size long, folder boolean"


def opened_path(folder: str) -> str | None:
    """The folder as a path for ``open``, None where it lies in a store that only Spark reads."""
    url = urlparse(folder)
    if url.scheme == "file":
        return unquote(url.path)
    return None if url.scheme else os.path.abspath(folder)


def _rows(rows: Iterator[tuple], names: tuple[str, ...], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``BATCH`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held, names, kinds)
            held = []
    if held:
        yield _batch(held, names, kinds)


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _paths(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def entries():
        for (folder,) in _paths(batches, "path"):
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_file():
                        yield e.path, e.stat().st_size, False
                    elif e.is_dir(follow_symlinks=False) and not e.name.startswith(STAGED):
                        yield e.path, None, True

    return _rows(entries(), ("path", "size", "folder"), (pa.string(), pa.int64(), pa.bool_()))


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``(path, size)`` of the files in a folder, with ``recursive`` also of those below it. Contents are not read.

    Links to folders are not followed. A folder that cannot be listed is an error.
    """
    root = opened_path(folder)
    if root is None:
        reader = spark.read.format("binaryFile")
        reader = reader.option("recursiveFileLookup", "true") if recursive else reader
        return reader.load(folder).select(decoded(F.col("path")).alias("path"), F.col("length").alias("size"))
    level, found = spark.range(1).select(F.lit(root).alias("path")), None
    while True:
        seen = cut_lineage(level.mapInArrow(_scan, FOUND))
        files = seen.where("NOT folder").select("path", "size")
        found = files if found is None else found.unionByName(files)
        below = seen.where("folder").select("path")
        if not recursive or not below.limit(1).count():
            return found
        level = spread_out(below, "path")


def read_ranges(files: DataFrame) -> DataFrame:
    """``(path, block, row, line)`` of text files ``(path, size)``; ``(block, row)`` orders the lines of a file.

    Lines end with a line feed, a carriage return or both. A large file is read in ranges of ``RANGE`` bytes by several tasks; a line belongs to
    the range that it begins in. A byte order mark is skipped, bytes that are no UTF-8 are replaced.
    """
    parts = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(RANGE).cast("long"))).alias("block"))
    return spread_out(parts, "path", "block").mapInArrow(_lines(RANGE), "path string, block long, row long, line string")


def _lines(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines():
            for path, block in _paths(batches, "path", "block"):
                with open(path, "rb") as file:
                    if block:
                        file.seek(block - 1)
                        file.readline()  # the rest of a line that begins before
                    n = 0
                    while file.tell() < block + length and (raw := file.readline()):
                        if not block and not n:
                            raw = raw.removeprefix(b"\xef\xbb\xbf")
                        for line in raw.splitlines() or [b""]:
                            yield path, block, n, line.decode("utf-8", "replace")
                            n += 1

        return _rows(lines(), ("path", "block", "row", "line"), (pa.string(), pa.int64(), pa.int64(), pa.string()))

    return run


def read_each(paths: DataFrame, look: Callable, column: str, kind: pa.DataType) -> DataFrame:
    """``paths`` with what ``look(open binary file)`` says of each file in ``column``, null where it cannot tell (``ValueError``).

    ``look`` seeks and reads what it needs. Files are opened in tasks, ``OPENED`` results are held at a time.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
    named = {pa.string(): "string", pa.list_(pa.int32()): "array<int>"}[kind]
    return spread_out(paths, "path").mapInArrow(_looked(look, column, kind), f"{fields}, {column} {named}")


def _looked(look: Callable, column: str, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OPENED):
                batch, said = whole.slice(at, OPENED), []
                for path in batch.column("path").to_pylist():
                    with open(path, "rb") as file:
                        try:
                            said.append(look(file))
                        except ValueError:
                            said.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, kind)], names=[*batch.schema.names, column])

    return run


def in_stem_folder(path: Column) -> Column:
    """The stem in paths like ``.../stem=<stem>/part``, as Spark's writers escape it; empty for others."""
    return decoded(F.regexp_extract(path, r"/stem=([^/]+)/[^/]*$", 1))
