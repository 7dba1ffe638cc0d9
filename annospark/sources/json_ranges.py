"""The keys of large JSON maps, read in ranges by several tasks.

Whether a range begins inside a text, and how deep, depends on all that stands before it. So tasks first say of every range what it
does to either beginning (a few numbers), these are followed from range to range, and then tasks read their ranges from there.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.session import spread_out
from annospark.sources.folders import _paths, _rows, list_files, opened_path

JSON_RANGE = 8 << 20  # bytes that a task holds at a time
TEXT = rb'"(?:[^"\\]|\\.)*+"'
WHOLE_TEXT, REST_OF_TEXT = re.compile(TEXT, re.S), re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
TOKEN = rb'(?P<text>"(?:[^"\\]|\\.)*+"?)|(?P<open>[\[{])|(?P<close>[\]}])'
OUTSIDE = re.compile(TOKEN, re.S)
# an object without objects inside leaves the depth as it is and is taken in one step
INSIDE = re.compile(rb'(?P<flat>\{[^{}"]*+(?:' + TEXT + rb'[^{}"]*+)*+\})|' + TOKEN, re.S)
KEY = re.compile(rb"(" + TEXT + rb")\s*+(\S)", re.S)


def _bytes(path: str, block: int, length: int) -> tuple[bytes, int]:
    """A range of a file, and 1 where its first byte follows an odd number of backslashes."""
    with open(path, "rb") as file:
        back, slashes = block, 0
        while back:
            step = min(64, back)
            file.seek(back - step)
            before = file.read(step)
            run = len(before) - len(before.rstrip(b"\\"))
            slashes, back = slashes + run, back - step
            if run < step:
                break
        file.seek(block)
        return file.read(length), slashes % 2


def _text_at(data: bytes, at: int, path: str, block: int) -> tuple[bytes, bytes] | None:
    """The text that begins at ``at`` and the sign behind it, read on where they lie beyond the range; None at the end of the file."""
    more = 4096
    while (found := KEY.match(data, at)) is None:
        longer = _bytes(path, block, len(data) + more)[0]
        if len(longer) == len(data):
            return None
        data, more = longer, more * 2
    return found.groups()


def _effect(data: bytes, start: int) -> tuple[bool, int]:
    """Whether a text is open at the end of data that begins outside of one, and by how much the depth has changed."""
    bare = WHOLE_TEXT.sub(b"", data[start:])
    closed, quote, _ = bare.partition(b'"')
    count = lambda signs: sum(closed.count(s) for s in signs)
    return bool(quote), count((b"{", b"[")) - count((b"}", b"]"))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for path, block, length in _paths(batches, "path", "block", "length"):
            data, skipped = _bytes(path, block, length)
            rest = REST_OF_TEXT.match(data, skipped)
            yield path, block, length, *_effect(data, 0), *((True, 0) if rest is None else _effect(data, rest.end()))

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    return _rows(found(), ("path", "block", "length", "open_0", "depth_0", "open_1", "depth_1"), kinds)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for path, block, length, inside, depth in _paths(batches, "path", "block", "length", "inside", "depth"):
            data, skipped = _bytes(path, block, length)
            at = 0
            if inside:
                rest = REST_OF_TEXT.match(data, skipped)
                at = len(data) if rest is None else rest.end()
            while (m := (INSIDE if depth else OUTSIDE).search(data, at)) is not None:
                at, kind = m.end(), m.lastgroup
                if kind == "open":
                    depth += 1
                elif kind == "close":
                    depth -= 1
                elif kind == "text" and depth == 1:
                    text = _text_at(data, m.start(), path, block)
                    if text is not None and text[1] == b":":
                        yield (json.loads(text[0]),)

    return _rows(found(), ("key",), (pa.string(),))


def map_keys(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """``key`` of every entry of the JSON map in a file, or of those in a folder of files, which Python can open.

    With ``parts`` the files ``part-*`` of a folder are one document, put one after the other by name (``write_document``); a text does not
    go on from part to part. A document that ends too early has no keys. The driver holds one row of numbers for every ``JSON_RANGE`` bytes.
    """
    root = opened_path(path)
    if os.path.isdir(root):
        files = list_files(spark, path)
        files = files.where(F.element_at(F.split("path", "/"), -1).startswith("part-")) if parts else files
    else:
        files = spark.createDataFrame([(root, os.path.getsize(root))], "path string, size long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(JSON_RANGE).cast("long")))
    ranges = files.where("size > 0").select("path", "size", blocks.alias("block"))
    ranges = ranges.select("path", "block", F.least(F.lit(JSON_RANGE), F.col("size") - F.col("block")).alias("length"))
    seen = spread_out(ranges, "path", "block").mapInArrow(
        _effects, "path string, block long, length long, open_0 boolean, depth_0 long, open_1 boolean, depth_1 long"
    )
    documents: dict = {}
    for r in sorted(seen.collect(), key=lambda r: (r["path"], r["block"])):
        begun, inside, depth = documents.setdefault(None if parts else r["path"], ([], [False], [0]))
        begun.append((r["path"], r["block"], r["length"], inside[0], depth[0]))
        which = "1" if inside[0] else "0"
        inside[0], depth[0] = r["open_" + which], depth[0] + r["depth_" + which]
    whole = [row for begun, inside, depth in documents.values() if not inside[0] and not depth[0] for row in begun]
    begins = spark.createDataFrame(whole, "path string, block long, length long, inside boolean, depth long")
    return spread_out(begins, "path", "block").mapInArrow(_keys, "key string")
