"""Many files with names of their own in one folder, such as the ``<stem>.txt`` that other tools read."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from annospark.sinks.exports import label_lines
from annospark.session import spread_out
from annospark.sources.folders import STAGED, _paths, list_files, opened_path

DONE = "done-"  # folders of finished attempts


@dataclass
class Written(WriterCommitMessage):
    folder: str


class NamedFiles(DataSource):
    """Rows ``(name, content)``, those of a file one after the other, as files of one folder."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFileWriter(self.options["staged"])


class NamedFileWriter(DataSourceWriter):
    """Tasks write into folders of their own below ``_staged-...``; the commit marks those of finished attempts.

    A task keeps one file open, whatever its size. An attempt that fails removes its folder, a write that fails
    removes them all; readers of this library do not look into them.
    """

    def __init__(self, staged: str):
        self.staged = staged

    def write(self, rows: Iterator) -> Written:
        own = f"{self.staged}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        os.makedirs(own)
        name, file = None, None
        try:
            for row in rows:
                if file is None or row["name"] != name:
                    if file is not None:
                        file.close()
                    name = row["name"]
                    if not name or "/" in name or "\0" in name or name in (".", ".."):
                        raise ValueError(f"no name for a file: {name!r}")
                    file = open(f"{own}/{name}", "xb")
                file.write(row["content"] or b"")
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise
        finally:
            if file is not None:
                file.close()
        return Written(own)

    def commit(self, messages: list) -> None:
        for i, message in enumerate(m for m in messages if m is not None):
            os.replace(message.folder, f"{self.staged}/{DONE}{i}")

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def _publish(folder: str) -> Callable:
    """Renames files into ``folder``; a task that is run again finds some of them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for (path,) in _paths(batches, "path"):
            target = f"{folder}/{os.path.basename(path)}"
            try:
                os.replace(path, target)
            except FileNotFoundError:
                if not os.path.exists(target):
                    raise
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_named(rows: DataFrame, folder: str, order: str) -> None:
    """One file for each ``name`` of ``rows(name, content, <order>)``: its contents in ``order``, one after the other.

    Files appear when the whole write is done; those of other names stay. The folder must be one that all machines can
    open. A name that is null, empty or no file name is an error, and then nothing is written.
    """
    path = opened_path(folder)
    if path is None:
        raise ValueError(f"files with names need a folder that can be opened, not {folder}")
    os.makedirs(path, exist_ok=True)
    rows.sparkSession.dataSource.register(NamedFiles)
    dealt = rows.repartition("name").sortWithinPartitions("name", order)
    staged = f"{path}/{STAGED}{uuid.uuid4().hex}"
    try:
        dealt.select("name", "content").write.format("named_files").option("staged", staged).mode("append").save()
        if os.path.isdir(staged):
            found = list_files(rows.sparkSession, staged, recursive=True)  # written down before the first is renamed
            finished = found.where(F.startswith("path", F.lit(f"{staged}/{DONE}"))).select("path")
            spread_out(finished, "path").mapInArrow(_publish(path), "n long").agg(F.sum("n")).collect()
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def write_label_files(images: DataFrame, boxes: DataFrame, folder: str) -> None:
    """``<stem>.txt`` for every image, with its boxes in list order, clipped to the image; empty for an image without a box.

    ``images`` has ``stem``, ``boxes`` has ``stem, box_ord, cls, cx, cy, w, h``. Very many images are better kept by ``write_label_table``.
    """
    lines = label_lines(images, boxes)
    ended = F.when(F.col("line") != "", F.encode(F.concat("line", F.lit("\n")), "UTF-8"))
    write_named(lines.select(F.concat("stem", F.lit(".txt")).alias("name"), ended.alias("content"), "box_ord"), folder, "box_ord")
