"""Folders of files: writing them under names of their own, listing them and reading them in tasks."""

import io
import os
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annospark.sinks import named_files
from annospark.sources import folders, images as im, labels
from annospark.sources.image_headers import size_of

LABELS = "stem string, box_ord int, cls int, cx double, cy double, w double, h double"
ODD = ["plain", "_begins", ".hidden", "a b", "per%20cent", "plus+", "x=1", "dots.in.it", "é日本😀", "quote\"'", "back\\slash", "stem=1"]


def test_label_files_have_the_names_other_tools_expect(spark, tmp_path):
    rows = [(s, i, i, 0.5, 0.25, 0.125, 0.25) for s in ODD for i in range(3)]
    boxes = spark.createDataFrame(rows, LABELS)
    stems = spark.createDataFrame([(s,) for s in [*ODD, "none"]], "stem string")
    out = str(tmp_path / "labels")
    named_files.write_label_files(stems, boxes, out)
    assert sorted(os.listdir(out)) == sorted(f"{s}.txt" for s in [*ODD, "none"])
    assert (tmp_path / "labels" / "a b.txt").read_bytes() == b"".join(b"%d 0.500000 0.250000 0.125000 0.250000\n" % i for i in range(3))
    assert (tmp_path / "labels" / "none.txt").read_bytes() == b""
    back = labels.read_labels(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert {r["stem"] for r in labels.label_files(spark, out).collect()} == {*ODD, "none"}
    # one image again, now without a box: its file is replaced, others stay
    named_files.write_label_files(stems.where("stem = 'plain'"), boxes.limit(0), out)
    assert labels.read_labels(spark, out).count() == len(rows) - 3 and (tmp_path / "labels" / "plain.txt").read_bytes() == b""


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(f"f{i}", b"x", 0) for i in range(50)], "name string, content binary, at int")
    named_files.write_named(good.where("name = 'f1'"), out, "at")
    for bad in ("a/b", "", None, ".."):
        rows = good.unionByName(spark.createDataFrame([(bad, b"y", 0)], good.schema))
        with pytest.raises(PySparkException):
            named_files.write_named(rows, out, "at")
        assert os.listdir(out) == ["f1"]
    with pytest.raises(PySparkException):  # fails while rows are made
        named_files.write_named(good.withColumn("content", F.when(F.col("name") == "f7", F.raise_error(F.lit("no"))).otherwise(F.col("content"))), out, "at")
    assert os.listdir(out) == ["f1"]
    with pytest.raises(ValueError):
        named_files.write_named(good, "s3://somewhere/out", "at")


def test_contents_are_put_together_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("name"), F.encode(F.format_string("%d,", "id"), "UTF-8").alias("content"), "id")
    named_files.write_named(rows.repartition(7), str(tmp_path / "out"), "id")
    for k in range(3):
        assert (tmp_path / "out" / f"f{k}").read_text() == "".join(f"{i}," for i in range(k, 5000, 3))


def test_lines_of_files_in_ranges(spark, tmp_path, monkeypatch):
    texts = {"a": "﻿0 1\n\n2\r\n3\r4 é\nlast", "b": "", "c": "x\n" * 50, "d": "\r\n", "e": "é" * 40 + "\n" + "z"}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, text in texts.items():
        where = tmp_path / "deep" / "er" if name in "bc" else tmp_path
        (where / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "other.csv").write_text("no")
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(folders, "RANGE", size)
        lines = {}
        for r in labels.read_lines(spark, str(tmp_path)).orderBy("stem", "line_no").collect():
            lines.setdefault(r["stem"], []).append(r["line"])
        assert lines == {"a": ["0 1", "", "2", "3", "4 é", "last"], "c": ["x"] * 50, "d": [""], "e": ["é" * 40, "z"]}, size
    found = {r["stem"]: r["text"] for r in labels.read_label_texts(spark, str(tmp_path)).collect()}
    assert found == {**texts, "a": texts["a"][1:]}


def test_listing_goes_down_level_by_level(spark, tmp_path):
    for i in range(30):
        folder = tmp_path / f"d{i % 3}" / f"e{i % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(b"x" * i)
    (tmp_path / "top.png").write_bytes(b"")
    (tmp_path / "_staged-1").mkdir()
    (tmp_path / "_staged-1" / "half.png").write_bytes(b"")
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    found = {os.path.basename(r["path"]): r["size"] for r in folders.list_files(spark, f"file://{tmp_path}", recursive=True).collect()}
    assert found == {**{f"{i}.png": i for i in range(30)}, "top.png": 0}
    assert [r["image_id"] for r in im.list_images(spark, str(tmp_path)).collect()] == ["top.png"]
    with pytest.raises(PySparkException):
        folders.list_files(spark, str(tmp_path / "missing")).count()


def segment(marker, body):
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


JPEG = b"\xff\xd8" + segment(0xE1, b"exif" * 16_000) + b"\xff" + segment(0xC4, b"tables") + segment(0xC2, struct.pack(">BHH", 8, 30, 40) + b"\3")
ENTRY = struct.pack("<HHII", 254, 4, 1, 0) + struct.pack("<HHIHH", 256, 3, 1, 40, 0) + struct.pack("<HHII", 257, 4, 1, 30)
HEADERS = {
    "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 40, 30),
    "gif": b"GIF87a" + struct.pack("<HH", 40, 30),
    "bmp": b"BM" + bytes(12) + struct.pack("<Iii", 40, 40, -30),
    "os2": b"BM" + bytes(12) + struct.pack("<IHH", 12, 40, 30) + bytes(4),
    "jpg": JPEG,
    "tif": b"II*\0" + struct.pack("<I", 100) + bytes(92) + struct.pack("<H", 3) + ENTRY,
    "big": b"MM\0+" + struct.pack(">HHQ", 8, 0, 16) + struct.pack(">Q", 2) + struct.pack(">HHQHHI", 256, 3, 1, 40, 0, 0) + struct.pack(">HHQQ", 257, 16, 1, 30),
    "vp8": b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 40 | 1 << 14, 30),
    "vp8l": b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 39 | 29 << 14) + bytes(5),
    "vp8x": b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (39).to_bytes(3, "little") + (29).to_bytes(3, "little"),
}


@pytest.mark.parametrize("kind", HEADERS)
def test_headers(kind):
    assert size_of(io.BytesIO(HEADERS[kind])) == [40, 30]
    for n in (0, 1, 5, len(HEADERS[kind]) - 4):
        with pytest.raises(ValueError):
            size_of(io.BytesIO(HEADERS[kind][:n]))


def test_sizes_of_a_folder(spark, tmp_path):
    for kind, head in HEADERS.items():
        (tmp_path / f"{kind}.png").write_bytes(head)
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "zero.gif.bmp").write_bytes(b"GIF89a" + bytes(10))
    rows = {r["image_id"]: (r["width"], r["height"], r["readable"]) for r in im.image_sizes(spark, str(tmp_path)).collect()}
    assert rows == {**{f"{k}.png": (40, 30, True) for k in HEADERS}, "bad.jpg": (None, None, False), "zero.gif.bmp": (None, None, False)}


def test_commit_marks_folders_and_tasks_rename_files(spark, tmp_path):
    """The commit touches a folder for each attempt, not each file; a rename that is made again finds its file."""
    import pyarrow as pa

    from annospark.sinks import named_files as nf

    own, out = tmp_path / "staged" / "0-0", tmp_path / "out"
    own.mkdir(parents=True)
    out.mkdir()
    for name in "abc":
        (own / name).write_text(name)
    nf.NamedFileWriter(str(tmp_path / "staged")).commit([nf.Written(str(own)), None])
    done = tmp_path / "staged" / "done-0"
    assert sorted(p.name for p in done.iterdir()) == ["a", "b", "c"]
    paths = pa.RecordBatch.from_pydict({"path": [str(done / n) for n in "abc"]})
    for _ in range(2):
        assert next(nf._publish(str(out))(iter([paths]))).to_pydict() == {"n": [3]}
    assert sorted(p.name for p in out.iterdir()) == ["a", "b", "c"]
