"""Readers and writers on small folders."""

import json
import struct
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annospark.operators import status
from annospark.sinks import exports
from annospark.sources import catalog, images as im, labels, overlay


def png(width, height, pixel):
    """A colour image; ``pixel(x, y)`` gives (r, g, b)."""
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def put(folder, **files):
    for name, data in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def folder(tmp_path):
    put(
        tmp_path,
        **{
            "img/1 (10).png": png(40, 30, lambda x, y: (x, y, 7)),
            "img/b+c.PNG": png(8, 6, lambda x, y: (255, 0, 0)),
            "img/notes.md": "no image",
            "img/old.tif": "wide only",
            "lab/1 (10).txt": "0 0.5 0.5 0.2 0.2\n1.0 0.25 0.25 0.1 0.1 0.9\n\n2 0.5\n",
            "lab/b+c.txt": "﻿3 0.5 0.5 0.5 0.5\r\n",
            "lab/empty.txt": "",
        },
    )
    return tmp_path


def test_list_images(spark, folder):
    narrow = {r["image_id"] for r in im.list_images(spark, str(folder / "img")).collect()}
    wide = {r["image_id"] for r in im.list_images(spark, str(folder / "img"), wide=True).collect()}
    assert narrow == {"1 (10).png", "b+c.PNG"} and wide == narrow | {"old.tif"}


def test_image_sizes_and_crops(spark, folder):
    sizes = {tuple(r) for r in im.image_sizes(spark, str(folder / "img")).collect()}
    # a file with an image ending that is no image keeps its row
    assert sizes == {("1 (10).png", 40, 30, True), ("b+c.PNG", 8, 6, True), ("old.tif", None, None, False)}
    boxes = spark.createDataFrame(
        [("1 (10).png", "a", -5.0, -5.0, 50.0, 50.0), ("1 (10).png", "b", 50.0, 2.0, 60.0, 9.0), ("1 (10).png", "c", 3.9, 4.9, 6.2, 7.0)],
        "image_id string, box_id string, x1 double, y1 double, x2 double, y2 double",
    )
    pixels = im.read_images(spark, str(folder / "img"))
    crops = {r["box_id"]: r for r in im.extract_crops(pixels, boxes).collect()}
    # a box right of the frame starts at the last pixel, so it keeps one column
    assert set(crops) == {"a", "b", "c"} and (crops["a"]["width"], crops["a"]["height"]) == (40, 30)
    assert (crops["b"]["width"], crops["b"]["height"]) == (1, 7)
    assert (crops["c"]["width"], crops["c"]["height"]) == (3, 3)
    assert bytes(crops["c"]["pixels"][:3]) == bytes((7, 4, 3))  # blue, green, red at (3, 4)
    flat = im.crop_resize(pixels.where("image_id = 'b+c.PNG'"), boxes.withColumn("image_id", F.lit("b+c.PNG")).where("box_id = 'a'"), 16).first()
    assert bytes(flat["pixels"]) == bytes((0, 0, 255)) * 256


def test_read_labels(spark, folder):
    rows = labels.read_labels(spark, str(folder / "lab")).orderBy("stem", "box_ord").collect()
    assert [(r["stem"], r["box_ord"], r["cls"]) for r in rows] == [("1 (10)", 0, 0), ("1 (10)", 1, 1), ("b+c", 0, 3)]
    names = spark.createDataFrame([("1 (10).png",), ("1 (10).jpg",), ("none.jpg",)], "image_id string")
    assert labels.for_images(names, labels.read_labels(spark, str(folder / "lab"))).count() == 4
    assert {r["stem"] for r in labels.label_files(spark, str(folder / "lab")).collect()} == {"1 (10)", "b+c", "empty"}


def test_bad_words(spark, tmp_path):
    put(tmp_path, **{"a.txt": "0 .5 .5 .1 .1\n0 x .5 .1 .1\n", "b.txt": "1 .5 .5 .1 .1\n"})
    stems = lambda mode: sorted(r["stem"] for r in labels.read_labels(spark, str(tmp_path), mode).collect())
    assert stems("drop_row") == ["a", "b"] and stems("drop_file") == ["b"]
    with pytest.raises(PySparkException):
        stems("strict")


def test_write_labels(spark, tmp_path):
    rows = [("a", 0, 1, 0.5, 0.5, 0.2, 0.2), ("a", 1, 0, 0.98, 0.5, 0.2, 0.2), ("a", 2, 0, 1.5, 0.5, 0.2, 0.2)]
    boxes = spark.createDataFrame(rows, labels_schema())
    stems = spark.createDataFrame([("a",), ("none",)], "stem string")
    out = str(tmp_path / "out")
    exports.write_labels(stems, boxes, out)
    text = next((tmp_path / "out" / "stem=a").glob("*.txt")).read_bytes()
    assert text == b"1 0.500000 0.500000 0.200000 0.200000\n0 0.940000 0.500000 0.120000 0.200000\n"
    assert next((tmp_path / "out" / "stem=none").glob("*.txt")).read_bytes() == b"\n"
    back = labels.read_labels(spark, out)
    assert {(r["stem"], r["box_ord"]) for r in back.collect()} == {("a", 0), ("a", 1)}
    # writing one image again leaves the others as they are
    exports.write_labels(stems.where("stem = 'none'"), boxes.withColumn("stem", F.lit("none")), out)
    assert labels.read_labels(spark, out).count() == 4


def labels_schema():
    return "stem string, box_ord int, cls int, cx double, cy double, w double, h double"


def test_overlay_document(spark, tmp_path):
    record = {"box_id": "a:0", "box_xyxy": [1, 2, 3, 4], "det_conf": 0.5, "p_good": 0.25}
    put(tmp_path, **{"o.json": json.dumps({"a.jpg": [record, {**record, "box_id": "a:1", "label": 2}], "b.jpg": []}, indent=1)})
    rows = overlay.read_overlay(spark, str(tmp_path / "o.json")).orderBy("box_ord").collect()
    assert [(r["image_id"], r["box_id"], r["label"], r["x2"]) for r in rows] == [("a.jpg", "a:0", 0, 3.0), ("a.jpg", "a:1", 2, 3.0)]
    assert {r[0] for r in overlay.overlay_image_ids(spark, str(tmp_path / "o.json")).collect()} == {"a.jpg", "b.jpg"}


def test_ownership(spark, tmp_path, folder):
    names = spark.createDataFrame([("1 (10).png",), ("b+c.PNG",), ("new.png",)], "image_id string")
    files = labels.label_files(spark, str(folder / "lab"))
    owned = lambda path: sorted(r[0] for r in labels.read_ownership(spark, str(path), names, files).collect())
    put(tmp_path, **{"h.json": json.dumps(["new.png", "gone.png"]), "bad.json": "{oops"})
    assert owned(tmp_path / "h.json") == ["new.png"]
    assert owned(tmp_path / "missing.json") == owned(tmp_path / "bad.json") == ["1 (10).png", "b+c.PNG"]


def test_classes(spark, tmp_path):
    put(tmp_path, **{"c.json": json.dumps({"images": "/d", "classes": ["cat", "dog", " "]}), "l.json": json.dumps(["cat", "cow"])})
    where, saved = labels.read_classes(spark, str(tmp_path / "c.json"))
    assert (where, saved) == ("/d", ["cat", "dog", " "])
    assert status.adopt_saved_classes(["cat"], saved, where, "/d") == ["cat", "dog"]
    assert status.adopt_saved_classes(["cat"], saved, where, "/other") == ["cat"]
    assert status.adopt_saved_classes(["dog"], saved, where, "/d") == ["dog"]
    where, saved = labels.read_classes(spark, str(tmp_path / "l.json"))
    assert where is None and status.adopt_saved_classes(["cat"], saved, where, "/x") == ["cat", "cow"]
    assert labels.read_classes(spark, str(tmp_path / "none.json")) == (None, [])
    table = spark.createDataFrame([(0, "cat")], "cls int, name string")
    assert [r["name"] for r in status.add_class(table, " a,b ").orderBy("cls").collect()] == ["cat", "a b"]
    for bad in ("", " , ", "cat"):
        with pytest.raises(ValueError):
            status.add_class(table, bad)


def test_yaml_names(spark):
    rows = [
        ("a", "path: .\ntrain: images/train\nnames:\n  0: car\n  2: 'van'\n  1: bus\nnc: 3\n"),
        ("b", "names: [\"x\", y ,'z']\n"),
        ("c", "nc: 2\n"),
        ("d", "names:\n\n  0: one\nother: 1\n  1: not a name\n"),
    ]
    names = catalog.class_names(spark.createDataFrame(rows, "path string, text string"))
    got = {}
    for r in names.orderBy("path", "cls").collect():
        got.setdefault(r["path"], []).append(r["name"])
    assert got == {"a": ["car", "bus", "van"], "b": ["x", "y", "z"], "d": ["one"]}
    counted = catalog.class_names(spark.createDataFrame(rows, "path string, text string"), use_count=True)
    assert sorted(r["name"] for r in counted.where("path = 'c'").collect()) == ["0", "1"]
    assert counted.count() == names.count() + 2


def test_catalog_and_presets(spark):
    paths = [f"/d/zoo/images/train/{i}.jpg" for i in range(4)] + [f"/d/zoo/images/val/{i}.jpg" for i in range(2)]
    paths += ["/d/zoo/labels/train/0.txt", "/d/Zoo_/x.txt", "/d/pack/sub set/images/0.png", "/d/bare/labels/0.txt"]
    paths += ["/d/ZOO/images/train/0.jpg", "/d/nested/nested.yaml", "/d/nested/images/test/0.webp"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    yamls = spark.createDataFrame(
        [("/d/zoo/zoo.yaml", "train: images/train\nnames: [a, b]\n"), ("/d/nested/nested.yaml", "path: nested\nval: images/val\n")],
        "path string, text string",
    )
    rows = catalog.dataset_catalog(files, yamls, "/d").collect()
    assert [(r["key"], r["root"], r["n_images"]) for r in rows] == [
        ("zoo", "/d/zoo", 6), ("sub-set", "/d/pack/sub set", 3), ("nested", "/d/nested", 1)
    ]
    assert rows[0]["yaml"] == "/d/zoo/zoo.yaml" and rows[2]["yaml"] == "/d/nested/nested.yaml"
    assert [r["key"] for r in catalog.dataset_catalog(files, yamls, "/d", ["Sub_Set"]).collect()] == ["sub-set"]
    preset = catalog.dataset_presets(files, yamls, "/d").collect()
    assert [tuple(r) for r in preset] == [("zoo", "a,b", 2, 4, 2)]


def test_coco(spark):
    names = spark.createDataFrame([("b.jpg", 100, 50), ("a.jpg", 10, 10), ("c.jpg", 10, 10)], "image_id string, width int, height int")
    numbered = exports.coco_images(names)
    assert {r["file_name"]: r["id"] for r in numbered.collect()} == {"a.jpg": 1, "b.jpg": 2, "c.jpg": 3}
    boxes = spark.createDataFrame(
        [("b.jpg", 0, 1, 0.9, 0.5, 0.4, 0.2), ("b.jpg", 1, 0, 1.5, 0.5, 0.1, 0.1), ("a.jpg", 0, 0, 0.5, 0.5, 1.0, 1.0)],
        "image_id string, box_ord int, cls int, cx double, cy double, w double, h double",
    )
    rows = exports.coco_annotations(numbered, boxes).orderBy("id").collect()
    assert [(r["id"], r["image_id"], r["category_id"]) for r in rows] == [(1, 1, 1), (2, 2, 2)]
    assert rows[1]["bbox"] == pytest.approx([70.0, 20.0, 30.0, 10.0]) and rows[1]["area"] == pytest.approx(300.0)


def test_cvat_escapes(spark, tmp_path):
    names = spark.createDataFrame([("a", "x<&>.jpg", 10, 10), ("b", "y.jpg", 10, 10)], "image_id string, ref string, width int, height int")
    accepted = spark.createDataFrame(
        [("a", 0, 1.0, 2.0, 3.456, 4.0, 0.7, "a:0", "cat & dog")],
        "image_id string, box_ord long, x1 double, y1 double, x2 double, y2 double, score double, box_id string, class_name string",
    )
    exports.write_cvat(names, accepted, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*")))
    assert "x&lt;&amp;&gt;.jpg" in text or "x&lt;&amp;>.jpg" in text
    assert 'label="cat &amp; dog"' in text and 'xbr="3.46"' in text and "0.7000" in text and "green" in text
    assert text.count("<image ") == 2


def test_events(spark, tmp_path):
    line = {"ts_ms": 5, "session_id": "s", "event_type": "hover", "image_id": "i", "box_id": None, "payload": {"dwell_ms": 12}}
    put(tmp_path, **{"e.jsonl": json.dumps(line) + "\n\n" + json.dumps({**line, "event_type": "nonsense"}) + "\n"})
    from annospark.streaming import events as ev

    rows = overlay.read_events(spark, str(tmp_path / "e.jsonl"))
    assert ev.valid(rows).count() == ev.quarantined(rows).count() == 1
    assert ev.dwell_by_image(rows).first()["dwell_ms"] == 12


def test_lines_are_counted_without_being_parsed(spark):
    """The count of lines per file, which finds large files, does not read the lines; a line is split once."""
    from annospark.sources import labels as lb

    fail = F.udf(lambda line: 1 / 0, "string")
    lines = spark.range(10).select(F.lit("a").alias("stem"), F.col("id").alias("line_no"), fail(F.lit("0 1 1 1 1")).alias("line"))
    rows = lb.parse_lines(lines, "drop_row")  # a count that parses would fail here
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_cvat_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "CVAT_IMAGES", 3, raising=False)
    images = spark.range(20).select("id", F.col("id").cast("string").alias("image_id")).withColumns({"ref": F.col("image_id"), "width": F.lit(9), "height": F.lit(9)})
    boxes = images.limit(1).select("image_id", F.lit(0).cast("long").alias("box_ord"), *[F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (1, 1, 3, 3))], F.lit("cat").alias("class_name"), F.lit(0.5).alias("score"))
    exports.write_cvat(images, boxes, str(tmp_path / "c"))
    counts = [p.read_text().count("<image ") for p in (tmp_path / "c").glob("part-*")]
    assert sum(counts) == 20 and max(counts) <= 3
