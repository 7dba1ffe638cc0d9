"""Documents in ordered parts, put together and read with ordinary parsers."""

import glob
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from annospark.sinks import documents as doc, exports
from annospark.sources import overlay


def joined(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture
def tables(spark):
    images = spark.createDataFrame([(n, f"i/{n}", 100, 50) for n in ("b&<.jpg", 'a".jpg', "none.jpg", "ü.jpg")], "image_id string, ref string, width int, height int")
    rows = [(n, i, 1.0 + i, 2.0, 20.0 + i, 30.0, "cat" if i % 2 else "d<o>g", 0.2 + 0.1 * i) for n in ("b&<.jpg", 'a".jpg', "ü.jpg") for i in range(5)]
    boxes = spark.createDataFrame(rows, "image_id string, box_ord long, x1 double, y1 double, x2 double, y2 double, class_name string, score double")
    return images, boxes.withColumn("box_id", F.concat_ws(":", "image_id", "box_ord"))


def test_coco_document(spark, tables, tmp_path):
    images, boxes = tables
    scaled = boxes.select("image_id", "box_ord", F.lit(2).alias("cls"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.2).alias("w"), F.lit(0.2).alias("h"))
    classes = spark.createDataFrame([(2, "cat"), (5, "dog")], "cls int, name string")
    doc.write_coco_document(images, scaled, classes, str(tmp_path / "c"))
    got = json.loads(joined(tmp_path / "c"))
    assert [i["file_name"] for i in got["images"]] == ['a".jpg', "b&<.jpg", "none.jpg", "ü.jpg"] and [i["id"] for i in got["images"]] == [1, 2, 3, 4]
    assert [a["id"] for a in got["annotations"]] == list(range(1, 16)) and got["categories"] == [{"id": 3, "name": "cat"}, {"id": 6, "name": "dog"}]


def test_cvat_document(spark, tables, tmp_path):
    doc.write_cvat_document(*tables, str(tmp_path / "x"))
    root = ET.fromstring(joined(tmp_path / "x").encode())
    assert root.find("version").text == "1.1" and [i.get("id") for i in root.iter("image")] == ["0", "1", "2", "3"]
    assert [len(i) for i in root.iter("image")] == [5, 5, 0, 5] and root.find("image").get("name") == 'i/a".jpg'
    box = root.find("image").find("box")
    assert box.get("label") == "d<o>g" and box.get("xtl") == "1.00" and {a.get("name"): a.text for a in box} == {"pg_score": "0.2000", "pg_band": "red"}


def test_label_studio_document(spark, tables, tmp_path):
    doc.write_label_studio_document(*tables, str(tmp_path / "l"))
    tasks = json.loads(joined(tmp_path / "l"))
    assert [len(t["predictions"][0]["result"]) for t in tasks] == [5, 5, 0, 5]
    rows = exports.label_studio_tasks(exports.label_studio_regions(*tables)).toJSON().collect()
    assert sorted(map(json.dumps, tasks)) == sorted(json.dumps(json.loads(r)) for r in rows)


def test_overlay_document(spark, tables, tmp_path):
    images, boxes = tables
    full = boxes.withColumns({"label": F.lit(1), "det_conf": F.col("score"), "p_good": F.col("score")})
    doc.write_overlay_document(images, full, str(tmp_path / "o"))
    text = joined(tmp_path / "o")
    assert {k: len(v) for k, v in json.loads(text).items()} == {'a".jpg': 5, "b&<.jpg": 5, "none.jpg": 0, "ü.jpg": 5}
    (tmp_path / "whole.json").write_text(text, encoding="utf-8")
    back = overlay.read_overlay(spark, str(tmp_path / "whole.json"))
    key = lambda df: sorted(tuple(r) for r in df.select("image_id", "box_ord", "x1", "y2", "p_good").collect())
    assert key(back) == key(full)


@pytest.mark.parametrize("length", [2, 7, 1 << 20])
def test_keys_of_a_document_read_in_ranges(spark, tmp_path, monkeypatch, length):
    """Ranges may begin in a text, behind a backslash or inside a list; keys below the top are none."""
    from annospark.sources import json_ranges as jr

    names = ['a"', "\\", "\\\\", "x{[", "ü", "", "a" * 70 + "\\" * 67, "}]:"]
    whole = {n: [{"box_id": n + '":[{', "label": i, "at": [1, 2]}, {"in": {"deep": []}}] if i % 2 else [] for i, n in enumerate(names)}
    monkeypatch.setattr(jr, "JSON_RANGE", length)
    paths = [tmp_path / f"{i}.json" for i in range(3)]
    for path, indent, ascii_ in zip(paths, (None, 1, 3), (True, False, True)):
        path.write_text(json.dumps(whole, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    for path in paths if length > 3 else paths[:1]:
        rows = overlay.overlay_image_ids(spark, str(path)).collect()
        assert sorted(r["image_id"] for r in rows) == sorted(names)
    paths[2].write_text(json.dumps(whole)[:-1])
    assert overlay.overlay_image_ids(spark, str(paths[2])).count() == 0


def test_ids_of_an_overlay_document_in_parts(spark, tables, tmp_path, monkeypatch):
    from annospark.sources import json_ranges as jr

    images, boxes = tables
    boxes = boxes.select("image_id", "box_ord", "box_id", "x1", "y1", "x2", "y2", F.lit(1).alias("label"), "score", F.col("score").alias("det_conf"), F.col("score").alias("p_good"))
    doc.write_overlay_document(images, boxes, str(tmp_path / "o"))
    monkeypatch.setattr(jr, "JSON_RANGE", 50)
    found = overlay.overlay_image_ids(spark, str(tmp_path / "o"), parts=True).collect()
    assert sorted(r["image_id"] for r in found) == sorted(r["image_id"] for r in images.collect())
