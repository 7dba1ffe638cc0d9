"""Steps that read one table by image several times deal it out once."""

import glob
import gzip
import json

from pyspark.sql import functions as F

from annospark import fixtures as fx
from annospark.operators import overlap, status
from annospark.session import cut_by
from annospark.sinks import documents
from annospark.streaming import events as ev

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(")


def test_small_images_in_buckets_are_folded_without_a_shuffle(spark, make_boxes):
    rows = [(i, 0, i + 9, 9, 0.9 - i / 100, 0, f"img{j}") for j in range(30) for i in range(6)] + [(2, 2, 4, 4, 0.1)]
    boxes = make_boxes(rows)
    dealt = cut_by(boxes, "image_id")
    for contain in (True, False):
        kept = overlap.nms(dealt, contain, None)
        assert shuffles(kept) == 0
        assert sorted(kept.collect()) == sorted(overlap.nms(boxes, contain).collect())
    assert shuffles(overlap.drop_contained(dealt, hot_limit=None)) == 0
    assert shuffles(overlap.cut(dealt, None).groupBy("image_id").count()) == 0


def test_candidates_are_dealt_once_and_repeats_count_once(spark):
    lines = fx.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    once = fx.derive_candidates(lines, None)
    assert shuffles(once) == 1
    hot = lines.groupBy("l_orderkey").count().where("count > 5").select("l_orderkey")
    twice = fx.derive_candidates(lines.unionByName(lines), hot)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert shuffles(fx.candidates(spark, SF).groupBy("image_id").agg(F.count("*"))) == 0


def test_boxes_are_not_dealt_by_class(spark, make_boxes):
    classes = spark.createDataFrame([(0, "cat")], "cls int, name string")
    named = status.with_class_name(make_boxes([(0, 0, 1, 1), (0, 0, 1, 1, 0.5, 7)]), classes)
    assert shuffles(named) == 0 and sorted(r["class_name"] for r in named.collect()) == ["7", "cat"]


def test_label_studio_document_in_gzip(spark, tmp_path):
    images = spark.createDataFrame([(f"{n}.jpg", f"i/{n}", 100, 50) for n in "abc"], "image_id string, ref string, width int, height int")
    rows = [(f"{n}.jpg", i, 1.0, 2.0, 20.0, 30.0, "cat", 0.5, None if n == "b" and i == 0 else f"{n}:{i}") for n in "ab" for i in range(3)]
    boxes = spark.createDataFrame(rows, "image_id string, box_ord long, x1 double, y1 double, x2 double, y2 double, class_name string, score double, box_id string")
    documents.write_label_studio_document(images, boxes, str(tmp_path / "l"), compression="gzip")
    whole = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{tmp_path}/l/part-*.gz")))  # as cat does
    tasks = json.loads(gzip.decompress(whole))
    assert [[r["meta"]["pg_box_id"] for r in t["predictions"][0]["result"]] for t in tasks] == [["a:0", "a:1", "a:2"], ["b:1", "b:2"], []]


def test_state_of_boxes_is_kept_by_group(spark, tmp_path, monkeypatch):
    """Boxes of a group end at different times and one is touched again; each is given out once, with its own last action."""
    monkeypatch.setattr(ev, "OUTCOME_GROUPS", 3)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, out, held = spark.conf.get(provider), str(tmp_path / "out"), []
    (tmp_path / "in").mkdir()
    ev.keyed_state(spark)
    try:
        for name, rows in enumerate([[(i % 20, f"b{i}") for i in range(40)], [(15, "b0"), (45, "x")], [(200, "y")]]):
            lines = [json.dumps({"ts_ms": (t + 100) * 60_000, "session_id": "s", "event_type": "box_accept", "image_id": "i", "box_id": b}) for t, b in rows]
            (tmp_path / "in" / str(name)).write_text("\n".join(lines) + "\n")
            stream = ev.stream_last_outcome(ev.stream_events(spark, str(tmp_path / "in")))
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
            held.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
            got = {r["box_id"]: (r["last_ms"] // 60_000 - 100, r["actions"]) for r in spark.read.parquet(out).collect()}
            assert len(got) == spark.read.parquet(out).count()
            if name == 1:  # 35 minutes are over: boxes touched last in the first five, but for the one that was touched again
                assert got == {f"b{i}": (i % 20, 1) for i in range(40) if i % 20 <= 5 and i}
    finally:
        spark.conf.set(provider, before)
    assert got == {f"b{i}": (i % 20, 1) for i in range(1, 40)} | {"b0": (15, 2), "x": (45, 1)}
    assert max(held) <= 3 and held[-1] == 1
