"""Keyed state with timers: one row per box, state that ends."""

import json

import pytest

from annospark.sources.overlay import read_events
from annospark.streaming import events as ev

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def keyed(spark):
    before = spark.conf.get(PROVIDER)
    ev.keyed_state(spark)
    yield
    spark.conf.set(PROVIDER, before)


def test_boxes_are_given_out_once_and_forgotten(spark, tmp_path, keyed):
    def put(name, rows):
        lines = [json.dumps({"ts_ms": t * 60_000, "session_id": s, "event_type": e, "image_id": "i", "box_id": b}) for t, s, e, b in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    (tmp_path / "in").mkdir()
    out, progress = str(tmp_path / "out"), []

    def run():
        stream = ev.stream_last_outcome(ev.stream_events(spark, str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append([p.stateOperators[0].numRowsTotal for p in query.recentProgress][-1])
        return sorted((r["session_id"], r["box_id"], r["outcome"], r["last_ms"] // 60_000, r["actions"]) for r in spark.read.parquet(out).collect())

    put("1", [(1, "s", "box_accept", "a"), (3, "s", "box_reject", "a"), (2, "s", "box_adjust", "a"), (5, "s", "hover", "a"), (4, "t", "box_add", "b")])
    assert run() == []  # nobody knows yet whether they are done
    put("2", [(20, "s", "box_accept", "c"), (21, "s", "class_change", "c")])
    assert run() == []
    put("3", [(100, "u", "box_delete", "d")])
    done = [("s", "a", "box_reject", 3, 3), ("s", "c", "class_change", 21, 2), ("t", "b", "box_add", 4, 1)]
    assert run() == done and progress[-1] < progress[-2]
    put("4", [(500, "u", "undo", None), (600, "v", "box_add", "e"), (101, "late", "box_add", "f")])
    assert run() == sorted([*done, ("u", "d", "box_delete", 100, 1), ("late", "f", "box_add", 101, 1)])
    batch = ev.box_outcome(read_events(spark, str(tmp_path / "in"))).where("box_id <> 'e'")
    again = ev.combine_outcomes(spark.read.parquet(out))
    assert sorted(map(tuple, batch.select(*again.columns).collect())) == sorted(map(tuple, again.collect()))
    assert progress[0] == 2 and progress[-1] == 1  # the box that is still open
