"""Work per box before an image is gathered: counts by group, repeats found by the numbering sort, elements made by a projection."""

from annospark import fixtures as fx
from annospark.operators import hot_images
from annospark.operators.order_stats import numbered_once
from annospark.sinks import exports

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_crowded_counts_groups_before_keys(spark):
    rows = spark.createDataFrame([(k,) for k in [1] * 5 + [2] * 6 + [None] * 7 + list(range(10, 60))], "k long")
    for groups in (1, 3, 65_536):  # with one group every key is counted
        found = hot_images.crowded(rows, 5, "k", groups)
        assert sorted(str(r["k"]) for r in found.collect()) == ["2", "None"]
        assert hot_images.crowded(rows, 7, "k", groups) is None
    assert hot_images.crowded(rows.where("k >= 10"), 49, "k", 1) is None  # a full group without a crowded key


def test_repeats_are_found_by_the_numbering_sort(spark):
    rows = spark.createDataFrame([(1, 5, 2), (1, 5, 2), (1, 4, 9), (1, None, 1), (1, None, 1), (None, 3, 3), (None, 3, 3), (2, 0, 0)], "k long, a long, b long")
    hot = spark.createDataFrame([(1,), (None,)], "k long")
    want = {(1, None, 1, 0), (1, 4, 9, 1), (1, 5, 2, 2), (None, 3, 3, 0), (2, 0, 0, 0)}
    for large in (None, hot):
        got = [tuple(r) for r in numbered_once(rows, ["a", "b"], "no", large, "k").select("k", "a", "b", "no").collect()]
        assert len(got) == len(want) and set(got) == want
    lines = fx.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    assert "Aggregate" not in plan(fx.derive_candidates(lines, None))


def test_regions_are_made_before_they_are_gathered(spark):
    images = spark.createDataFrame([(n, f"i/{n}", 200, 50) for n in "abc"], "image_id string, ref string, width int, height int")
    rows = [(n, i, 2.0 * i, 2.0, 20.0, 30.0, None if i == 2 else "cat", 0.2 * i, None if (n, i) == ("b", 0) else f"{n}:{i}") for n in "ab" for i in (3, 0, 2, 1)]
    boxes = spark.createDataFrame(rows, "image_id string, box_ord long, x1 double, y1 double, x2 double, y2 double, class_name string, score double, box_id string")
    tasks = exports.label_studio_tasks(exports.label_studio_regions(images, boxes), "m")
    gathered = [line for line in plan(tasks).splitlines() if "collect_list" in line]
    assert gathered and not any("struct(from_name" in line.split("collect_list")[1] or "lambda" in line for line in gathered)
    got = {r["data"]["pg_image_id"]: r["predictions"][0] for r in tasks.collect()}
    assert {k: [x["meta"]["pg_box_id"] for x in p["result"]] for k, p in got.items()} == {"a": ["a:0", "a:1", "a:2", "a:3"], "b": ["b:1", "b:2", "b:3"], "c": []}
    third = got["a"]["result"][3].asDict(recursive=True)
    assert third == {
        "from_name": "label", "to_name": "image", "type": "rectanglelabels", "original_width": 200, "original_height": 50, "image_rotation": 0,
        "value": {"x": 3.0, "y": 4.0, "width": 7.0, "height": 56.0, "rotation": 0, "rectanglelabels": ["cat"]},
        "meta": {"pg_box_id": "a:3", "pg_score": 0.2 * 3, "pg_band": "amber"},
    }
    assert got["a"]["result"][2]["value"]["rectanglelabels"] == [None] and got["c"]["model_version"] == "m"
