"""Mixing and sharding against plain Python, and the pipeline on awkward documents."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annospark.llm.mixing import fair_targets, mix_datasets
from annospark.llm.queries import repeating_weights
from annospark.llm.sharding import histogram_shards
from tests.llm import edge


def test_targets_reshare_what_full_datasets_leave():
    assert fair_targets({"a": 10, "b": 100}, {"a": 5, "b": 1}, 110, 3) == {"a": 30.0, "b": 80.0}
    assert fair_targets({"a": 10, "b": 20, "c": 0}, {"a": 1, "b": 1}, 30, 3) == {"a": 15.0, "b": 15.0, "c": 0.0}
    assert fair_targets({}, {}, 0, 3) == {}


@pytest.fixture
def sources(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), "big" if i % 3 == 0 else [None, "a", "b", "c"][i % 4]) for i in range(900)]
    return spark.createDataFrame(rows, "stem long, text string, dataset string")


def test_mix_comes_near_its_targets(spark, sources):
    weights = repeating_weights(sources, (5, 2, 1))
    assert list(weights.items()) == [("a", 5), ("b", 2), ("big", 1), ("c", 5), (None, 2)]
    got = mix_datasets(sources, weights).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["dataset"]] += r["size"]
        taken[r["dataset"]] += r["taken"]
        target[r["dataset"]] = r["target"]
        assert r["taken"] in [k * r["size"] for k in range(4)]
    want = fair_targets(size, weights, sum(size.values()), 3)
    assert all(abs(target[k] - want[k]) < 1e-6 and abs(taken[k] - want[k]) <= 40 for k in size)
    assert abs(sum(taken.values()) - sum(size.values())) <= 40
    again = mix_datasets(sources.repartition(3), weights)
    assert edge.collected(again) == sorted((tuple(r) for r in got), key=repr)


def test_mix_of_awkward_files(spark):
    df = edge.files(spark).withColumn("dataset", F.col("source"))
    got = mix_datasets(df, repeating_weights(df, (5, 2, 1)), size=F.length("text"))
    assert got.count() == len(edge.ROWS) and got.where("size = 0 AND taken > 0").count() == 0
    assert mix_datasets(df, {}).where("taken > 0").count() == 0
    assert mix_datasets(df.limit(0), {"src": 1}).count() == 0


def check_shards(rows, n):
    bytes_, slots = Counter(), defaultdict(list)
    for r in rows:
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return bytes_


def test_shards_are_nearly_equal_and_gapless(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(200)) for i in range(4000)]
    got = histogram_shards(edge.files(spark, rows), 8).collect()
    sizes = check_shards(got, 8)
    share = sum(sizes.values()) / 8
    assert all(abs(v - share) <= 0.004 * share + 400 for v in sizes.values())
    assert {(x["stem"], x["size"], x["text_crc32"]) for x in got} == {(i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows}
    assert {x["law"] for x in got} == {"bytes"} and {x["grown_shard"] for x in got} == {None}


def test_equal_texts_stay_together_unless_they_fill_a_shard(spark):
    rows = [(i, f"text {i % 400} " * 5) for i in range(4000)] + [(10_000 + i, "hot " * 20) for i in range(3000)]
    got = histogram_shards(edge.files(spark, rows), 8, tolerance=0.2).collect()
    sizes = check_shards(got, 8)
    assert max(sizes.values()) < 1.3 * sum(sizes.values()) / 8
    at = defaultdict(set)
    for x in got:
        at[x["text_crc32"]].add(x["shard"])
    assert sum(len(s) > 1 for s in at.values()) <= 2 and len(at[zlib.crc32(("hot " * 20).encode())]) > 2


def test_shards_of_awkward_files(spark):
    got = histogram_shards(edge.files(spark), 4).collect()
    check_shards(got, 4)
    assert len(got) == len(edge.ROWS) and {x["size"] for x in got if x["stem"] == 4} == {1}
    assert histogram_shards(edge.empty(spark), 4).count() == 0


@pytest.fixture
def tables(spark, tmp_path):
    """A scale folder with the tables the stages read."""
    docs = edge.files(spark, id_name="doc_id").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "stem": F.lit("clash")})
    docs = docs.withColumns({c: F.lit("clash") for c in "turn r_id r_text __id __text __turn __n __own __copy __row __ROW_said id times rows n".split()})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a question that no document has in it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_take_awkward_documents(spark, tables):
    sf_dir, docs = tables
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        extra = {"shard", "slot"} if name == "sharding" else set()
        assert set(got.columns) == set(docs.columns) | extra, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        n = got.count()
        assert n == {"toxicity": 15, "near_dedup": 10, "decontamination": 15, "sharding": 15}.get(name, n), name


def test_pipeline_decisions_take_effect(spark, tmp_path):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(60))
    rows = [(i, text(), "a" if i % 2 else "b") for i in range(60)]
    base = rows[0][1]
    rows += [(100, base + " extra", "a"), (101, base, "b"), (102, text() + " you stupid idiot, you moron. " + text(), "a")]
    item = "which of these numbers is the largest one when all of them are added up"
    rows += [(103, text() + " " + item + " " + text(), "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = {x["doc_id"] for x in docs.collect()}
    assert left["toxicity"] == set(range(60)) | {100, 101, 103}
    assert left["near_dedup"] == set(range(60)) | {103} and left["decontamination"] == set(range(60))
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in done} <= set(range(60))
    words, sizes = sum(len(x["text"].split()) for x in done), 60 * 60
    assert abs(words - sizes) <= 60
    slots = defaultdict(list)
    for x in done:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
