"""The text operators on the library's own records: a folder of label files, as its reader gives them."""

import pytest
from pyspark.sql import functions as F

from annospark.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, secret_scan, sharding, token_counts, toxicity
from annospark.sources.labels import read_label_texts

COMMON = "0 0.500000 0.500000 0.100000 0.100000"


def boxes(seed, n):
    return [f"{(seed + i) % 5} 0.{(seed * 37 + i * 11) % 89 + 10} 0.{(seed * 53 + i * 29) % 89 + 10} 0.{(i * 7) % 40 + 10} 0.{(i * 13) % 40 + 10}" for i in range(n)]


FILES = {f"img{k:02}": "\n".join([COMMON, *boxes(k, 8)]) + "\n" for k in range(14)}
FILES |= {"copy": FILES["img03"].replace(" ", "  "), "near": FILES["img05"] + "4 0.99 0.99 0.01 0.01\n", "empty": ""}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    for stem, text in FILES.items():
        (folder / f"{stem}.txt").write_text(text)
    return read_label_texts(spark, str(folder)).persist()


def test_copies_and_lines(files):
    kept = {r["stem"]: r["keep_stem"] for r in exact_dedup.exact_copies(files).collect()}
    assert kept["img03"] == kept["copy"] == "copy" and kept["empty"] == "empty" and len(kept) == len(FILES)
    near = {r["stem"]: r["component_stem"] for r in near_dedup.near_copies(files, near_dedup.Likeness(words=3, percent=80)).collect()}
    assert near["near"] == near["img05"] == "img05" and near["copy"] == near["img03"] == "copy" and near["img01"] == "img01"
    lines = {r["stem"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.LineIndex.of(files, min_files=10, min_chars=1).drop_common(files).collect()}
    assert lines["img00"] == (10, 1) and lines["empty"] == (1, 0)


def test_sizes(files):
    placed = sharding.histogram_shards(files, n_shards=4).collect()
    assert len(placed) == len(FILES) and {r["size"] for r in placed if r["stem"] == "empty"} == {1}
    named = files.withColumn("dataset", F.when(F.col("stem") < "img07", "a").otherwise("b"))
    mixed = {r["stem"]: r for r in mixing.mix_datasets(named, {"a": 1, "b": 1}, passes=3).collect()}
    assert mixed["img00"]["size"] == 45 and mixed["empty"]["taken"] == 0
    counted = {r["stem"]: r["n_words"] for r in token_counts.count_tokens(files, ["▁0", ".", "1"]).collect()}
    assert counted["img00"] == 45 and counted["empty"] == 0


def test_contents(spark, files):
    items = spark.createDataFrame([(1, "\n".join(boxes(2, 8)))], "item_id long, text string")
    assert {r["stem"] for r in decontaminate.contaminated(files, items).collect()} >= {"img02"}
    assert all(r["spans"] == [] for r in secret_scan.scan_secrets(files).collect())
    labels = spark.createDataFrame([("img00", 0), ("img01", 0)], "stem string, toxic int")
    scored = toxicity.score_files(files, toxicity.fit_grammar(files, labels), cut=0.7).collect()
    assert len(scored) == len(FILES) and all(r["predicted"] == 0 for r in scored)
