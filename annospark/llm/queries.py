"""The queries of this package over the given tables: thin steps around the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annospark.llm import decontaminate, exact_dedup, language_model, line_dedup, mixing, near_dedup, page_text, secret_scan, session_tree, sharding, token_counts, toxicity, whitening
from annospark.llm.tables import text_of
from annospark.operators.order_stats import running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as label files."""
    return docs.select(F.col("doc_id").alias("stem"), "text")


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(as_files(docs), items)
    return found.select(F.col("stem").alias("doc_id"), "item_id", "coverage", "n_windows", "consistency", "verbatim")


def op2_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents"))
    kept = line_dedup.LineIndex.of(files, min_files=10, min_chars=1).drop_common(files)
    return kept.select(F.col("stem").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(as_files(table(spark, sf_dir, "documents")), n_shards=16)
    return placed.withColumnRenamed("stem", "doc_id")


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("stem"), "text", F.col("source").alias("dataset"))
    mixed = mixing.mix_datasets(files, repeating_weights(files, (5, 2, 1)), passes=3)
    return mixed.select(F.col("stem").alias("doc_id"), "size", "source_size", "target", "taken")


def repeating_weights(files: DataFrame, weights, dataset: str = "dataset") -> dict:
    """Weights that repeat over the datasets in code point order, null last."""
    names = [r[0] for r in files.select(dataset).distinct().limit(mixing.DATASETS + 1).collect()]
    if len(names) > mixing.DATASETS:
        raise ValueError(f"more than {mixing.DATASETS} datasets in one mix")
    names.sort(key=lambda n: (n is None, n or ""))
    return {n: weights[i % len(weights)] for i, n in enumerate(names)}


def held_out(doc_id: str = "doc_id"):
    """Whether a document's labels are kept from every fit."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def toxic_grammar(spark: SparkSession, sf_dir: str, docs: DataFrame):
    labels = table(spark, sf_dir, "labels").where(~held_out()).select(F.col("doc_id").alias("stem"), "toxic")
    return toxicity.fit_grammar(as_files(docs), labels)


def op5_toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_files(as_files(docs), toxic_grammar(spark, sf_dir, docs), cut=0.7)
    return scored.select(F.col("stem").alias("doc_id"), held_out("stem").alias("held_out"), "score", "predicted")


def op6_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_copies(as_files(table(spark, sf_dir, "documents")))
    return found.withColumnsRenamed({"stem": "doc_id", "keep_stem": "keep_id"})


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op8_piece_counts(spark: SparkSession, sf_dir: str, vocabulary: str = PIECES) -> DataFrame:
    pieces = token_counts.read_pieces(vocabulary)
    return token_counts.count_tokens(as_files(table(spark, sf_dir, "documents")), pieces).withColumnRenamed("stem", "doc_id")


def op9_novel_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(secret_scan.scan_secrets(as_files(table(spark, sf_dir, "documents"))))


def secret_columns(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that a scan reports."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        F.col("stem").alias("doc_id"),
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(written(base), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = near_dedup.Likeness(words=3, percent=85)
    found = near_dedup.near_copies(as_files(table(spark, sf_dir, "documents")), rule)
    return found.withColumnsRenamed({"stem": "doc_id", "component_stem": "component_id"})


def lm_held_out(doc_id: str = "doc_id"):
    """Whether the language model learns nothing from a document."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op11_label_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.fit_model(as_files(docs.where(~lm_held_out())))
    scored = language_model.score_files(as_files(docs), model)
    return scored.select(F.col("stem").alias("doc_id"), lm_held_out("stem").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def rebuilt_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events of sessions: each conversation behind the first turns of the one its number is rounded down to.

    How many are taken over, and how many own turns they replace, is the CRC-32 of the number modulo 9.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    turns = running(turns, ["turn", "role", "text"], {"at": F.lit(1).cast("long")}, ["conv_id"])
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = turns.where(F.col("at") > borrowed).withColumn("part", F.lit(1))
    base = turns.where("at <= 8").withColumnRenamed("conv_id", "base")  # no more than 8 are ever borrowed
    convs = turns.select("conv_id").distinct().withColumns({"base": F.expr("conv_id - conv_id % 5"), "h": borrowed})
    front = convs.join(base, "base").where("at <= h").drop("base", "h").withColumn("part", F.lit(0))
    return front.unionByName(own.select(front.columns)).select(
        F.col("conv_id").alias("session_id"), (F.col("part") * F.lit(1 << 40) + F.col("at")).alias("ts_ms"), F.col("role").alias("event_type"), F.col("text").alias("payload")
    )


def op12_shared_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    tree = session_tree.session_tree(rebuilt_conversations(spark, sf_dir), sessions)
    full = tree.nodes.join(session_tree.end_digests(tree.ends), ["session_id", "depth"], "left")
    return full.select(
        F.col("session_id").alias("conv_id"),
        "depth",
        F.col("parent_session_id").alias("parent_conv_id"),
        F.col("n_sessions").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_white_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    crops = vectors.select(F.lit(None).cast("string").alias("image_id"), F.col("vec_id").alias("box_id"), F.col("embedding").alias("features"))
    return whitening.whiten_features(crops, components=16).drop("image_id").withColumnRenamed("box_id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_template_leaks,
        op2_common_lines,
        op3_histogram_shards,
        op4_fair_mix,
        op5_toxic_clauses,
        op6_page_wrappers,
        op7_exact_copies,
        op8_piece_counts,
        op9_novel_secrets,
        op10_near_copies,
        op11_label_language,
        op12_shared_beginnings,
        op13_white_features,
    )
}

BLANK = r"[\x20\x09-\x0D]+"

ORACLES = {
    "op2_common_lines": """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM p),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_shared_beginnings": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295,
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda x, y:
    list_reduce(list_prepend(xor(x, y), CAST(range(8) AS BIGINT[])), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)),
    4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
f AS (SELECT c.conv_id, 0 AS part, t.pos, {'r': t.role, 't': t.text} AS step FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT t.conv_id, 1, t.pos, {'r': t.role, 't': t.text} FROM t JOIN c ON t.conv_id = c.conv_id AND t.pos > c.h),
s AS (SELECT c.conv_id, coalesce(list(step ORDER BY part, pos) FILTER (WHERE step IS NOT NULL), []) AS steps FROM c LEFT JOIN f ON c.conv_id = f.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(steps) AS n, d, steps[1:d] AS pre FROM (SELECT *, unnest(range(len(steps) + 1)) AS d FROM s)),
g AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(pre[d].t)), 0) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY pre, d),
k AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
o AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON g.pre = k.pre),
b AS (SELECT pre[1:up] AS pre, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
    FROM (SELECT *, unnest(range(d + 1)) AS up FROM o) GROUP BY 1)
SELECT o.conv_id, o.d AS depth, above.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved_tokens, o.ends_sha256
FROM o JOIN b ON o.pre = b.pre LEFT JOIN g above ON o.d > 0 AND above.pre = o.pre[1:o.d - 1]""",
    "op7_exact_copies": rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g') AS body FROM documents),
w AS (SELECT body, count(*) AS group_size, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id FROM n GROUP BY body)
SELECT n.doc_id, w.keep_id, w.group_size, n.doc_id = w.keep_id AS kept, sha256(n.body) AS text_sha256 FROM n JOIN w USING (body)""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
