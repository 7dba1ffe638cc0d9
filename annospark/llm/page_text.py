"""Main text of web pages, by wrappers inferred for each host."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm import wrapper as wr
from annospark.llm.blocks import blocks_of
from annospark.llm.groups import hand_back
from annospark.llm.tables import partitions_of, text_of
from annospark.session import cut_lineage

HOSTS = 2_000  # hosts whose wrappers one task holds before it hands them on
SALTS = 16
SHIPPED = 32 << 20  # bytes of wrappers up to which they are sent to every task
WRAPPER = "host string, wrapper string, pages long"
STRINGS = pa.list_(pa.string())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shapes`` and ``texts`` of the blocks of every page, and ``page``, which tells pages with text apart."""
    for batch in batches:
        pages, shapes, texts = [], [], []
        for source in batch.column("html").to_pylist():
            blocks = blocks_of(source)
            pages.append(wr.key_of("", source) if blocks else None)
            shapes.append([wr.shape_of(path, role) for path, role, _ in blocks])
            texts.append([text for _, _, text in blocks])
        kept = [batch.column(c) for c in ("page_id", "url", "host")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(pages, pa.int64()), pa.array(shapes, STRINGS), pa.array(texts, STRINGS)], names=["page_id", "url", "host", "page", "shapes", "texts"]
        )


def _blocks(batch: pa.RecordBatch) -> Iterator[list[tuple[str, str]]]:
    for shapes, texts in zip(batch.column("shapes").to_pylist(), batch.column("texts").to_pylist()):
        yield list(zip(shapes, texts))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the pages that one task reads."""
    held: dict[str, tuple[list, int]] = {}
    for batch in batches:
        for host, blocks in zip(batch.column("host").to_pylist(), _blocks(batch)):
            own = wr.of_page(blocks)
            old, n = held.get(host, ([], 0))
            # a page without text says nothing of its host
            held[host] = (wr.aligned(old, own) if n else own, n + 1) if own else (old, n)
        if len(held) > HOSTS:
            yield _rows(held)
            held = {}
    yield _rows(held)


def _rows(held: dict) -> pa.RecordBatch:
    hosts = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts, pa.string()), pa.array([json.dumps(held[h][0]) for h in hosts], pa.string()), pa.array([held[h][1] for h in hosts], pa.int64())],
        names=["host", "wrapper", "pages"],
    )


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    texts = sorted(set(pdf["wrapper"][pdf["pages"] > 0])) or ["[]"]
    out = json.loads(texts[0])
    for t in texts[1:]:
        out = wr.aligned(out, json.loads(t))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(out)], "pages": [int(pdf["pages"].sum())]})


def infer_wrappers(parsed: DataFrame) -> DataFrame:
    """``host, wrapper, pages`` from ``host, shapes, texts``: one wrapper for all pages of a host.

    Every task folds its pages into one wrapper for each host; these are aligned in two steps, first within
    ``SALTS`` groups of tasks. A host with a third of all pages is thus read by all tasks, and what is put
    together is one short wrapper for each task.
    """
    part = parsed.select("host", "shapes", "texts").mapInArrow(_partial, WRAPPER).withColumn("salt", F.spark_partition_id() % SALTS)
    halfway = part.groupBy("host", "salt").applyInPandas(_merged, WRAPPER)
    return halfway.groupBy("host").applyInPandas(_merged, WRAPPER).drop("pages")


def _per_host(batch: pa.RecordBatch, given: dict | None, columns: list[str]) -> Iterator[tuple]:
    """Host and figures of every row, from what was shipped or from the row itself."""
    hosts = batch.column("host").to_pylist()
    figures = zip(*(batch.column(c).to_pylist() for c in columns)) if given is None else (given[h] for h in hosts)
    return zip(hosts, figures)


def _fillings(shipped):
    """``host, pages, page, node, key, chars``: the different texts of every page at the nodes they fill, and a row without
    a key for every node that the page fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, wr.Slots] = {}
        given = shipped.value if shipped is not None else None
        for batch in batches:
            rows: dict[tuple, int] = {}
            for (host, (raw, pages)), page, blocks in zip(_per_host(batch, given, FIGURES[:2]), batch.column("page").to_pylist(), _blocks(batch)):
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[host] = wr.Slots(json.loads(raw))
                for shape, text in blocks:
                    node = known[host].node(shape)
                    if node is not None:
                        at = wr.key_of(node, "")
                        rows[host, pages, page, at, None] = 0
                        rows[host, pages, page, at, wr.key_of(node, text)] = len(text)
            kinds = (pa.string(), *[pa.int64()] * 4)
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(rows.values()), pa.int64())], names=["host", "pages", "page", "node", "key", "chars"])

    return run


def known_of_slots(parsed: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``host, fixed, fill``: what the pages of a host say of the slots of its wrapper (``wrapper.Content``).

    ``wrappers`` has ``pages``, the number of different pages with text. ``fixed`` holds ``(key, n)`` of the texts that at least
    ``wrapper.SHARE`` of them have at one node; those are at most as many as twice the texts of a page. ``fill`` holds
    ``(key, chars)`` of every node: the code points of texts that no other page has there, for each page that fills it.
    """
    rows = parsed.where("page IS NOT NULL")
    met = _with_wrappers(rows, wrappers, FIGURES[:2], _fillings, "host string, pages long, page long, node long, key long, chars long")
    counts = met.groupBy("host", "pages", "node", "key").agg(F.count_distinct("page").alias("n"), F.max("chars").alias("chars"))
    n, text = F.col("n"), F.col("key").isNotNull()
    often = text & (n >= wr.LEAST) & (n >= wr.SHARE * F.col("pages"))
    own = F.sum(F.when(n < wr.LEAST, F.col("chars"))) / F.max(F.when(~text, n))
    nodes = counts.groupBy("host", "node").agg(
        F.coalesce(own, F.lit(0.0)).alias("chars"), F.collect_list(F.when(often, F.struct("key", "n"))).alias("fixed")
    )
    fill = F.collect_list(F.struct(F.col("node").alias("key"), "chars")).alias("fill")
    return nodes.groupBy("host").agg(F.flatten(F.collect_list("fixed")).alias("fixed"), fill)


def _texts(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, wr.Content] = {}
        given = shipped.value if shipped is not None else None
        for batch in batches:
            texts = []
            for (host, (raw, n, fixed, fill)), blocks in zip(_per_host(batch, given, FIGURES), _blocks(batch)):
                if host not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    counted, chars = ({f["key"]: f[c] for f in listed or ()} for listed, c in ((fixed, "n"), (fill, "chars")))
                    known[host] = wr.Content(json.loads(raw), n or 0, counted, chars)
                texts.append("\n".join(known[host].of(blocks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return run


FIGURES = ["wrapper", "pages", "fixed", "fill"]


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, columns: list[str], work, shape: str) -> DataFrame:
    """``work`` over ``rows`` with the ``columns`` of each row's host: sent to every task up to ``SHIPPED`` bytes, joined beyond."""
    spark = rows.sparkSession
    entries = sum((F.coalesce(F.size(c), F.lit(0)) for c in columns if c in ("fixed", "fill")), F.lit(0))
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host") + 16 * entries), F.lit(0))).first()[0]
    if size <= SHIPPED:
        shipped = spark.sparkContext.broadcast({r["host"]: tuple(r[c] for c in columns) for r in wrappers.collect()})
        return rows.mapInArrow(work(shipped), shape)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(4 * partitions_of(spark)))
    return hand_back(rows, wrappers, "host", salt).mapInArrow(work(None), shape)


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every page.

    The library has no web pages among its own records, so this operator is general: ``pages`` needs an id, an
    address and the page source. Pages are grouped by the host of their address; a page without one is
    grouped with the others that have none. Pages are parsed once; the host's wrapper is inferred from them (``infer_wrappers``), the
    pages are mapped to its nodes to learn what fills them (``known_of_slots``), and the text is what a page has in
    the slots that hold the article (``wrapper.Content``). Menus, headers, footers, sidebars, notices, adverts, forms and comments are left out. Blocks are
    joined by a line break in page order; nothing is capped.

    A null or empty page has an empty text. Repeated pages are extracted each; null ids and addresses stay null;
    an empty table gives an empty result; other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(html).alias("html"), host.alias("host"))
    kind, address = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    ids = f"page_id {kind}, url {address}"
    parsed = cut_lineage(rows.mapInArrow(_parsed, f"{ids}, host string, page long, shapes array<string>, texts array<string>"), "zstd")
    totals = parsed.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    wrappers = cut_lineage(infer_wrappers(parsed).join(totals, "host"))
    known = cut_lineage(wrappers.join(known_of_slots(parsed, wrappers), "host", "left"))
    return _with_wrappers(parsed, known, FIGURES, _texts, f"{ids}, text string")
