"""Near copies: SuperMinHash signatures, banding, exact verification and grouping by union of links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from annospark.llm import superminhash as sm
from annospark.llm.groups import components, hand_back
from annospark.llm.tables import partitions_of, text_of
from annospark.session import cut_lineage

SMALL = 32  # members of a bucket up to which its pairs are listed
BLOCK = 256  # members of one side of a block comparison
HELD = 2_000_000  # shingles that one side of a block comparison may hold
MISS = 1e-5  # chance that no band finds a pair exactly at the threshold
ROWS = 4  # slots of a band
TEXTS = 1_000  # texts whose shingles a task holds at once

NODE = "node binary"


@dataclass(frozen=True)
class Likeness:
    """Two sets are linked when ``100 * shared >= percent * united``."""

    words: int = 5
    percent: int = 80

    @property
    def slots(self) -> int:
        hit = (self.percent / 100) ** ROWS
        return ROWS * max(1, math.ceil(math.log(MISS) / math.log1p(-hit)))

    def linked(self, shared, n, m):
        return 100 * shared >= self.percent * (n + m - shared)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``TEXTS``, which bounds what a task holds in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _signed(words: int, slots: int, keep: tuple[str, ...]):
    """Signature rows ``keep..., n, node, bands`` of record batches with a ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sm.WordHashes()
        for batch in _pieces(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [sm.shingles(t, words, hashes) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            found: list = [None] * len(sets)
            for a, b in sm.chunks([sets[i] for i in full]):
                part = sm.bands(sm.signatures([sets[i] for i in full[a:b]], slots), ROWS)
                for i, row in zip(full[a:b], part):
                    found[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep]
                + [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=[*keep, "n", "node", "bands"],
            )

    return run


def _sets(words: int):
    """``node, n, elements`` of record batches with a ``node`` and its ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sm.WordHashes()
        for batch in _pieces(batches):
            sets = [sm.shingles(t, words, hashes) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "n", "elements"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, n, m, shared`` of rows with the elements of both sides."""
    for batch in batches:
        left, right = batch.column("ea").to_pylist(), batch.column("eb").to_pylist()
        count = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array([len(x) // 8 for x in left], pa.int64()),
             pa.array([len(y) // 8 for y in right], pa.int64()), pa.array(count, pa.int64())],
            names=["a", "b", "n", "m", "shared"],
        )


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one side shares with each set of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    place = place.reshape(-1)
    times = np.bincount(place, minlength=len(values))
    kept = np.flatnonzero(times > 1)
    new = np.full(len(values), -1, np.int64)
    new[kept] = np.arange(len(kept))
    place = new[place]
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 4096
    for low in range(0, len(kept), width):
        a, b = np.searchsorted(place, [low, low + width])
        bits = np.zeros((len(left) + len(right), width), np.float32)
        bits[owner[a:b], place[a:b] - low] = 1
        out += bits[: len(left)] @ bits[len(left) :].T
    return out


def _block_links(rule: Likeness):
    """Links of one block comparison: the first side against the second, or against itself if there is none.

    Only a spanning forest of the links is returned, which joins what they join.
    """

    def run(key, pdf):
        first = pdf[pdf["side"] == 0].drop_duplicates("node")
        other = pdf[pdf["side"] == 1].drop_duplicates("node")
        other = other if len(other) else first
        left, right = ([np.frombuffer(x, np.uint64) for x in f["elements"]] for f in (first, other))
        names = list(dict.fromkeys([*first["node"], *other["node"]]))
        links = []
        if left and right:
            n, m = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
            shared = _common(left, right).astype(np.int64)
            at = {x: i for i, x in enumerate(names)}
            root = list(range(len(names)))

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            a, b = [at[x] for x in first["node"]], [at[x] for x in other["node"]]
            for i, j in zip(*np.nonzero(rule.linked(shared, n, m))):
                x, y = top(a[i]), top(b[j])
                if x != y:
                    root[x] = y
                    links.append((names[a[i]], names[b[j]]))
        import pandas as pd

        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, rule: Likeness) -> DataFrame:
    """``a, b, linked`` for ``pairs(a, b)``, decided on the full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ea", "eb")
    counted = both.mapInArrow(_shared, "a binary, b binary, n long, m long, shared long")
    return counted.where(rule.linked(F.col("shared"), F.col("n"), F.col("m"))).select("a", "b")


def _buckets(nodes: DataFrame, rule: Likeness) -> DataFrame:
    """``key, node, n, held`` of all buckets with two members or more.

    Linked sets have lengths within ``percent`` of each other, so a bucket is dealt into classes of length; a
    set is in its own class and in the one below, and two linked sets share a class.
    """
    placed = nodes.select("node", "n", F.explode("bands").alias("band"))
    several = placed.groupBy("band").agg(F.count("*").alias("held")).where("held > 1").select("band")
    met = cut_lineage(placed.join(several, "band"))
    length = F.floor(F.log(F.col("n")) / F.lit(-math.log(rule.percent / 100))).cast("int")
    classed = met.select("node", "n", F.explode(F.array(length, length - 1)).alias("length"), "band")
    keyed = classed.select(F.xxhash64("band", "length").alias("key"), "node", "n")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    return cut_lineage(keyed.join(sizes, "key"))


def _listed(buckets: DataFrame, rule: Likeness) -> DataFrame:
    """The pairs of small buckets whose lengths allow a link."""
    member = F.struct("node", "n")
    rows = buckets.where(F.col("held") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("l"))
    later = lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("x"), y.alias("y")))
    rows = rows.select(F.explode(F.flatten(F.transform("l", later))).alias("p"))
    short, long = F.least("p.x.n", "p.y.n"), F.greatest("p.x.n", "p.y.n")
    return rows.where(100 * short >= rule.percent * long).select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"))


def _stars(large: DataFrame) -> DataFrame:
    """``key, a, b``: every member of a large bucket with the bucket's centre, the set that most buckets agree on."""
    weight = large.groupBy("node").agg(F.sum("held").alias("w"))
    # written: the join below then deals both sides anew and can split the members of a large bucket
    centre = cut_lineage(large.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node"))["node"].alias("b")))
    return large.select("key", F.col("node").alias("a")).join(centre, "key")


def _blocks(large: DataFrame, stars: DataFrame, roots: DataFrame, sets: DataFrame, rule: Likeness) -> DataFrame:
    """Links among members of large buckets that their centre did not connect.

    Members already in the centre's component are settled among themselves. The others are compared with all
    members, block against block; a block holds at most ``BLOCK`` sets on average, fewer where sets are long.
    """
    own = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    mid = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    placed = stars.join(own, "a", "left").join(mid, "b", "left")
    outside = ~F.coalesce(F.col("ra"), F.col("a")).eqNullSafe(F.coalesce(F.col("rb"), F.col("b")))
    placed = cut_lineage(placed.select("key", F.col("a").alias("node"), outside.alias("outside")))
    longest = large.groupBy("key").agg(F.max("n").alias("longest"))
    size = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(HELD) / F.col("longest")))).cast("int")
    blocks = lambda kind: F.ceil(F.count(F.when(kind, 1)) / F.first("size")).cast("int")
    shape = placed.join(longest.select("key", size.alias("size")), "key").groupBy("key")
    shape = shape.agg(blocks(F.col("outside")).alias("no"), blocks(~F.col("outside")).alias("ni")).where("no > 0")
    dealt = placed.join(cut_lineage(shape), "key")
    at = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("no")).otherwise(F.col("ni"))).cast("int")
    dealt = dealt.withColumn("at", at)
    others = F.sequence(F.lit(0), F.col("no") - 1)
    # a task is (block of outsiders, other block); blocks of settled members count on from ``no``
    outer = F.transform(others, lambda k: F.struct(F.least("at", k).alias("i"), F.greatest("at", k).alias("j"), (F.col("at") > k).cast("int").alias("side")))
    inner = F.when(F.col("ni") > 0, F.transform(F.sequence(F.col("no"), F.col("no") + F.greatest("ni", F.lit(1)) - 1), lambda k: F.struct(F.col("at").alias("i"), k.alias("j"), F.lit(0).alias("side"))))
    settled = F.transform(others, lambda k: F.struct(k.alias("i"), (F.col("no") + F.col("at")).alias("j"), F.lit(1).alias("side")))
    tasks = F.when(F.col("outside"), F.concat(outer, F.coalesce(inner, F.array().cast("array<struct<i:int,j:int,side:int>>")))).otherwise(settled)
    rows = dealt.select("key", "node", F.explode(tasks).alias("t")).select("key", "node", "t.*").join(sets.select("node", "elements"), "node")
    return rows.groupBy("key", "i", "j").applyInPandas(_block_links(rule), "a binary, b binary")


def near_copies(files: DataFrame, rule: Likeness = Likeness(), stem: str = "stem", text: str = "text") -> DataFrame:
    """Group label files with nearly the same words: ``stem, n_shingles, component_stem, kept``.

    A file's set holds the distinct shingles of ``rule.words`` words of its lower-cased text, as 64-bit hashes.
    Files whose sets share ``rule.percent`` percent of their union are linked; ``component_stem`` is the
    smallest stem that links reach, and the file with that stem is ``kept``.

    1. One pass makes a SuperMinHash signature and its band hashes for each file. Files with equal sets
       become one node.
    2. Nodes that agree in a band of ``ROWS`` slots share a bucket. There are so many bands that a pair right
       at the threshold is missed with a chance of ``MISS``; closer pairs less.
    3. Small buckets list their pairs. In a larger bucket each node is compared with a centre, and only nodes
       which that leaves apart are compared with the rest, in blocks of bounded size inside tasks. No bucket
       is cut, and the pairs of a large one are never listed.
    4. Every link is confirmed on the full sets; components are found by joins over the links.

    An empty, blank or null text has no shingles, is linked with nothing and kept. Rows that repeat with
    one stem share their decision. A null stem is smaller than none: it is chosen only where a group has no
    other, and is then kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = files.sparkSession
    body = text_of(text)
    rows = files.select(F.col(stem).alias("stem"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    kind = rows.schema["stem"].dataType.simpleString()
    signed = rows.mapInArrow(
        _signed(rule.words, rule.slots, ("stem", "text_key")), f"stem {kind}, text_key long, n long, node binary, bands array<long>"
    )
    signed = cut_lineage(signed)
    full = signed.where("n > 0")
    source = F.struct(F.isnull("stem").alias("none"), F.col("stem").alias("stem"), F.col("text_key").alias("text_key"))
    nodes = cut_lineage(
        full.groupBy("node").agg(F.min(source).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    buckets = _buckets(nodes, rule)
    small, large = _listed(buckets, rule), buckets.where(F.col("held") > SMALL)
    stars = cut_lineage(_stars(large))
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", "at.stem", "at.text_key")
    same = F.col("f.stem").eqNullSafe(F.col("w.stem")) & (F.col("f.text_key") == F.col("w.text_key"))
    texts = rows.alias("f").join(wanted.alias("w").hint("shuffle_hash"), same).select("w.node", "f.text")
    sets = cut_lineage(texts.mapInArrow(_sets(rule.words), "node binary, n long, elements binary").dropDuplicates(["node"]))

    pairs = small.unionByName(stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links = cut_lineage(_verified(pairs.distinct(), sets, rule))
    roots = components(links)
    if stars.limit(1).count():
        more = cut_lineage(_blocks(large, stars, roots, sets, rule))
        roots = components(links.unionByName(more))

    first = F.min(F.struct("at.none", "at.stem"))
    member = nodes.join(roots, "node", "left").select("node", "at", F.coalesce("root", "node").alias("root"))
    best = member.groupBy("root").agg(first.alias("best"))
    named = hand_back(member, best, "root", F.pmod(F.xxhash64("node"), F.lit(4 * partitions_of(spark))))
    named = named.select("node", F.col("best.stem").alias("component_stem"))
    salt = F.pmod(F.xxhash64("stem", "text_key"), F.lit(4 * partitions_of(spark)))
    grouped = hand_back(full.select("stem", "text_key", "n", "node"), named, "node", salt).select("stem", "n", "component_stem")
    alone = signed.where("n = 0").select("stem", "n", F.col("stem").alias("component_stem"))
    both = grouped.unionByName(alone)
    return both.select("stem", F.col("n").alias("n_shingles"), "component_stem", F.col("stem").eqNullSafe(F.col("component_stem")).alias("kept"))
