"""Shards of nearly equal size, cut by a histogram sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from annospark.llm.tables import in_order, text_of
from annospark.session import cut_lineage

PROBES = 256  # probes set in one bracket in each round
SPAN = 1 << 63


@dataclass
class Bracket:
    """Where a splitter is known to lie: text keys ``[low, high)``, or stem keys of the one text key ``inside``."""

    low: int
    high: int
    below: int  # exact bytes of all keys under ``low``
    inside: int | None = None

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // PROBES))

    @property
    def column(self) -> Column:
        return F.col("text_key" if self.inside is None else "stem_key")

    @property
    def holds(self) -> Column:
        here = (self.column >= self.low) & (self.column <= self.high - 1)
        return here if self.inside is None else (F.col("text_key") == self.inside) & here

    def edge(self, at: int) -> tuple[int, int]:
        """A key position as ``(text_key, stem_key)``."""
        return (at, 0) if self.inside is None else (self.inside, at)


def find_splitters(keyed: DataFrame, n_shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``n_shards - 1`` key positions that cut ``keyed`` into ranges of nearly equal ``size``.

    Each round counts the exact bytes between the probes of all open brackets in one pass; only those sums,
    at most ``PROBES`` for a splitter, reach the driver. A splitter is settled when the bytes below one of its
    probes miss the target by at most ``tolerance`` of a shard, or when no key lies between two neighbouring
    probes. Brackets narrow on the text key first, so a cut goes between groups of equal texts where one is
    near enough; only inside a larger group does it go by the stem key.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = int(tolerance * total / n_shards)
    open_ = {j: Bracket(0, SPAN, 0) for j in range(1, n_shards)} if total else {}
    settled = {j: (SPAN, 0) for j in range(1, n_shards)}  # an empty table: all cuts at the end
    while open_:
        brackets = {(b.inside, b.low): b for b in open_.values()}
        names = {k: i for i, k in enumerate(brackets)}
        probe = F.lit(None).cast("long")
        for k, b in brackets.items():
            probe = F.when(b.holds, F.expr(f"({'text_key' if b.inside is None else 'stem_key'} - {b.low}L) div {b.step}L") + names[k] * PROBES).otherwise(probe)
        value = F.coalesce(*[F.when(b.holds, b.column) for b in brackets.values()])
        counted = keyed.select(probe.alias("probe"), value.alias("value"), "size").where("probe IS NOT NULL")
        sums = counted.groupBy("probe").agg(F.sum("size").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
        slices: dict[int, list] = {}
        for r in sorted(sums.collect()):
            slices.setdefault(r["probe"] // PROBES, []).append(r)
        for j, b in list(open_.items()):
            target, below, hit = total * j // n_shards, b.below, None
            for r in slices[names[(b.inside, b.low)]]:
                if below + r["size"] >= target:
                    hit = r
                    break
                below += r["size"]
            edges = [(abs(below - target), b.edge(hit["low"])), (abs(below + hit["size"] - target), b.edge(hit["high"] + 1))]
            if min(edges)[0] <= slack or hit["low"] == hit["high"] and b.inside is not None:
                settled[j] = min(edges)[1]
                del open_[j]
            elif hit["low"] == hit["high"]:
                open_[j] = Bracket(0, SPAN, below, hit["low"])
            else:
                open_[j] = Bracket(hit["low"], hit["high"] + 1, below, b.inside)
    return [settled[j] for j in range(1, n_shards)]


def histogram_shards(
    files: DataFrame, n_shards: int = 16, stem: str = "stem", text: str = "text", tolerance: float = 0.002
) -> DataFrame:
    """Put label files into ``n_shards`` shards with nearly equal bytes (law ``bytes``).

    Gives ``stem, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the UTF-8 length of the text
    plus 1, ``slot`` counts the files of a shard from 0, and ``grown_shard`` is null under this law.

    Files are ordered by a hash of their text, then by a hash of their stem. ``find_splitters`` narrows the 
    shard boundaries by counting; then the rows are exchanged once, by range, and numbered from the row counts
    of the parts. A shard misses its share by at most ``tolerance`` of it plus one file at each end.
    Equal texts lie next to each other; their group is cut only where no boundary between groups is near
    enough, so a group larger than a shard spreads.

    A null text has size 1 and the checksum of the empty text. Null stems hash alike; rows that agree in stem
    and text share a shard. An empty table gives an empty result. Other columns are not read.
    """
    body = text_of(text)
    half = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    keyed = cut_lineage(
        files.select(
            F.col(stem).alias("stem"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            half(body).alias("text_key"),
            half(F.col(stem)).alias("stem_key"),
        )
    )
    shard = F.lit(0)
    for t, s in find_splitters(keyed, n_shards, tolerance):
        if t < SPAN:
            after = F.col("text_key") > t
            at = F.col("text_key") == t
            shard = shard + (after | (at & (F.col("stem_key") >= s) if s < SPAN else F.lit(False))).cast("int")
    placed = in_order(keyed.withColumn("shard", shard), "shard", "text_key", "stem_key", "stem")
    held = placed.groupBy("shard", "__part").agg(F.count("*").alias("n"), F.min("__pos").alias("__first"))
    earlier = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part and shard that meet: at most the number of parts plus the number of shards
    before = held.select("shard", "__part", "__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), ["shard", "__part"]).select(
        "stem",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__pos") - F.col("__first") + F.col("__before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
