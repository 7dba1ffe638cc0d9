"""Benchmark items inside label files, also with other numbers, names or units put in."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm.tables import text_of
from annospark.llm.templates import TemplateWindows
from annospark.session import cut_lineage

WINDOW = 8  # template words
LITERAL = 4  # of which so many must be no placeholder; whole short items excepted
SHIPPED = 2_000_000  # benchmark windows up to which their hashes are sent to every task
SCREEN_BITS = 26  # beyond, tasks get a bit map of 2**SCREEN_BITS bits


def _windows(sizes: list[int], wanted, keep: tuple[str, ...]):
    """``keep..., hash, pos, size, exact, slots`` of all windows, of those that ``wanted`` may hold if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = wanted.value if wanted is not None else None
        maker = TemplateWindows(sizes, LITERAL, screen is not None)
        for batch in batches:
            owner, hashes, places, widths, exact, slots = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for found, where, size, skipped, by_words in maker.of(text, screen is None):
                    if screen is None:
                        at = range(len(found))
                    elif screen.dtype == np.int64:
                        place = np.searchsorted(screen, found)
                        at = np.flatnonzero(screen[np.minimum(place, len(screen) - 1)] == found) if len(screen) else []
                    else:
                        bit = (found.view(np.uint64) >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)
                        at = np.flatnonzero(screen[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    for p in at:
                        owner.append(i)
                        hashes.append(int(found[p]))
                        places.append(int(where[p]))
                        widths.append(size)
                        exact.append(by_words)
                        slots.append(maker.slots(int(where[p]), size, skipped))
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(rows) for k in keep]
                + [pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), pa.array(widths, pa.int64()), pa.array(exact, pa.bool_()), pa.array(slots, pa.list_(pa.string()))],
                names=[*keep, "hash", "pos", "size", "exact", "slots"],
            )

    return run


WINDOWS = "hash long, pos long, size long, exact boolean, slots array<string>"


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item_id, hash, pos, size, exact, slots, n_plain, n_all`` of the windows of all benchmark items.

    ``exact`` windows are hashed by their words. ``n_plain`` counts an item's other windows, ``n_all`` all.
    """
    rows = items.select(F.col(item).alias("item_id"), text_of(text).alias("text")).where("item_id IS NOT NULL")
    kind = rows.schema["item_id"].dataType.simpleString()
    made = rows.mapInArrow(_windows([window], None, ("item_id",)), f"item_id {kind}, {WINDOWS}")
    usable = made.groupBy("item_id").agg(F.count_distinct(F.when(~F.col("exact"), F.col("pos"))).alias("n_plain"), F.count_distinct("pos").alias("n_all"))
    return cut_lineage(made.join(usable, "item_id"))


def _screen(windows: DataFrame):
    """What tasks test document windows against: sorted hashes, or a bit map of fixed size for many windows."""
    spark, hashes = windows.sparkSession, windows.select("hash").distinct()
    n = hashes.count()
    if n <= SHIPPED:
        return spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hashes.collect()], np.int64)))
    bit = F.shiftrightunsigned("hash", 64 - SCREEN_BITS)
    byte = hashes.select(F.shiftright(bit, 3).alias("byte"), bit.bitwiseAND(F.lit(7)).alias("b")).groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, CAST(b AS INT))")).alias("bits"))
    bits = np.zeros(1 << (SCREEN_BITS - 3), np.uint8)  # one row for each byte of the map at most
    for r in byte.toLocalIterator():
        bits[r["byte"]] = r["bits"]
    return spark.sparkContext.broadcast(bits)


DRIFT = 16  # words by which an occurrence may move against the item from one window to the next


def occurrences(places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Places ``(in the file, in the item)`` put together to occurrences, in each of which both grow.

    Values of another number of words move what follows, so a chain may change its distance by ``DRIFT`` words at a
    time. Chains of most places come first and use them up; what stands at one distance is an occurrence, too.
    """
    places = sorted(places)
    lines: dict[int, tuple[list[int], list[int]]] = {}  # distance -> places in the item, their numbers
    best, before = [], []
    for n, (d, i) in enumerate(places):
        top, source = (0, 0), None
        for away in range(-DRIFT, DRIFT + 1):
            line = lines.get(d - i + away)
            k = bisect_left(line[0], min(i, i - away)) - 1 if line else -1
            if k >= 0:
                g = line[1][k]
                score = (best[g][0], best[g][1] - abs(away))
                if source is None or score > top:
                    top, source = score, g
        best.append((top[0] + 1, top[1]))
        before.append(source)
        own = lines.setdefault(d - i, ([], []))
        own[0].append(i)
        own[1].append(n)
    out, used = [], [False] * len(places)
    for n in sorted(range(len(places)), key=lambda n: best[n], reverse=True):
        chain = []
        while n is not None and not used[n]:
            used[n] = True
            chain.append(places[n])
            n = before[n]
        if chain:
            out.append(chain)
    return out + [[places[n] for n in line[1]] for line in lines.values()]


def _judged(hits: list[dict], n_plain: int, n_all: int) -> tuple[float, bool, float, int]:
    """``coverage, verbatim, consistency, n_windows`` of hits that are taken for one occurrence."""
    plain, met = len({h["pos"] for h in hits if not h["exact"]}), len({h["pos"] for h in hits})
    coverage, n = max((met / n_all, n_all), (plain / n_plain, n_plain) if n_plain else (0.0, 0))
    pairs = {(a, b) for h in hits for a, b in zip(h["slots"], h["found"])}
    images = Counter(a for a, _ in pairs)
    consistency = sum(k == 1 for k in images.values()) / len(images) if images else 1.0
    return coverage, all(a == b for a, b in pairs), consistency, n


def _judge(coverage: float, consistency: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("hits", "n_plain", "n_all"))
            for row, (hits, n_plain, n_all) in enumerate(zip(*columns)):
                at: dict[tuple[int, int], list[dict]] = {}
                for h in hits:
                    at.setdefault((h["at"], h["pos"]), []).append(h)
                groups = [hits, *([h for place in chain for h in at[place]] for chain in occurrences(list(at)))]
                good = [j for j in (_judged(g, n_plain, n_all) for g in groups) if j[0] >= coverage and j[2] >= consistency]
                if good:
                    kept.append(row)
                    out.append(max(good))
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in ("stem", "text_key", "item_id")]
                + [pa.array([j[k] for j in out], t) for k, t in ((0, pa.float64()), (3, pa.int64()), (2, pa.float64()), (1, pa.bool_()))],
                names=["stem", "text_key", "item_id", "coverage", "n_windows", "consistency", "verbatim"],
            )

    return run


def contaminated(
    files: DataFrame,
    items: DataFrame,
    stem: str = "stem",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: float = 0.3,
    consistency: float = 0.8,
) -> DataFrame:
    """Label files that hold a benchmark item: ``stem, text_key, item_id, coverage, n_windows, consistency, verbatim``.

    Texts become templates (``templates.template``): numbers, units and names turn into placeholders. Windows of
    ``window`` template words are joined by hash with those of the items. Hits are put together to occurrences of
    the item by their places in the file and in the item (``occurrences``). A file holds an item when one
    occurrence, or the file as a whole, has at least ``coverage`` of the item's windows and its slots agree: in
    ``consistency`` of the item's slot values or more, a value is replaced by one and the same value everywhere.
    ``verbatim`` says that all slots have the item's own values; otherwise the question was given new parameters.
    The figures are those of the occurrence that covers most.

    An item shorter than a window is one window, which is looked for at every place of a file. Windows of
    hardly anything but placeholders are hashed by their words, so they are met by verbatim copies only; coverage is
    of all windows or of the others, whichever is more. Tasks
    screen their windows against the items' hashes, or against a bit map of fixed size when those are many, and
    only windows that pass are joined, exactly.

    Null and empty texts, and items without an id, match nothing. Repeated rows with one stem and text are one
    file; ``text_key``, a hash of the text, tells files with equal stems apart. Null stems stay null. Empty tables
    give an empty result. Other columns are not read.
    """
    body = text_of(text)
    rows = files.select(F.col(stem).alias("stem"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    kind = rows.schema["stem"].dataType.simpleString()
    wanted = benchmark_windows(items, item, item_text, window)
    sizes = sorted({window} | {r[0] for r in wanted.select("size").distinct().collect()})  # at most ``window`` of them
    passed = rows.mapInArrow(_windows(sizes, _screen(wanted), ("stem", "text_key")), f"stem {kind}, text_key long, {WINDOWS}")
    passed = passed.select("stem", "text_key", "hash", F.col("pos").alias("at"), F.col("slots").alias("found")).distinct()
    hits = passed.join(wanted, "hash")
    grouped = hits.groupBy("stem", "text_key", "item_id").agg(
        F.count_distinct(F.when(~F.col("exact"), F.col("pos"))).alias("plain"),
        F.count_distinct("pos").alias("met"),
        F.first("n_plain").alias("n_plain"),
        F.first("n_all").alias("n_all"),
        F.collect_list(F.struct("at", "pos", "exact", "slots", "found")).alias("hits"),
    )
    share = F.greatest(F.col("met") / F.col("n_all"), F.when(F.col("n_plain") > 0, F.col("plain") / F.col("n_plain")).otherwise(0.0))
    likely = grouped.where(share >= coverage).select("stem", "text_key", "item_id", "n_plain", "n_all", "hits")
    key = likely.schema["item_id"].dataType.simpleString()
    shape = f"stem {kind}, text_key long, item_id {key}, coverage double, n_windows long, consistency double, verbatim boolean"
    return likely.mapInArrow(_judge(coverage, consistency), shape)
