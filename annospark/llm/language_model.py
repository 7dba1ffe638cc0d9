"""An interpolated modified Kneser-Ney model of word pairs over label files, counted in Spark and scored from mapped arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from annospark.llm.hash_arrays import Gathered, HashArrays, narrow, new_folder, packed, shard_cuts, summed, unpacked, write_array
from annospark.llm.superminhash import WordHashes, mixed
from annospark.llm.tables import partitions_of, text_of

# a word holds no white space, so these stand for no word
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(mark)) for mark in (b"\t", b"\n"))
TOKENS = 1_000_000  # tokens a task works on at once
PIECE = 4 << 20  # bytes of a text that are split at once
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = "shard int, kind int, data binary"
OF_CONTEXT, OF_WORD, OF_PAIRS = range(3)


def _hashes_of(raw: bytes, hashes: WordHashes) -> Iterator[np.ndarray]:
    """The word hashes of a text in pieces, the last one followed by the end mark."""
    at = 0
    while True:
        cut = BLANK.search(raw, at + PIECE)
        words = raw[at : cut.start() if cut else len(raw)].lower().split()
        each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        if cut is None:
            yield np.append(each, END)
            return
        yield each
        at = cut.start()


def _runs(texts: list, hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of tokens, so many that they hold about ``TOKENS``: all hashes in a row, where runs begin, and their texts.

    A run begins with the token before it, or with the begin mark.
    """
    rows, runs, held = [], [], 0
    for i, raw in enumerate(texts):
        before = BEGIN
        for piece in _hashes_of(raw or b"", hashes):
            if not len(piece):
                continue
            rows.append(i)
            runs.append(np.concatenate(([before], piece)))
            before, held = piece[-1], held + len(piece)
            if held >= TOKENS:
                yield _flat(rows, runs)
                rows, runs, held = [], [], 0
    if rows:
        yield _flat(rows, runs)


def _flat(rows, runs):
    lengths = np.array([len(r) for r in runs])
    return np.concatenate(runs), np.cumsum(lengths) - lengths, np.array(rows)


def _follow(starts: np.ndarray, n: int) -> np.ndarray:
    """Positions that are no begin of a run: the tokens, each with its context just before it."""
    follows = np.ones(n, bool)
    follows[starts] = False
    return np.flatnonzero(follows)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _blocks(kind: int, cuts: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One packed row for each shard that has entries."""
    full = np.flatnonzero(np.diff(cuts))
    data = [packed(*[c[cuts[p] : cuts[p + 1]] for c in columns]) for p in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([kind] * len(full), pa.int32()), pa.array(data, pa.binary())], names=["shard", "kind", "data"])


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = WordHashes(), Gathered(2)
        for batch in batches:
            for flat, starts, _ in _runs(_texts(batch), hashes):
                tokens = flat[_follow(starts, len(flat))]
                found.add(*summed(tokens, np.ones(len(tokens), np.uint64)))
                if found.waiting > 2 * TOKENS:
                    words, n = found.all()
                    yield _blocks(OF_WORD, shard_cuts(words, shards), words, n)
                    found = Gathered(2)
        words, n = found.all()
        yield _blocks(OF_WORD, shard_cuts(words, shards), words, n)

    return run


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for batch in batches:
        for shard, kind, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "data")]):
            yield shard, kind, unpacked(data)


def _numbers(*rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["shard", "numbers"])


NUMBERS = "shard int, numbers array<long>"


def _store_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, shard = Gathered(2), None
        for shard, _, columns in _blocks_of(batches):
            found.add(*columns)
        if shard is not None:
            words, n = found.all()
            into = HashArrays(folder, "word", [])
            write_array(into.path("hash", shard), words)
            write_array(into.path("count", shard), narrow(n))
            yield _numbers((shard, [len(words), int(n.sum())]))

    return run


def _pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A number for two ranks, different for different pairs as long as there are fewer than 2**32 words."""
    context, word = context.astype(np.uint64), word.astype(np.uint64)
    return mixed(((context << np.uint64(32)) | (context >> np.uint64(32))) ^ word)


def _ranks(words: HashArrays, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their ranks (the begin mark comes after all words, -1: unknown), and where each hash of ``flat`` is."""
    distinct, inverse = np.unique(flat, return_inverse=True)
    ranks = words.find(distinct)
    ranks[distinct == BEGIN] = words.n
    return distinct, ranks, inverse


def _count_pairs(words: HashArrays, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = WordHashes(), Gathered(4)
        for batch in batches:
            for flat, starts, _ in _runs(_texts(batch), hashes):
                _, ranks, inverse = _ranks(words, flat)
                ids, at = ranks[inverse].astype(np.uint64), _follow(starts, len(flat))
                context, word = ids[at - 1], ids[at]
                found.add(*summed(_pair_keys(context, word), np.ones(len(at), np.uint64), context, word))
                if found.waiting > 4 * TOKENS:
                    yield pairs_of(found)
                    found = Gathered(4)
        yield pairs_of(found)

    def pairs_of(found: Gathered) -> pa.RecordBatch:
        keys, n, context, word = found.all()
        return _blocks(OF_PAIRS, shard_cuts(keys, shards), context, word, n)

    return run


def _kinds(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _store_pairs(folder: str, words: HashArrays):
    """Writes the pairs of a shard; hands on what their contexts and words need to know of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, shard = Gathered(4), None
        for shard, _, (context, word, n) in _blocks_of(batches):
            found.add(_pair_keys(context, word), n, context, word)
        if shard is None:
            return
        keys, n, context, word = found.all()
        into = HashArrays(folder, "pair", [])
        write_array(into.path("hash", shard), keys)
        write_array(into.path("count", shard), narrow(n))
        cuts = lambda ranks: np.concatenate((np.searchsorted(ranks, words.starts.astype(np.uint64)), [len(ranks)]))
        order = np.argsort(context, kind="stable")
        ranks, first = np.unique(context[order], return_index=True)
        total = lambda values: np.add.reduceat(values[order].astype(np.uint64), first)
        yield _blocks(OF_CONTEXT, cuts(ranks), ranks, total(n), total(n == 1), total(n == 2), total(n > 2))
        ranks, before = np.unique(word, return_counts=True)
        yield _blocks(OF_WORD, cuts(ranks), ranks, before)
        here = np.array([shard])
        data = packed(*[np.array([v], np.uint64) for v in (len(keys), *_kinds(n))])
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array([OF_PAIRS], pa.int32()), pa.array([data], pa.binary())], names=["shard", "kind", "data"])

    return run


STATS = ("total", "once", "twice", "more")


def _store_stats(words: HashArrays):
    """Writes, aligned with the words of a shard, the sums over the pairs they begin and the number of pairs they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, before, pairs, shard = {}, None, [0] * 5, None
        for shard, kind, columns in _blocks_of(batches):
            if kind == OF_PAIRS:
                pairs = [int(c[0]) for c in columns]
                continue
            if before is None:  # the begin mark comes after the last word
                n = int(words.ends[shard] - words.starts[shard]) + (shard == len(words.ends) - 1)
                sums, before = {c: np.zeros(n, np.uint64) for c in STATS}, np.zeros(n, np.uint64)
            at = (columns[0] - np.uint64(words.starts[shard])).astype(np.int64)
            for into, values in zip(sums.values() if kind == OF_CONTEXT else [before], columns[1:]):
                into[at] += values  # a block holds a rank once
        if shard is None:
            return
        if before is None:
            before = np.zeros(0, np.uint64)
        else:
            for c, values in {**sums, "before": before}.items():
                write_array(words.path(c, shard), narrow(values))
        kinds = [int((before == 1).sum()), int((before == 2).sum()), int((before > 2).sum())]
        yield _numbers((shard, [*pairs, int(before.sum()), *_kinds(before), *kinds]))

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4.

    Where those numbers allow no estimate (small tables), 0.5, 1 and 1.5.
    """
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d <= k for d, k in zip(found, (1, 2, 3))):
            return found
    return (0.5, 1.0, 1.5)


def _taken_off(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3)]


@dataclass(frozen=True)
class LabelModel:
    """A fitted model: where its arrays are, and a few totals. It is small, whatever the size of the arrays."""

    words: HashArrays
    pairs: HashArrays
    train_tokens: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    n_pairs: int  # distinct pairs: the sum of the words' left contexts
    spare: float  # what the discounts leave to all words alike

    def logs(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token of the runs: log10 of its probability, its add-0.1 logarithm, and whether it is known."""
        _, ranks, inverse = _ranks(self.words, flat)
        order = np.argsort(ranks, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        is_word = np.where(ranks[order] < self.words.n, ranks[order], -1)
        seen, before = (v[back] for v in self.words.values(("count", "before"), is_word))
        total, once, twice, more = (v[back] for v in self.words.values(STATS, ranks[order] if self.n_pairs else is_word))
        n = self.words.n
        own = 1 / (n + 1)
        word_p = np.full(len(ranks), own)
        if self.n_pairs:
            word_p = (np.maximum(before - _taken_off(before, self.word_discounts), 0) + self.spare * own) / self.n_pairs
        d1, d2, d3 = self.pair_discounts
        scale = np.maximum(total, 1)
        lower = np.where(total > 0, (d1 * once + d2 * twice + d3 * more) / scale, 1.0)
        at = _follow(starts, len(flat))
        context, word = inverse[at - 1], inverse[at]
        keys = _pair_keys(ranks[context], ranks[word])
        sort = np.argsort(keys)
        found = self.pairs.find(keys[sort])
        found[(ranks[context[sort]] < 0) | (ranks[word[sort]] < 0)] = -1
        n_pair = np.empty(len(at), np.int64)
        n_pair[sort] = self.pairs.values(("count",), found)[0]
        p = np.maximum(n_pair - _taken_off(n_pair, self.pair_discounts), 0) / scale[context] + lower[context] * word_p[word]
        base = np.log10((seen + 0.1) / (self.train_tokens + 0.1 * (n + 1)))
        return np.log10(p), base[word], seen[word] > 0


def fit_model(files: DataFrame, stem: str = "stem", text: str = "text") -> LabelModel:
    """Count the words and word pairs of label files ``(stem, text)`` and estimate an interpolated modified Kneser-Ney model.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; each text ends with a token of its own, and its
    first word follows a begin mark. Three discounts for pairs and three for words come from the counts of counts.
    Every task sums what it reads and sends it to shards of equal hash ranges, so a frequent word or pair reaches a
    shard once per task; shards write sorted arrays below ``spark.checkpoint.dir``, which must be a folder that all
    machines mount. Only a few numbers per shard reach the driver.

    Null and empty texts count as one end token; repeated rows count each time; an empty table gives a model that
    knows no word. Other columns are not read.
    """
    spark = files.sparkSession
    shards, folder = partitions_of(spark), new_folder(spark, "label-model")
    texts = files.select(text_of(text).alias("text"))
    dealt = lambda df: df.repartitionById(shards, F.col("shard"))
    words, train = [0] * shards, 0
    for shard, (n, tokens) in dealt(texts.mapInArrow(_count_words(shards), BLOCK)).mapInArrow(_store_words(folder), NUMBERS).collect():
        words[shard], train = n, train + tokens
    words = HashArrays(folder, "word", words)
    pairs, sums = [0] * shards, np.zeros(12, np.int64)
    counted = dealt(texts.mapInArrow(_count_pairs(words, shards), BLOCK)).mapInArrow(_store_pairs(folder, words), BLOCK)
    for shard, numbers in dealt(counted).mapInArrow(_store_stats(words), NUMBERS).collect():
        pairs[shard] = numbers[0]
        sums += np.array(numbers[1:])
    pair_kinds, n_pairs, word_kinds, ends = sums[:4], int(sums[4]), sums[5:9], sums[9:]
    by_word = discounts(*map(int, word_kinds))
    spare = float(sum(d * int(n) for d, n in zip(by_word, ends)))
    return LabelModel(words, HashArrays(folder, "pair", pairs), train, discounts(*map(int, pair_kinds)), by_word, n_pairs, spare)


def score_files(files: DataFrame, model: LabelModel, stem: str = "stem", text: str = "text") -> DataFrame:
    """``stem, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every label file under ``model``.

    ``score`` is the sum of the log10 probabilities of the whole text's tokens, its end included; ``base_score`` the
    same under single words with 0.1 added to every count; ``perplexity`` is taken per token. Tasks map the arrays
    and read what their words need. Null and empty texts are one end token; null stems stay null; repeated rows are
    scored each; an empty table gives an empty result; other columns are not read.
    """
    rows = files.select(F.col(stem).alias("stem"), text_of(text).alias("text"))
    kind = rows.schema["stem"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            score, base = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for flat, starts, owner in _runs(_texts(batch), hashes):
                logs, plain, seen = model.logs(flat, starts)
                first = starts - np.arange(len(starts))  # each run has one token less than entries
                for into, values in ((score, logs), (base, plain), (known, seen.astype(np.int64)), (n, np.ones(len(logs), np.int64))):
                    np.add.at(into, owner, np.add.reduceat(values, first))
            arrays = [batch.column("stem"), pa.array(n), pa.array(known), pa.array([model.train_tokens] * batch.num_rows, pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / np.maximum(n, 1), 300))]
            yield pa.RecordBatch.from_arrays(arrays, names=["stem", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return rows.mapInArrow(run, f"stem {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
