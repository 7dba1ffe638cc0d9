"""Whitening of crop features by incremental eigendecomposition and Rayleigh-Ritz refinement."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annospark.llm.secular import EPS, Spectrum
from annospark.llm.tables import partitions_of
from annospark.session import cut_lineage, spread_out

GRID = 64  # steps of a feature between one whole number and the next
FAR = 1 << 52  # steps at which larger features are held
FAN = 8  # spectra that one task combines
GUARD = 8  # directions refined beyond those asked for
SETTLED = 1e-12  # residual of an eigenpair, as a share of the largest eigenvalue
SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, vectors array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as an array of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _gridded(crops: DataFrame) -> tuple[DataFrame, int]:
    """The crops whose features are all there and finite, with ``steps``, and the number of features."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    features = F.col("features").cast("array<double>")
    rows = crops.select("image_id", "box_id", features.alias("features")).where(F.col("features").isNotNull()).where(F.forall("features", finite))
    least, d = rows.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    held = lambda x: F.floor(F.greatest(F.lit(float(-FAR)), F.least(F.lit(float(FAR)), x * GRID))).cast("long")
    steps = F.transform("features", held)
    if least != d:
        steps = F.concat(steps, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("features")))
    return rows.select("image_id", "box_id", steps.alias("steps")), d or 0


def _fitted(d: int):
    """The spectrum of a partition, one centred update after the other, and its exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, sums = Spectrum(d), [0] * d
        for batch in batches:
            x = _matrix(batch.column("steps"))
            for at in range(0, len(x), 512):  # 512 numbers of up to 2**52 fit a long
                sums = [s + int(p) for s, p in zip(sums, x[at : at + 512].sum(axis=0))]
            for row in x.astype(float):
                own.add(row)
        if own.n:
            yield _row(TaskContext.get().partitionId(), sums, own)

    return run


def _row(part: int, sums: list[int], s: Spectrum) -> pa.RecordBatch:
    cells = [part, s.n, [Decimal(v) for v in sums], s.mean, s.values, s.vectors.ravel()]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["part", "n", "sums", "mean", "eigenvalues", "vectors"])


def _spectrum(row: dict) -> tuple[list[int], Spectrum]:
    d = len(row["mean"])
    arrays = [np.array(row[c], float) for c in ("mean", "eigenvalues", "vectors")]
    return [int(v) for v in row["sums"]], Spectrum(d, row["n"], arrays[0], arrays[1], arrays[2].reshape(d, d))


def _combined(table: pa.Table) -> pa.Table:
    """The spectrum of up to ``FAN`` neighbouring parts."""
    rows = sorted(table.drop_columns(["group"]).to_pylist(), key=lambda r: r["part"])
    sums, own = _spectrum(rows[0])
    for r in rows[1:]:
        more, other = _spectrum(r)
        sums, _ = [a + b for a, b in zip(sums, more)], own.merge(other)
    return pa.Table.from_batches([_row(rows[0]["part"] // FAN, sums, own)])


def fit_spectrum(fit: DataFrame, d: int) -> tuple[list[int], Spectrum]:
    """Exact sums and the spectrum of ``fit(steps)``: tasks fit their rows, then up to ``FAN`` neighbours at a time are combined."""
    spectra = cut_lineage(spread_out(fit, "steps").mapInArrow(_fitted(d), SPECTRUM))
    parts = partitions_of(fit.sparkSession)
    while parts > 1:
        grouped = spectra.withColumn("group", F.expr(f"part div {FAN}")).groupBy("group")
        spectra, parts = cut_lineage(grouped.applyInArrow(_combined, SPECTRUM)), -(-parts // FAN)
    return _spectrum(spectra.first().asDict())


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: as longs where they fit, else as whole numbers of any size."""
    top = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if top < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _added(fit: DataFrame, figures, n: int, sums: list[int]) -> dict[int, float]:
    """``{position: sum}`` of what ``figures(centred rows)`` gives for the rows of ``fit``, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            x = _matrix(batch.column("steps"))
            for at in range(0, len(x), 4096):
                total = total + figures(_centred(x[at : at + 4096], n, sums).astype(float) / n)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["at", "value"])

    return {r["at"]: r["value"] for r in fit.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}


def refine(fit: DataFrame, n: int, sums: list[int], start: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of the covariance of ``fit``, their vectors, and the trace.

    Rayleigh-Ritz: the rows are multiplied with the present directions in one pass over all tasks, and the small
    projected problem gives better ones. If a pair is not settled, what it misses joins the directions for another pass.
    """
    d = len(sums)
    basis = np.linalg.qr(start)[0]
    while True:
        m = basis.shape[1]
        found = _added(fit, lambda c: np.append((c.T @ (c @ basis)).ravel(), (c * c).sum()), n, sums)
        flat = np.array([found[i] for i in range(d * m + 1)]) / n
        image, trace = flat[:-1].reshape(d, m), float(flat[-1])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:wanted], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        missed = image[:, :wanted] - basis[:, :wanted] * values
        size = np.sqrt((missed * missed).sum(axis=0))
        open_ = size > SETTLED * max(values[0], 0) if m < d else np.zeros(wanted, bool)
        if not open_.any():
            return np.maximum(values, 0), basis[:, :wanted], trace
        keep = basis[:, : min(m, 3 * (wanted + GUARD))]
        more = missed[:, open_] / size[open_]
        for _ in range(2):  # twice is enough
            more = more - keep @ (keep.T @ more)
        basis = np.linalg.qr(np.column_stack((keep, more)))[0][:, :d]


def whiten_features(crops: DataFrame, components: int = 16) -> DataFrame:
    """Whitened features of crops ``(image_id, box_id, features)``, such as those the proposal validator learns from.

    Features are counted in whole steps of 1/64, rounded down, so sums over any number of crops are exact. The components are the
    unit eigenvectors of the covariance (divisor n) of the n *distinct* feature vectors, numbered from 1 by falling
    eigenvalue, their largest entry positive. For every crop and each of up to ``components`` components: ``image_id, box_id,
    component, n, deviation`` (sum of the squares of n times a feature less the sum of that feature; null beyond the range of a
    long), ``whitened`` (the centred vector along the component, over the root of the eigenvalue), ``explained`` (the eigenvalue's
    share of the trace) and ``identity_error`` (largest entry of the covariance of ``whitened`` less the identity, measured in a pass of
    its own; one value for all rows).

    Each task updates eigenvalues and vectors by secular equations for one vector after the other; spectra are combined by further
    updates, a few at a time; then Rayleigh-Ritz passes over all tasks settle the leading pairs. Tasks and the driver hold
    squares of the number of features, never rows of all crops.

    Crops without features, or with a null or non-finite one, are left out. Shorter vectors count as if they ended in zeros; features
    beyond 2**46 count as that. Repeated crops each get their rows. A component without variance (equal vectors, or fewer
    than components) has null ``whitened`` and 0 ``explained``, null if there is no variance at all, and is
    left out of ``identity_error``. An empty table, or one of empty vectors, gives no rows. Other columns are not read.
    """
    rows, d = _gridded(crops)
    wanted = min(components, d)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"image_id {kinds['image_id']}, box_id {kinds['box_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not wanted:
        return crops.sparkSession.createDataFrame([], schema)
    fit = cut_lineage(rows.select("steps").distinct())
    sums, spectrum = fit_spectrum(fit, d)
    n = spectrum.n
    start = spectrum.vectors[:, ::-1][:, : min(d, wanted + GUARD)]
    values, vectors, trace = refine(fit, n, sums, start, wanted)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(wanted)] < 0, -1, 1)
    varies = values > d * EPS * max(values[0], trace * EPS)
    scale = vectors[:, varies] / np.sqrt(values[varies])
    error = None
    if varies.any():
        square = _added(fit, lambda c: ((c @ scale).T @ (c @ scale)).ravel(), n, sums)
        k = int(varies.sum())
        error = float(np.abs(np.array([square[i] for i in range(k * k)]).reshape(k, k) / n - np.eye(k)).max())
    explained = [float(v / trace) if trace > 0 else None for v in np.where(varies, values, 0.0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                off = _centred(_matrix(batch.column("steps")), n, sums)
                deviation = _squares(off)
                white = np.full((len(off), wanted), np.nan)
                white[:, varies] = (off.astype(float) / n) @ scale
                each = pa.array(np.repeat(np.arange(len(off)), wanted))
                tiled = lambda column, kind: pa.array(list(column) * len(off), kind)
                arrays = [
                    batch.column("image_id").take(each),
                    batch.column("box_id").take(each),
                    tiled(range(1, wanted + 1), pa.int32()),
                    pa.array(np.full(len(each), n)),
                    pa.array(deviation, pa.int64()).take(each),
                    pa.array(white.ravel(), from_pandas=True),
                    tiled(explained, pa.float64()),
                    tiled([error] * wanted, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["image_id", "box_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def _squares(off: np.ndarray) -> list:
    if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in off]
    return [v if v < 1 << 63 else None for v in exact]
