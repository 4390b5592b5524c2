"""Whitening of vectors by a covariance that is made of variances alone.

Polarisation: of two dimensions, var(a + b) = var(a) + var(b) + 2 cov(a, b).  So tasks aggregate
exact squared centred values of every dimension and of every sum of two dimensions, and the
differences of these variances are the covariances.  All of it is in whole numbers: an entry c is
x = floor(64 * c) + 1000000, a dimension with sum S over n rows is centred on the whole part of
S / n, and the fraction that is left over is taken out of the sums exactly.  The covariance is
rounded once, when it is assembled for ``eigh``.

What travels is D * (D + 1) / 2 sums a task, whatever the number of rows, and the fitted model
(D * D doubles) goes to every task: meant for dimensions up to about a thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components that are kept.
COMPONENTS = 32
#: Rows squared at once, so that a task holds few numbers.
BLOCK_ROWS = 4096
#: Eigenvalues below this share of the largest are rounding, not variance.
NOISE = 1e-11

SUM_SCHEMA = "a int, b int, total string"


@dataclass(frozen=True)
class Whitening:
    """A fitted model: n rows, sums by dimension, unit components in columns with their eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        """The whole parts of the means."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the whole parts leave of the means."""
        return np.array([s % self.n for s in self.sums], dtype=np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.whole) - self.rest / self.n
        return centred @ (self.components / np.sqrt(self.eigenvalues))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is there and has finite entries only."""
    number = F.col(column).cast("array<double>")
    finite = F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(column).isNotNull() & finite)


def whole_numbers(column: pa.Array, size: int | None = None) -> np.ndarray:
    """The rows of a list column as x-vectors; other lengths and entries that no long holds are an error."""
    lengths = np.diff(column.offsets.to_numpy())
    size = int(lengths[0]) if size is None and len(lengths) else size or 0
    if (lengths != size).any():
        raise ValueError("vectors of different dimensions")
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
    if len(entries) and np.abs(entries).max() >= 2.0**61:
        raise ValueError("an entry is too large for a long")
    return (np.floor(entries).astype(np.int64) + OFFSET).reshape(len(lengths), size)


def _fits(values: np.ndarray, terms: int) -> np.ndarray:
    """The values so that ``terms`` squares of them sum exactly: longs if they fit, else Python's integers."""
    most = int(np.abs(values).max()) if values.size else 0
    return values if most * most * terms < 2**62 else values.astype(object)


def square_sums(centred: np.ndarray) -> dict[tuple[int, int], int]:
    """(a, a): squares of a dimension; (a, b): squares of a sum of two; added up over the rows."""
    totals: dict[tuple[int, int], int] = {}
    size = centred.shape[1]
    for first in range(0, len(centred), BLOCK_ROWS):
        block = _fits(centred[first : first + BLOCK_ROWS], 4 * BLOCK_ROWS)
        for a in range(size):
            sums = block[:, a + 1 :] + block[:, a, None]
            pairs = (sums * sums).sum(axis=0) if block.dtype == object else np.einsum("rb,rb->b", sums, sums)
            own = (block[:, a] * block[:, a]).sum()
            for b, total in enumerate([own, *pairs], a):
                totals[a, b] = totals.get((a, b), 0) + int(total)
    return totals


def _summed(vectors: DataFrame, column: str, fold: Callable[[np.ndarray, dict], None]) -> dict[tuple[int, int], int]:
    """Whole-number totals over all rows: folded in each task, one row a key and task, added up by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        size = None
        for batch in batches:
            x = whole_numbers(batch.column(0), size)
            if len(x):
                size = x.shape[1]
                fold(x, totals)
        columns = [pa.array([k[0] for k in totals], pa.int32()), pa.array([k[1] for k in totals], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([str(v) for v in totals.values()], pa.string())], ["a", "b", "total"])

    rows = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(task, SUM_SCHEMA)
    totals = rows.groupBy("a", "b").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(a, b): int(total) for a, b, total in totals.collect()}


def _add(totals: dict, key: tuple[int, int], value: int) -> None:
    totals[key] = totals.get(key, 0) + value


def _fold_sums(x: np.ndarray, totals: dict) -> None:
    _add(totals, (-1, -1), len(x))
    _add(totals, (-1, x.shape[1]), 0)
    block = x if not x.size or int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object)
    for d, total in enumerate(block.sum(axis=0)):
        _add(totals, (0, d), int(total))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every row of ``usable(vectors)``; None if there are none.  Collects D * (D + 1) / 2 sums."""
    first = _summed(vectors, column, _fold_sums)
    n = first.pop((-1, -1), 0)
    sizes = [b for a, b in first if a == -1]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    if not n:
        return None
    size = sizes[0]
    sums = tuple(first[0, d] for d in range(size))
    whole = np.array([s // n for s in sums], dtype=np.int64)

    def fold(x: np.ndarray, totals: dict) -> None:
        for key, total in square_sums(x - whole).items():
            _add(totals, key, total)

    squares = _summed(vectors, column, fold)
    rest = [s % n for s in sums]

    def variance(a: int, b: int) -> int:
        """n * n times the variance of dimension a, or of the sum of a and b."""
        left = rest[a] if a == b else rest[a] + rest[b]
        return n * squares[a, b] - left * left

    covariance = np.zeros((size, size))
    for a in range(size):
        for b in range(a, size):
            twice = 2 * variance(a, a) if a == b else variance(a, b) - variance(a, a) - variance(b, b)
            covariance[a, b] = covariance[b, a] = float(Fraction(twice, 2 * n * n))
    return _model(n, sums, covariance, components)


def _model(n: int, sums: tuple[int, ...], covariance: np.ndarray, components: int) -> Whitening:
    values, vectors = np.linalg.eigh(covariance) if len(sums) else (np.zeros(0), np.zeros((0, 0)))
    falling = np.argsort(-values, kind="stable")[:components]
    if len(falling):
        falling = falling[values[falling] > max(NOISE * values.max(), 0)]
    vectors = vectors[:, falling]
    if vectors.size:  # the largest entry is positive, so that reruns agree
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors, values[falling], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    kept = len(model.eigenvalues)
    if not kept:
        return 0.0
    size = len(model.sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, met = np.zeros((kept, kept)), np.zeros(kept), 0
        for batch in batches:
            if batch.num_rows:
                white = model.whitened(whole_numbers(batch.column(0), size))
                products += white.T @ white
                sums += white.sum(axis=0)
                met += len(white)
        if met:
            values = np.vstack([products, sums])
            rows, columns = np.divmod(np.arange(values.size), kept)
            arrays = [pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(values.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "total"])

    rows = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(task, "a int, b int, total double")
    table = np.zeros((kept + 1, kept))
    for a, b, total in rows.groupBy("a", "b").agg(F.sum("total")).collect():
        table[a, b] = total
    means = table[kept] / model.n
    covariance = table[:kept] / model.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(kept)).max())


def transform(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Every row's id, exact deviation and whitened vector, as ``(vec_id, deviation, whitened array<double>)``.

    deviation is the sum over dimensions of (n * x - S) squared; one that no long holds is an error.
    """
    size = len(model.sums)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def deviations(x: np.ndarray) -> list[int]:
        centred = x - model.whole
        most = (int(np.abs(centred).max()) + 1) * model.n if centred.size else 0
        block = centred if most * most * max(size, 1) < 2**62 else centred.astype(object)
        away = block * model.n - model.rest
        found = (away * away).sum(axis=1).tolist()
        if any(d >= 2**63 for d in found):
            raise OverflowError("a deviation is too large for a long")
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(1), size)
            columns = [batch.column(0), pa.array(deviations(x), pa.int64())]
            columns.append(pa.array(list(model.whitened(x)), schema.field(2).type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(task, "vec_id long, deviation long, whitened array<double>")


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped.  Repeated rows and
    null ids stay and count; other columns are ignored.  Dimensions that never vary have no
    component, so equal rows, a single row, empty vectors and an empty table give no rows.  Vectors of
    different dimensions, and entries or deviations that no long holds, are an error.
    """
    kept = usable(vectors, column)
    model = fit(kept, column, components)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], ROWS)
    error = identity_error(kept, column, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    rows = transform(kept, model, id_column, column).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("k")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
