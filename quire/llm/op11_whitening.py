"""Embedding whitening: principal axes of a compensated covariance, and every vector in their coordinates.

The fit list holds each distinct vector once.  Its sums are exact integers.
Rows are centred, ``d = x - S/n``, as pairs of doubles (high part and what
rounding took from it), and only then multiplied.  Outer products are summed
without rounding: the pairs are cut into slices of so few bits that the
products of a block of rows add up exactly in double precision (an error-free
transformation of the matrix product), and block sums go into a double-double
total by two-sum.  Every task gives the high and low parts of its total, one
row of the matrix a record; records are merged by two-sum again, first in
many groups, then across them, so no group grows with the number of tasks.

The covariance, a matrix of d x d numbers whatever the input, is decomposed on
the driver by LAPACK's ``syevd``: Householder reduction to tridiagonal form,
then divide and conquer.  What double precision cannot hold of the covariance
corrects the eigenvalues (their Rayleigh quotients in the low part).

Defined results: rows whose vector is null or empty, or holds null, NaN or an
infinity are dropped; so are vectors of another length than the most frequent
one (of equally frequent ones the longest); entries are saturated to longs;
repeated rows each give their rows and count once in the fit; a null vec_id
stays null; an axis without variance has a null ``whitened`` and 0 for
``explained`` (null where nothing varies at all) and stays out of
``identity_error``; a deviation beyond a long is null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stage, table

COMPONENTS = 4
SCALE = 256
#: Rows of a block: the products of 21-bit slices of so many rows add up within 53 bits.
BLOCK, SLICE_BITS, SLICES = 1024, 21, 4
#: First-round groups of the merge of task totals.
MERGE_GROUPS = 256

Pair = tuple[np.ndarray, np.ndarray]


# ---------------------------------------------------------------- double-double arithmetic


def two_sum(a, b) -> Pair:
    """``a + b`` as a rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """Sum of two double-double numbers."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def quotient(numbers: list[int], n: int) -> Pair:
    """Integers divided by ``n`` as double-double numbers."""
    from fractions import Fraction

    high = np.array([float(Fraction(v, n)) for v in numbers])
    low = np.array([float(Fraction(v, n) - Fraction(h)) for v, h in zip(numbers, high.tolist())])
    return high, low


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """``x - mean`` as double-double numbers."""
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def slices(d: Pair) -> tuple[list[np.ndarray], int]:
    """Slices of ``d`` on falling grids of ``SLICE_BITS`` bits each; the first grid covers its largest entry."""
    top = int(np.frexp(np.abs(d[0]).max(initial=0.0))[1])
    high, low = d
    out = []
    for k in range(1, SLICES + 1):
        grid = np.ldexp(1.0, top - k * SLICE_BITS + k)  # a bit overlaps: what rounding leaves has either sign
        part = np.rint(high / grid) * grid
        high, low = two_sum(high - part, low)
        out.append(part)
    return out, top


def outer_sum(d: Pair) -> Pair:
    """Sum over rows of the outer product of ``d`` with itself, for at most ``BLOCK`` rows."""
    parts, _ = slices(d)
    width = d[0].shape[1]
    total = (np.zeros((width, width)), np.zeros((width, width)))
    for i in range(SLICES):
        for j in range(SLICES - i):
            total = add(total, (parts[i].T @ parts[j], 0.0))
    return total


# ---------------------------------------------------------------- passes over the fit list


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for b in batches:
            x = _matrix(b.column(0), width)
            n += len(x)
            if len(x) and np.abs(x.astype(np.float64)).max() * len(x) < 2.0**62:
                total = [t + v for t, v in zip(total, x.sum(axis=0).tolist())]
            else:
                total = [t + sum(c) for t, c in zip(total, x.T.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["at", "v"])

    rows = fit.select("x").mapInArrow(run, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    by = {r["at"]: int(r["v"]) for r in rows}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(width)]


def _merge(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Double-double sums of the records of each group."""
    import pandas as pd

    def one(key, part):
        high, low = np.stack(part["high"]), np.stack(part["low"])
        total = (np.zeros(high.shape[1]), np.zeros(high.shape[1]))
        for h, l in zip(high, low):
            total = add(total, (h, l))
        return pd.DataFrame({"slot": [0], "i": [key[-1]], "high": [total[0]], "low": [total[1]]})

    return rows.groupBy(*keys).applyInPandas(one, "slot int, i int, high array<double>, low array<double>")


def _second_moments(rows: DataFrame, width: int, mean: Pair, column: str) -> Pair:
    """Sum over ``rows`` of the outer products of ``column - mean``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, held = (np.zeros((width, width)), np.zeros((width, width))), False
        for b in batches:
            x = _matrix(b.column(0), width).astype(np.float64)
            for at in range(0, len(x), BLOCK):
                total, held = add(total, outer_sum(centred(x[at : at + BLOCK], mean))), True
        if held:
            slot = TaskContext.get().partitionId() % MERGE_GROUPS
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(list(total[0])), pa.array(list(total[1]))],
                names=["slot", "i", "high", "low"],
            )

    tasks = rows.select(column).mapInArrow(run, "slot int, i int, high array<double>, low array<double>")
    merged = _merge(_merge(tasks, ["slot", "i"]), ["i"]).collect()  # one record a dimension
    high, low = np.zeros((width, width)), np.zeros((width, width))
    for r in merged:
        high[r["i"]], low[r["i"]] = r["high"], r["low"]
    return high, low


class Whitening(NamedTuple):
    """A fitted transform: exact ``n`` and ``sums``, falling ``values``, ``axes`` as rows, ``trace`` of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """Standard deviation along each axis; NaN along those without variance."""
        least = np.finfo(float).eps * len(self.sums) * max(self.values[0], 0.0) if len(self.values) else 0.0
        return np.sqrt(np.where(self.values > least, self.values, np.nan))


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, whose vector has neither null nor non-finite entries."""
    c = F.col(column)
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    entry = lambda v: F.floor(v.cast("double") * SCALE).cast("long")
    return rows.where(c.isNotNull() & (F.size(c) > 0) & finite).withColumn("x", F.transform(c, entry))


def width_of(rows: DataFrame) -> int:
    """The most frequent length of ``x``, the longest of equally frequent ones; 0 without rows."""
    found = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    return found[0]["w"] if found else 0


def decompose(n: int, sums: list[int], moments: Pair) -> Whitening:
    """Axes by falling variance of the covariance ``moments / n``."""
    high = (moments[0] + moments[0].T) / 2
    low = ((moments[0] - high) + moments[1] + ((moments[0] - high) + moments[1]).T) / 2
    values, axes = np.linalg.eigh(high)
    # First-order correction by what the high part lacks.
    values = values + np.einsum("ik,ij,jk->k", axes, low, axes)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, sums, values[order] / n, axes[:, order].T, float(np.trace(high) + np.trace(low)) / n)


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct ``x`` once, staged; copies meet in map-side combines first."""
    return stage(vectors.select("x").distinct(), "whitening-fit")


def fit(distinct: DataFrame, width: int) -> Whitening:
    n, sums = _sums(distinct, width)
    return decompose(n, sums, _second_moments(distinct, width, quotient(sums, max(n, 1)), "x"))


def _coordinates(x: np.ndarray, w: Whitening, k: int) -> np.ndarray:
    """Whitened coordinates of rows along the first ``k`` axes."""
    high, low = centred(x.astype(np.float64), quotient(w.sums, w.n))
    return (high @ w.axes[:k].T + low @ w.axes[:k].T) / w.scales[:k]


def whitened(distinct: DataFrame, w: Whitening, k: int) -> DataFrame:
    """``y``: coordinates of each row along those of the first ``k`` axes that have variance."""
    use = int(np.isfinite(w.scales[:k]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _coordinates(_matrix(b.column(0), len(w.sums)), w, use)
            yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.float64()))], names=["y"])

    return distinct.select("x").mapInArrow(run, "y array<double>")


def identity_error(distinct: DataFrame, w: Whitening, k: int) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity; None without an axis."""
    use = int(np.isfinite(w.scales[:k]).sum())
    if not use:
        return None
    rows = whitened(distinct, w, k)
    means = rows.agg(*[F.avg(F.col("y")[i]).alias(f"m{i}") for i in range(use)]).first()
    high, low = _second_moments(rows, use, (np.array(list(means)), np.zeros(use)), "y")
    return float(np.abs((high + low) / w.n - np.eye(use)).max())


def project(vectors: DataFrame, w: Whitening, error: float | None, k: int = COMPONENTS) -> DataFrame:
    """The contract's rows for ``vectors(vec_id, x)``."""
    k = min(k, len(w.sums))
    explained = [None if w.trace <= 0 else max(float(v), 0.0) / w.trace for v in w.values[:k]]

    def deviations(x: np.ndarray) -> list[int | None]:
        sums = np.array(w.sums, dtype=object)
        if len(x) and (np.abs(x.astype(np.float64)).max() + max(map(abs, w.sums)) / w.n) * w.n < 2.0**62 / 2:
            d = x * np.int64(w.n) - np.array(w.sums, dtype=np.int64)
            if np.square(d.astype(np.float64)).sum(axis=1).max() < 2.0**62:
                return (d * d).sum(axis=1).tolist()
        found = [sum((int(v) * w.n - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), len(w.sums))
            y = _coordinates(x, w, k).ravel()
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)),
                    pa.array([d for d in deviations(x) for _ in range(k)], pa.int64()), pa.array(y, mask=np.isnan(y)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def whiten(rows: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every whole vector of ``rows``."""
    vectors = whole_vectors(rows, column)
    width = width_of(vectors)
    vectors = vectors.where(F.size("x") == width)
    distinct = fit_list(vectors)
    if not width:
        discard(distinct)
        return project(vectors, Whitening(1, [0], np.zeros(1), np.eye(1), 0.0), None, k)
    w = fit(distinct, width)
    error = identity_error(distinct, w, min(k, width))
    discard(distinct)
    return project(vectors, w, error, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
