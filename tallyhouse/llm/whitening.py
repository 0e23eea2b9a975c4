"""Whitening embeddings by their leading principal components.

1. Every entry c becomes the whole number floor(256 c); the fit list holds each distinct vector once.
2. Tasks add up the fit list's sums exactly, then, with the exact mean at hand, the products of the centred vectors; one matrix of d x d
   numbers a task is added up row by row in two steps, so no task adds more than ``STEP`` matrices' rows or all tasks' at once.
3. The covariance is made tridiagonal by Householder reflections; bisection on the Sturm count finds its ``count`` largest eigenvalues, inverse iteration
   their vectors, made orthogonal again within clusters of close eigenvalues, and the reflections turn these back into components.
4. Mean and components go to the tasks that project all rows; a further pass measures how far the whitened fit list is from unit covariance.

The driver holds sums and matrices of d x d numbers only: at most ``MOST_DIMS`` dimensions and ``MOST_LENGTHS`` lengths of vectors are taken, more are refused.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; empty vectors have no components and so no rows; vectors of different length are fitted
apart; repeated vectors count once in the fit, and each of their rows is returned, also with a null vec_id; where a
component has no variance (``FLAT`` of the trace or less, as for a single vector) ``whitened`` is null, and it is left out of ``identity_error``, which is 0 if there is no other; ``explained`` is 0
without any variance; a deviation beyond a long is null; entries beyond 2^63 / 256 count as that; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_dir

SCALE, COUNT, MOST_DIMS, MOST_LENGTHS, FLAT = 256, 4, 4_096, 32, 1e-13
#: How many tasks' rows are added up at once, and how many vectors a product takes.
STEP, CHUNK = 128, 2_048
#: Of a matrix whose largest entry is 1, entries that cannot change a result; their squares would underflow.
NOTHING = 1e-60
#: Eigenvalues closer than this share of the largest form a cluster.
CLUSTER = 1e-3

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """What is known of the vectors of one length."""
    n: int
    sums: list[int]
    values: np.ndarray | None = None
    components: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x projected, divided by the deviation; not a number where there is none."""
        scale = np.sqrt(np.where(self.flat, np.nan, self.values))
        return (x - self.mean) @ self.components / scale

    @property
    def flat(self) -> np.ndarray:
        return self.values <= self.trace * FLAT


# The eigenvalues of one symmetric matrix

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of the tridiagonal form, and the unit normals of the Householder reflections (0: none)."""
    a, d = a.copy(), len(a)
    normals = []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        largest = np.max(np.abs(v))
        if largest <= NOTHING:
            v[:] = a[k + 1:, k] = a[k, k + 1:] = 0.0
        else:
            v /= largest
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            column = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
            a[k + 1:, k] = a[k, k + 1:] = column
        normals.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), normals


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """The Sturm count: how many eigenvalues lie below each of ``at``."""
    found = np.zeros(len(at), np.int64)
    q = np.ones(len(at))
    for i, x in enumerate(diagonal):
        q = x - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each by bisection."""
    d = len(diagonal)
    reach = np.abs(np.r_[off, 0.0]) + np.abs(np.r_[0.0, off])
    size = max(np.max(np.abs(diagonal) + reach), np.finfo(float).tiny)
    least = max(np.finfo(float).tiny, size * 1e-30)
    low, high = np.full(count, np.min(diagonal - reach) - 1e-15 * size), np.full(count, np.max(diagonal + reach) + 1e-15 * size)
    wanted = d - 1 - np.arange(count)
    while np.any(high - low > 4e-16 * np.maximum(np.maximum(np.abs(low), np.abs(high)), 1e-16 * size)):
        middle = (low + high) / 2
        above = below(diagonal, off, middle, least) <= wanted
        stuck = (middle <= low) | (middle >= high)
        low, high = np.where(above & ~stuck, middle, low), np.where(~above & ~stuck, middle, high)
        if stuck.all():
            break
        high = np.where(stuck, low, high)
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots of 0 count as ``least``."""
    d = len(diagonal)
    main, one, two = diagonal - shift, np.r_[off, 0.0], np.zeros(d)
    under, x = off.copy(), right.copy()
    for i in range(d - 1):
        if abs(under[i]) > abs(main[i]):
            main[i], under[i] = under[i], main[i]
            one[i], main[i + 1] = main[i + 1], one[i]
            two[i], one[i + 1] = one[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < least:
            main[i] = least
        factor = under[i] / main[i]
        main[i + 1] -= factor * one[i]
        one[i + 1] -= factor * two[i]
        x[i + 1] -= factor * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(d - 1, -1, -1):
        x[i] -= (one[i] * x[i + 1] if i + 1 < d else 0.0) + (two[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] /= main[i]
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal form as columns, by inverse iteration."""
    d, rng = len(diagonal), np.random.default_rng(1)
    size = max(np.max(np.abs(diagonal)), np.max(np.abs(off), initial=0.0), np.finfo(float).tiny)
    found, start, shift = np.zeros((d, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * size:
            start, shift = j, np.inf
        # Equal shifts would give equal vectors; they are kept apart by the last digits.
        shift = min(value, shift - 4e-16 * size)
        x = rng.standard_normal(d)
        for _ in range(6):
            x = solved(diagonal, off, shift, x / np.max(np.abs(x)), 1e-16 * size)
            x /= np.linalg.norm(x)
            for _ in range(3):
                x -= found[:, start:j] @ (found[:, start:j].T @ x)
                x /= np.linalg.norm(x)
        found[:, j] = x
    return found


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns, each with its largest entry above 0."""
    scale = np.max(np.abs(matrix))
    if not scale:
        return np.zeros(count), np.eye(len(matrix), count)
    diagonal, off, normals = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    found = vectors_of(diagonal, off, values)
    for k in range(len(normals) - 1, -1, -1):
        found[k + 1:] -= 2 * np.outer(normals[k], normals[k] @ found[k + 1:])
    found /= np.linalg.norm(found, axis=0)
    found *= np.sign(found[np.argmax(np.abs(found), axis=0), np.arange(count)])
    return values * scale, found


# Sums over the tasks

def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that count."""
    vectors = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.expr("forall(vector, c -> c IS NOT NULL AND abs(c) < double('Infinity'))")
    return vectors.where(F.col("vector").isNotNull() & sound & (F.size("vector") > 0)) \
        .select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors as a matrix), in chunks."""
    column = batch.column("x")
    sizes = np.asarray(column.value_lengths())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), CHUNK):
            some = rows[at:at + CHUNK]
            yield int(d), some, column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


def exact(x: np.ndarray) -> np.ndarray:
    """As Python numbers where sums of a chunk's numbers could pass 64 bits."""
    return x if len(x) == 0 or max(int(x.max()), -int(x.min())) < 1 << 50 else x.astype(object)


def adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple] = {}
    for batch in batches:
        for d, rows, x in by_length(batch):
            n, sums = total.get(d, (0, [0] * d))
            total[d] = n + len(rows), [s + int(a) for s, a in zip(sums, exact(x).sum(axis=0))]
    for d, (n, sums) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums])],
            ["d", "i", "n", "total"])


def fitted(vectors: DataFrame) -> dict[int, Fit]:
    """Count and sums by vector length."""
    lengths = [r["d"] for r in vectors.select(F.size("x").alias("d")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS or max(lengths, default=0) > MOST_DIMS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths of vectors or {MOST_DIMS} dimensions")
    sums = vectors.select("x").mapInArrow(adder, "d int, i int, n long, total string") \
        .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("d", "i").collect()
    out: dict[int, Fit] = {}
    for r in sums:
        out.setdefault(r["d"], Fit(r["n"], [])).sums.append(int(r["total"]))
    return out


def multiplier(fits: dict[int, Fit], whiten: bool):
    """One row of products, and the sums, of a task's centred or whitened vectors."""
    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                y = np.nan_to_num(fits[d].whitened(x)) if whiten else x - fits[d].mean
                products, sums = total.get(d, (0.0, 0.0))
                total[d] = products + y.T @ y, sums + y.sum(axis=0)
        for d, (products, sums) in total.items():
            k = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (k + 1), pa.int32()), pa.array(range(k + 1), pa.int32()),
                 pa.array([TaskContext.get().partitionId()] * (k + 1), pa.int32()), pa.array(list(products) + [sums], pa.list_(pa.float64()))],
                ["d", "i", "task", "row"])

    return multiplied


def row_sum(rows):
    """Rows of one place added up in the order of their tasks, so reruns agree."""
    import pandas as pd

    rows = rows.sort_values("task")
    return pd.DataFrame({"d": rows["d"].iloc[:1], "i": rows["i"].iloc[:1], "task": rows["task"].iloc[:1] // STEP, "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0)]})


def covariances(vectors: DataFrame, fits: dict[int, Fit], whiten: bool) -> dict[int, np.ndarray]:
    """The covariance by vector length, divisor n, of the vectors or their whitened forms."""
    kind = "d int, i int, task int, row array<double>"
    rows = vectors.select("x").mapInArrow(multiplier(fits, whiten), kind)
    for by in (F.floor(F.col("task") / STEP), F.lit(0)):
        rows = rows.groupBy("d", "i", by.alias("step")).applyInPandas(row_sum, kind)
    found: dict[int, dict] = {}
    for r in rows.collect():
        found.setdefault(r["d"], {})[r["i"]] = np.array(r["row"])
    out = {}
    for d, by_place in found.items():
        k, n = len(by_place) - 1, fits[d].n
        products, left = np.stack([by_place[i] for i in range(k)]), by_place[k]
        # ``left`` is what rounding of the mean leaves.
        out[d] = (products - np.outer(left, left) / n) / n
    return out


def projector(fits: dict[int, Fit]):
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for d, rows, x in by_length(batch):
                fit = fits[d]
                k, m = len(fit.values), len(rows)
                largest = max(int(x.max()), -int(x.min()), *(abs(s) for s in fit.sums)) + 1
                small = d * (2 * fit.n * largest) ** 2 < 1 << 62
                whole, sums = (x, np.array(fit.sums, np.int64)) if small else (x.astype(object), np.array(fit.sums, object))
                deviation = [int(v) if int(v) < 1 << 63 else None for v in ((fit.n * whole - sums) ** 2).sum(axis=1)]
                white = fit.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, fit.n)), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                     pa.array(white, mask=np.isnan(white)), pa.array(np.tile(fit.values / fit.trace if fit.trace else 0 * fit.values, m)),
                     pa.array(np.full(m * k, fit.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return projected


def whitened(embeddings: DataFrame, count: int = COUNT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row of embeddings (vec_id, embedding) and component."""
    spark, path = embeddings.sparkSession, run_dir(embeddings.sparkSession, "whitening")
    vectors = scaled(embeddings)
    vectors.select("x").distinct().write.parquet(path)
    fit_list = spark.read.schema("x array<bigint>").parquet(path)
    fits = fitted(fit_list)
    for d, matrix in covariances(fit_list, fits, False).items():
        fits[d].values, fits[d].components = leading(matrix, min(count, d))
        fits[d].trace = float(np.trace(matrix))
    for d, matrix in covariances(fit_list, fits, True).items():
        sound = ~fits[d].flat
        fits[d].identity_error = float(np.max(np.abs(matrix - np.eye(len(matrix)))[np.ix_(sound, sound)], initial=0.0))
    return vectors.mapInArrow(projector(fits), OUT)
