"""Embedding whitening by cyclic Jacobi.

Vectors become integers. The distinct ones are centred at their rounded mean and every task adds up the products of
its own; products and their sums are whole numbers, so that no order of adding changes them (below 2^53). The driver
turns the small covariance by symmetric Jacobi rotations until what is off the diagonal vanishes beside the diagonal,
which keeps small eigenvalues accurate. The sorted whitening matrix is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: The largest number of dimensions: the driver holds a square matrix of so many rows.
MOST_DIMENSIONS = 2048
#: Whole numbers of a component of 1.
SCALE = 256
#: Components of an eigenvalue below this share of the largest have no direction; they are given as null.
LEAST_SHARE = 1e-13
#: The largest value of a long.
LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether the vector is there and no entry is null, NaN or infinite."""
    inside = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & inside, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * entry) of each entry, as longs; beyond the longs the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def as_matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows whose vector is finite and as long as most of these are (the longer length of two that are as
    frequent); others are left out. Empty vectors have no components and are left out as well."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0)).select("vec_id", whole(F.col("v"), scale).alias("x"))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric matrix without negative eigenvalues.

    Rows are turned pair by pair, in cycles, while an entry counts beside the two diagonal entries it stands between.
    """
    a, turned = matrix.astype(float).copy(), np.eye(len(matrix))
    for _ in range(sweeps):
        quiet = True
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                off = a[p, q]
                if abs(off) <= 1e-16 * np.sqrt(abs(a[p, p] * a[q, q])) or abs(off) < 1e-300:
                    continue
                quiet = False
                slope = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, slope) / (abs(slope) + np.hypot(slope, 1.0))
                c = 1 / np.hypot(t, 1.0)
                turn = np.array([[c, -t * c], [t * c, c]])
                low, high = a[p, p] - t * off, a[q, q] + t * off
                a[[p, q]] = turn @ a[[p, q]]
                a[:, [p, q]] = a[[p, q]].T
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                turned[:, [p, q]] = turned[:, [p, q]] @ turn.T
        if quiet:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


@dataclass
class Whitening:
    """n distinct vectors with sums per dimension, eigenvalues and unit eigenvectors (columns) of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def matrix(self, components: int) -> np.ndarray:
        """dimensions x components; NaN where a component has no direction."""
        value = self.values[:components]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(value > LEAST_SHARE * self.values[0], self.vectors[:, :components] / np.sqrt(np.maximum(value, 0)), np.nan)

    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def explained(self, components: int) -> list[float]:
        total = float(self.values.sum())
        return [float(v) / total if total > 0 else 0.0 for v in self.values[:components]]


def _sums(distinct: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimensions, dtype=object)
        for batch in batches:
            x = as_matrix(batch.column(0), dimensions)
            small = len(x) * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) < LONG
            n, total = n + len(x), total + (x if small else x.astype(object)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array([n] * dimensions, pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["i", "n", "s"])

    rows = distinct.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _scatter(distinct: DataFrame, middle: list[int]) -> np.ndarray:
    """Sums of products of the entries less their middle; whole numbers, exact below 2^53."""
    d, centre = len(middle), np.array(middle, dtype=float)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            y = as_matrix(batch.column(0), d).astype(float) - centre
            total, seen = total + y.T @ y, seen or len(y) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"])

    out = np.zeros((d, d))
    for i, j, v in distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def fit(distinct: DataFrame) -> Whitening | None:
    """From distinct integer vectors (x) of one length; None without any."""
    first = distinct.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    if first["d"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    n, sums = _sums(distinct, first["d"])
    middle = [s // n for s in sums]
    rest = np.array([float(Fraction(s, n) - m) for s, m in zip(sums, middle, strict=True)])
    return Whitening(n, sums, *jacobi(_scatter(distinct, middle) / n - np.outer(rest, rest)))


def _projected(rows: DataFrame, model: Whitening, components: int, scores: str) -> DataFrame:
    """rows with vec_id and x: vec_id, component, deviation, whitened as rows, or scores (one column for each component)."""
    count = min(components, len(model.values))
    shared = rows.sparkSession.sparkContext.broadcast((model.matrix(count), model.mean(), np.array(model.sums, dtype=object), model.n))
    d = len(model.values)

    def deviations(x: np.ndarray) -> list[int | None]:
        _, _, sums, n = shared.value
        most = n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max(map(abs, sums))
        y = n * x - sums.astype(np.int64) if d * most * most < LONG else n * x.astype(object) - sums
        return [v if v <= LONG else None for v in map(int, (y * y).sum(axis=1))]

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, mean, _, _ = shared.value
        for batch in batches:
            found = (as_matrix(batch.column(0), d) - mean) @ matrix
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], [f"w{k}" for k in range(count)])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, mean, _, _ = shared.value
        for batch in batches:
            x = as_matrix(batch.column(1), d)
            at = pa.array(np.repeat(np.arange(len(x)), count))
            found = ((x - mean) @ matrix).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(deviations(x), pa.int64()).take(at), pa.array(found, mask=np.isnan(found))],
                ["vec_id", "component", "deviation", "whitened"],
            )

    if scores == "wide":
        return rows.select("x").mapInArrow(wide, ", ".join(f"w{k} double" for k in range(count)))
    return rows.select("vec_id", "x").mapInArrow(long, "vec_id long, component int, deviation long, whitened double")


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on the vectors. Components
    without a direction do not count; 0 if there are no others."""
    scores = _projected(distinct, model, components, "wide")
    there = [c for c, ok in zip(scores.columns, ~np.isnan(model.matrix(components)).any(axis=0), strict=True) if ok]
    if not there:
        return 0.0
    pairs = [(a, b) for k, a in enumerate(there) for b in there[k:]]
    found = scores.agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whitened(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """For each row with a finite vector and each component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit counts each distinct vector once. Repeated rows and null ids give rows like others; vectors of another
    length than most, empty, null and non-finite ones none; an empty table gives none. Components without variance have
    a null `whitened` (a table of one distinct vector has only such); deviations beyond the longs are null. Vectors with
    fewer dimensions have fewer components. Other columns are never read.
    """
    rows = whole_rows(vectors, id_col, vector_col, scale)
    distinct = written(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, model, components)
    share = F.array(*map(F.lit, model.explained(components)))
    return _projected(rows, model, components, "long").select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("component") - 1].alias("explained"), F.lit(error).alias("identity_error")
    )


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
