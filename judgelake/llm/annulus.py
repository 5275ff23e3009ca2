"""Centroid clustering by annulus search.

Centroids are sorted by norm. The distance to the two whose norms lie around a vector's own bounds the distance to its
nearest one, and by the triangle inequality that one's norm differs from the vector's by no more than the bound. Binary
search finds both ends of this annulus among the sorted norms, and the centroids in it are compared exactly, in whole
numbers, so that ties at the rim count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .whitening import LONG, as_matrix, finite, whole

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Numbers below this need no more than 64 bits for sums of squared differences over as many dimensions as here; others are Python's.
SMALL = 2**27
#: Entries beside the dimensions in a cluster's sums.
COUNT, INERTIA = -1, -2


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.number = np.argsort(_norms(centroids), kind="stable")
        self.sorted = centroids[self.number]
        self.norms = _norms(centroids)[self.number]

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first place of its annulus among the sorted centroids, and the place after the last."""
        norms, last = _norms(x), len(self.norms) - 1
        after = np.clip(np.searchsorted(self.norms, norms), 0, last)
        bound = np.sqrt(np.minimum(_squared(x, self.sorted[after]), _squared(x, self.sorted[np.maximum(after - 1, 0)])).astype(float))
        slack = 1e-9 * (norms + bound) + 1e-6  # for the rounding of norms: more candidates, never fewer
        return np.searchsorted(self.norms, norms - bound - slack), np.searchsorted(self.norms, norms + bound + slack, side="right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector: the number of its nearest centroid (of ties the smallest), the squared distance, and how many were compared."""
        if max(np.abs(x.astype(float)).max(initial=0), np.abs(self.sorted.astype(float)).max(initial=0)) >= SMALL:
            x, centroids = x.astype(object), self.sorted.astype(object)
        else:
            x, centroids = x.astype(np.int64), self.sorted.astype(np.int64)
        first, end = self.candidates(x)
        number, distance = np.full(len(x), len(centroids)), np.full(len(x), -1, dtype=x.dtype)
        for place in range(len(centroids)):
            rows = np.flatnonzero((first <= place) & (place < end))
            found = _squared(x[rows], centroids[place])
            best = (number[rows] == len(centroids)) | (found < distance[rows]) | ((found == distance[rows]) & (self.number[place] < number[rows]))
            number[rows[best]], distance[rows[best]] = self.number[place], found[best]
        return number, distance, end - first


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=1)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with exactly DIMENSIONS finite components, as floor(SCALE * component)."""
    v: Column = F.col(vector_col)
    kept = vectors.where(finite(v) & (F.size(v) == DIMENSIONS))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole(v, SCALE).alias("x"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest hash of their id, in its order; of one id's rows the smaller vector first, null ids last."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return _matrix([r["x"] for r in rows.orderBy(F.asc_nulls_last(key), "x").limit(clusters).collect()])


def _matrix(rows: list) -> np.ndarray:
    return np.array([[int(c) for c in r] for r in rows], dtype=object).reshape(len(rows), DIMENSIONS)


def cluster_sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """Per cluster: the sum of each dimension, COUNT and INERTIA (distances beyond the longs count as the largest long). Every
    task adds up its own rows first, so that a few rows a task and cluster are shuffled, whatever the clusters' sizes."""
    search = Annulus(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = as_matrix(batch.column(0), DIMENSIONS)
            number, distance, _ = search.nearest(x)
            large = len(x) * np.abs(x.astype(float)).max(initial=0) >= LONG
            for c in np.unique(number).tolist():
                own = x[number == c]
                sums = (own.astype(object) if large else own).sum(axis=0)
                more = [*map(int, sums), len(own), sum(min(int(d), LONG) for d in distance[number == c])]
                total[c] = total.get(c, 0) + np.array(more, dtype=object)
        if total:
            places = [*range(DIMENSIONS), COUNT, INERTIA]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(total), len(places)), pa.int32()), pa.array(places * len(total), pa.int32()), pa.array([Decimal(int(s)) for found in total.values() for s in found], pa.decimal128(38, 0))],
                ["cluster", "place", "s"],
            )

    found: dict[int, dict[int, int]] = {}
    for c, place, s in rows.select("x").mapInArrow(run, "cluster int, place int, s decimal(38,0)").groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect():
        found.setdefault(c, {})[place] = int(s)
    return found


def moved(centroids: np.ndarray, sums: dict[int, dict[int, int]]) -> np.ndarray:
    """Each centroid with vectors at their mean, rounded down; the others stay."""
    return _matrix([[sums[c][k] // sums[c][COUNT] for k in range(DIMENSIONS)] if c in sums else centroids[c] for c in range(len(centroids))])


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with a vector of DIMENSIONS finite components: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256, compared (how many centroids were in the annulus).

    Every round reads the table once and sends sums alone. Repeated rows count each; other vectors (null, of another
    length, with null or non-finite components) are left out; with fewer vectors than clusters there are as many clusters
    as vectors; an empty table gives no rows. Distances and sums beyond the longs are the largest long; comparisons stay
    exact. Other columns are never read.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    centroids = first_centroids(rows, clusters)
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(rows, centroids))
    search, sums = Annulus(centroids), cluster_sums(rows, centroids)
    inertia = {c: s[INERTIA] for c, s in sums.items()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, compared = search.nearest(as_matrix(batch.column(1), DIMENSIONS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(number, pa.int32()), pa.array([min(int(d), LONG) for d in distance], pa.int64()), pa.array([min(inertia[c], LONG) for c in number.tolist()], pa.int64()),
                    pa.array([names[c] for c in number.tolist()], pa.string()), pa.array(compared, pa.int32()),
                ],
                ["vec_id", "cluster", "distance", "cluster_inertia", "centroid_sha256", "compared"],
            )

    found = rows.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, centroid_sha256 string, compared int")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia"), "centroid_sha256", "compared")


def op13_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("compared")


def _oracle_sql() -> str:
    assigned = """SELECT rid, vec_id, x, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'k': k}}) AS m
        FROM kept, c{n} GROUP BY rid, vec_id, x"""
    steps = [
        """kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)""",
        "c0 AS MATERIALIZED (SELECT CAST(k AS INT) AS k, x AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM kept) WHERE k < 16)",
    ]
    for n in range(ROUNDS):
        steps += [
            f"a{n} AS MATERIALIZED ({assigned.format(n=n)})",
            f"""s{n} AS (SELECT k, i, sum(v) AS s, count(*) AS z FROM (SELECT m.k AS k, unnest(range(1, 65)) AS i, unnest(x) AS v FROM a{n}) GROUP BY k, i)""",
            f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(g.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
                SELECT k, list(CAST((s - ((s % z) + z) % z) // z AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY k) g ON g.k = c{n}.k)""",
        ]
    return f"""WITH {', '.join(steps)}, last AS MATERIALIZED ({assigned.format(n=ROUNDS)})
        SELECT vec_id, m.k AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM last JOIN c{ROUNDS} ON c{ROUNDS}.k = m.k"""


ORACLE_SQL = _oracle_sql()
