"""Clustering around centroids with exact integers, by tables of squared differences.

Components become whole numbers floor(scale * x). A round sends the centroids (``k`` times the dimension) to the tasks.
A task tabulates, for each dimension, each value that occurs in its rows and each centroid, the squared difference; the
distance of a vector is then a sum of table rows picked by its components. One partial sum per cluster and task is
shuffled, whatever the number of vectors. Sums, centroids (floor of the exact mean) and inertias are whole numbers, so
the result does not depend on partitions or on the order of rows.

A vector of another length, or with a null or non-finite component, is left out. A component beyond ``LIMIT`` after
scaling counts as ``LIMIT``, so that distances fit a long. Repeated rows and repeated or null identifiers are vectors
of their own; the seed hash of a null identifier is that of an empty one. Seeds are taken in order of hash, then of
components; with fewer vectors than ``k`` there are fewer centroids, and an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.session import materialise

K, ROUNDS, DIMENSION, SCALE, SEED = 16, 3, 64, 64, 1
#: largest size of a component: squares of 64 differences of twice that still add up within a long
LIMIT = 1 << 27
#: Values from the smallest to the largest up to which a dimension's table has a row for each; beyond that the values
#: that occur are numbered first.
TABLE_ROWS = 4096
#: Vectors worked on at once.
BATCH = 8192


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of whole numbers."""
    vector = df[vector_col]
    # comparisons with infinity are false for null, and NaN counts as larger
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))).cast("long"), F.lit(LIMIT)), F.lit(-LIMIT)))
    return df.where((F.size(vector) == dimension) & finite).select(df[id_col].cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """Components of the ``k`` vectors with the smallest hash of ``seed:vec_id``, in order; ``k`` rows are fetched."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Tables:
    """Per dimension a table of squared differences: a row per value, a column per centroid.

    Tables of contiguous values are kept and grow with the values met; a dimension whose values lie far apart gets,
    for each batch, a row for each value that occurs in it.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.low = [0] * centroids.shape[1]
        self.made: list[np.ndarray] = [np.zeros((0, len(centroids)), np.int64)] * centroids.shape[1]

    def _squares(self, values: np.ndarray, d: int) -> np.ndarray:
        return (values[:, None] - self.centroids[None, :, d]) ** 2

    def _rows(self, values: np.ndarray, d: int) -> np.ndarray:
        low, high = int(values.min()), int(values.max())
        if len(self.made[d]):
            low, high = min(low, self.low[d]), max(high, self.low[d] + len(self.made[d]) - 1)
        if high - low >= TABLE_ROWS:
            occurring, at = np.unique(values, return_inverse=True)
            return self._squares(occurring, d)[at]
        if high - low + 1 > len(self.made[d]):
            self.low[d], self.made[d] = low, self._squares(np.arange(low, high + 1), d)
        return self.made[d][values - self.low[d]]

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances, a row per vector and a column per centroid."""
        total = np.zeros((len(vectors), len(self.centroids)), np.int64)
        for d in range(vectors.shape[1]):
            total += self._rows(vectors[:, d], d)
        return total


def _batches(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part.column("vec_id"), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def partial_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per task and cluster that it met: cluster, n, dim, total."""
    k, dimension = centroids.shape

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n, sums = Tables(centroids), np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for _, part in _batches(batches, dimension):
            nearest = tables.distances(part).argmin(axis=1)  # the first of equal ones
            n += np.bincount(nearest, minlength=k)
            for c in np.unique(nearest):
                sums[c] += part[nearest == c].sum(axis=0)
        met = np.flatnonzero(n)
        columns = [np.repeat(met, dimension), np.repeat(n[met], dimension), np.tile(np.arange(dimension), len(met)), sums[met].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "n", "dim", "total"])

    return vectors.mapInArrow(work, "cluster long, n long, dim long, total long")


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the exact mean of each cluster; a cluster without vectors stays where it is."""
    # sums over all tasks may pass a long; at most k times dimension rows come back
    summed = partial_sums(vectors, centroids).groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in summed.collect():
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(centroids)
        for ids, part in _batches(batches, centroids.shape[1]):
            distance = tables.distances(part)
            nearest = distance.argmin(axis=1)
            columns = [ids, pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(part)), nearest], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The vectors with their clusters after ``rounds`` rounds, and the centroids they were measured against."""
    vectors = materialise(whole_vectors(df, id_col, vector_col, dimension, scale), "whole-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    return materialise(assign(vectors, centroids), "clusters"), centroids


def report(df: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one row per kept vector."""
    found, centroids = cluster(df, **options)
    spark = df.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # one row per cluster in each of these: at most k
    total = inertia.agg(F.sum("own").alias("all"))
    sums = inertia.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total))
    sums = sums.select("cluster", F.col("own").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
