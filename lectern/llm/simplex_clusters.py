"""Lloyd clustering of integer vectors, filtered by n-simplex projection.

Vectors are turned into integers, floor(scale * x). Each keeps its squared distances to ``PIVOTS`` pivots, computed once
and stored. In a round these become the coordinates of an apex over the simplex of the pivots: the distance of two
apexes is a lower bound of the distance of their vectors, and with one apex mirrored in the base it is an upper bound.
Centroids whose lower bound is beyond the smallest upper bound of a vector (by more than rounding can be) are not
candidates; all others are compared in integers, so the result is exact.

The first centroids are the ``k`` vectors with the smallest SHA-256 of ``1:<id>``. A round sums its vectors by cluster in
every task and then in one row for each cluster; k rows come to the driver, nothing that grows with the input.

Defined cases: vectors that are null, of another dimension, or hold a null, a NaN or an infinity are not kept; repeated
rows are vectors of their own, equal vectors have equal results; ties go to the smaller number of a centroid, those of
the first centroids' hashes (equal ids) to the smaller vector; a null id hashes as empty text; fewer than k vectors give
fewer centroids; centroids without vectors stay; an integer beyond ``LIMIT`` is an error, since squared distances
would not fit a long; very long texts don't occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

K, ROUNDS, PIVOTS, LIMIT = 16, 3, 8, 1 << 26
#: A pivot's height over the simplex of those before it, by its distance to the first: less would magnify rounding.
LEAST_HEIGHT = 0.05


def integers(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that are kept."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == dim)
    df = df.filter(F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    whole = F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e))
    within = F.forall("x", lambda e: F.abs(F.lit(float(scale)) * e) < LIMIT)
    checked = F.when(within, whole).otherwise(F.raise_error(F.concat(F.lit("a component is too large in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("without id")))))
    return df.select("vec_id", F.transform(checked, lambda e: e.cast("int")).alias("v"))


def first_by_hash(vectors: DataFrame, n: int) -> np.ndarray:
    """The n vectors with the smallest SHA-256 of "1:<id>", in that order."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(n).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Simplex:
    """The base of the projection: pivots, and their coordinates in a triangle matrix."""

    def __init__(self, pool: np.ndarray, most: int = PIVOTS):
        """Of the pool those are taken, in order, that stand high enough over the ones before."""
        taken, corners = [pool[0]], np.zeros((1, 0))
        for v in pool[1:]:
            if len(taken) == most:
                break
            squares = ((np.array(taken) - v) ** 2).sum(axis=1)
            if not squares[0]:
                continue
            inside, height = self._apex(corners, squares[None, :].astype(float))
            if height[0] ** 2 < LEAST_HEIGHT**2 * squares[0]:
                continue
            taken.append(v)
            corners = np.pad(corners, ((0, 0), (0, 1)))
            corners = np.vstack([corners, np.r_[inside[0], height[0]]])
        self.pivots, self.corners = np.array(taken), corners

    @staticmethod
    def _apex(corners: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates in the base, height) of points with these squared distances to the corners."""
        if corners.shape[1]:
            aim = (squares[:, :1] + (corners[1:] ** 2).sum(axis=1) - squares[:, 1:]) / 2
            inside = np.linalg.solve(corners[1:], aim.T).T
        else:
            inside = np.zeros((len(squares), 0))
        return inside, np.sqrt(np.maximum(squares[:, 0] - (inside**2).sum(axis=1), 0))

    def squares(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def candidates(self, squares: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """True where a centroid may be nearest to a vector with these squared distances to the pivots."""
        own = self.squares(centroids)
        inside, height = self._apex(self.corners, squares.astype(float))
        c_inside, c_height = self._apex(self.corners, own.astype(float))
        flat = np.zeros((len(squares), len(centroids)))
        for j in range(inside.shape[1]):
            flat += (inside[:, j, None] - c_inside[:, j]) ** 2
        lower = flat + (height[:, None] - c_height) ** 2
        upper = flat + (height[:, None] + c_height) ** 2
        # Far more than rounding makes of it, and far less than the distances that it tells apart.
        slack = 1e-6 * (1 + squares.max(axis=1, initial=0).astype(float) + own.max())
        return lower <= (upper.min(axis=1) + slack)[:, None]


def nearest(vectors: np.ndarray, squares: np.ndarray, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, integer comparisons made)."""
    may = simplex.candidates(squares, centroids)
    best, number = np.full(len(vectors), np.iinfo(np.int64).max), np.zeros(len(vectors), np.int32)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero(may[:, c])
        d = ((vectors[rows] - centroid) ** 2).sum(axis=1)
        closer = d < best[rows]
        best[rows[closer]], number[rows[closer]] = d[closer], c
    return number, best, int(may.sum())


def _matrix(column: pa.Array, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width).astype(np.int64)


def _distances(simplex: Simplex, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            squares = simplex.squares(_matrix(b.column(1), b.num_rows, dim))
            offsets = np.arange(0, squares.size + 1, squares.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(squares.ravel()))], ["vec_id", "v", "squares"])

    return run


def _sums(simplex: Simplex, centroids: np.ndarray):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, compared = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            vectors = _matrix(b.column(0), b.num_rows, dim)
            number, _, made = nearest(vectors, _matrix(b.column(1), b.num_rows, len(simplex.pivots)), simplex, centroids)
            compared += made
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += vectors[number == c].sum(axis=0)
        met = np.flatnonzero(count)
        if len(met):
            cells = np.arange(dim, dtype=np.int32)
            flat = [np.repeat(met.astype(np.int32), dim), np.tile(cells, len(met)), total[met].ravel(), np.repeat(count[met], dim), np.full(len(met) * dim, compared)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["cluster", "cell", "total", "n", "compared"])

    return run


def _assigned(simplex: Simplex, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _matrix(b.column(1), b.num_rows, centroids.shape[1])
            number, d, _ = nearest(vectors, _matrix(b.column(2), b.num_rows, len(simplex.pivots)), simplex, centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number), pa.array(d)], ["vec_id", "cluster", "distance"])

    return run


OUT = "vec_id long, cluster int, distance long"


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, stored; the final centroids)."""
    spark = df.sparkSession
    vectors = stored(integers(df, id_col, vector_col, dim, scale), "cluster_vectors")
    # A few more than k: they stand in as pivots where others lie in one plane.
    pool = first_by_hash(vectors, k + 4 * PIVOTS)
    if not len(pool):
        return spark.createDataFrame([], OUT), np.empty((0, dim), np.int64)
    simplex, centroids = Simplex(pool), pool[:k].copy()
    cached = stored(vectors.mapInArrow(_distances(simplex, dim), "vec_id long, v array<int>, squares array<long>"), "pivot_distances")
    for _ in range(rounds):
        sums = cached.select("v", "squares").mapInArrow(_sums(simplex, centroids), "cluster int, cell int, total long, n long, compared long")
        for r in sums.groupBy("cluster", "cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["cluster"], r["cell"]] = r["total"] // r["n"]
    return stored(cached.mapInArrow(_assigned(simplex, centroids), OUT), "clusters"), centroids


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector."""
    found, centroids = clustered(df, id_col, vector_col, dim, scale, k, rounds)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = sum(r["cluster_inertia"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(r["cluster"], r["cluster_inertia"], inertia, digests[r["cluster"]]) for r in sums]
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
