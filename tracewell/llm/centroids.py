"""Centroid clustering with an equal-average equal-variance search, in whole numbers.

Vectors are scaled and floored to integers, so sums, means and distances are exact
and no order of tasks changes a result. Centroids stand sorted by the sum of their
components. A vector starts where its own sum falls and goes outward, the nearer
side first. With d components, sums S and spreads V = sqrt(d * sum of squares - S^2),
a squared distance is never below (Sx - Sc)^2 / d, nor below
((Sx - Sc)^2 + (Vx - Vc)^2) / d. Where the first bound exceeds the best distance so
far, all that lie further out do too and the scan ends; where only the second does,
that centroid is passed over. What is left is decided by the integer distance, ties
by the smaller number.

A round reads the vectors once and gives one row per task and cluster, so the driver
holds clusters times components numbers, whatever the number of vectors. Vectors are
never moved.

Vectors that are null, have another number of components, or a component that is
null or not finite are left out. Of 64 components each must stay below 2^24 after
scaling, so that no sum of squares leaves 64 bits; others raise an error. Repeated rows are
each assigned, and may start two equal centroids, of which the smaller number then
takes all. A null id counts as an empty one where seeds are drawn. With fewer
vectors than clusters there are fewer centroids; an empty table gives an empty
result. Other columns are left out, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.storage import keep

MOST = 1 << 24  # a scaled component stays below, where there are 64 of them at most
SLICE = 8192  # vectors searched at a time


def scaled(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of each component."""
    most = MOST // max(1, -(-size // 64))
    def one(x: Column) -> Column:
        whole = F.floor(x.cast("double") * scale)
        return F.when(F.abs(whole) < most, whole).otherwise(F.raise_error(F.lit(f"components must stay below {most} after scaling by {scale}")))

    return F.transform(vector, one).cast("array<long>")


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the usable rows."""
    rows = vectors.filter(usable(F.col(vector_col), size))
    return rows.select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col), size, scale).alias("vector"))


def seeds(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the ids with the smallest digests; equal digests by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(clusters).collect()
    return np.array([r.vector for r in first], np.int64)


class Search:
    """Nearest centroids by sums, spreads and then integer distances."""

    def __init__(self, centroids: np.ndarray):
        self.size = centroids.shape[1]
        self.number = np.argsort(centroids.sum(axis=1), kind="stable")
        self.points = centroids[self.number]
        self.sums, self.spreads = self.marks(self.points)

    def marks(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = vectors.sum(axis=1)
        return sums, np.sqrt((self.size * np.einsum("ij,ij->i", vectors, vectors) - sums * sums).astype(np.float64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of and squared distance to the nearest centroid of each vector, and how many distances were computed."""
        n, m = len(vectors), len(self.points)
        sums, spreads = self.marks(vectors)
        best, label = np.full(n, ((1 << 63) - 1) // self.size), np.full(n, m)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        active, computed = np.arange(n), 0
        far = np.int64(1) << 31  # above every difference of sums
        for _ in range(m):
            lo, hi, own = left[active], right[active], sums[active]
            below = np.where(lo >= 0, own - self.sums[np.maximum(lo, 0)], far)
            above = np.where(hi < m, self.sums[np.minimum(hi, m - 1)] - own, far)
            go_left = below <= above
            gap = np.where(go_left, below, above)
            going = gap * gap <= self.size * best[active]
            active, go_left, gap = active[going], go_left[going], gap[going]
            if not len(active):
                break
            at = np.where(go_left, left[active], right[active])
            left[active] -= go_left
            right[active] += ~go_left
            total = spreads[active] + self.spreads[at]
            apart = np.maximum(np.abs(spreads[active] - self.spreads[at]) - 1e-14 * total, 0)  # never above the true difference
            near = (gap.astype(np.float64) ** 2 + apart ** 2) * (1 - 1e-12) <= self.size * best[active].astype(np.float64) * (1 + 1e-12)
            rows, at = active[near], at[near]
            computed += len(rows)
            apart = vectors[rows] - self.points[at]
            distance, number = np.einsum("ij,ij->i", apart, apart), self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < label[rows]))
            best[rows[better]], label[rows[better]] = distance[better], number[better]
        return label, best, computed


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, part.column("vector").flatten().to_numpy().reshape(-1, size)


def summed(rows: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Sums of the vectors of each non-empty cluster by component, and last their number."""
    m, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums = Search(centroids), np.zeros((m, size + 1), np.int64)
        for _, vectors in slices(batches, size):
            label, _, _ = search.nearest(vectors)
            order = np.argsort(label, kind="stable")
            found, first = np.unique(label[order], return_index=True)
            sums[found, :size] += np.add.reduceat(vectors[order], first, axis=0)
            sums[:, size] += np.bincount(label, minlength=m)
        cluster, at = np.divmod(np.arange(sums.size), size + 1)
        if sums[:, size].any():
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array(sums.ravel())], names=["cluster", "at", "s"])

    parts = rows.select("vector").mapInArrow(run, "cluster int, at int, s long")
    totals = parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x components numbers
    found = {c: [0] * (size + 1) for c in range(m)}
    for r in totals:
        found[r.cluster][r.at] = int(r.s)
    return {c: own for c, own in found.items() if own[size]}


def fit(rows: DataFrame, clusters: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centroids after ``rounds`` of assigning every vector and taking floored means; ``rows`` as of ``whole_vectors``."""
    centroids = seeds(rows, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, (*sums, n) in summed(rows, centroids).items():
            centroids[cluster] = [s // n for s in sums]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector, and the squared distance to it."""
    size = centroids.shape[1] if len(centroids) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for part, vectors in slices(batches, size):
            search = search or Search(centroids)
            label, distance, _ = search.nearest(vectors)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(label, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return (rows if size else rows.limit(0)).mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, size: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    rows = whole_vectors(vectors, size, scale)
    centroids = fit(rows, clusters, rounds, seed)
    placed = keep(assign(rows, centroids))
    total = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(c, total.get(c, 0), sum(total.values()), hashlib.sha256(",".join(map(str, point)).encode()).hexdigest()) for c, point in enumerate(centroids.tolist())]
    known = placed.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per cluster
