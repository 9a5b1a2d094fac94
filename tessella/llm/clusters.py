"""Clustering of vectors around k centroids by Elkan's bounds, in whole numbers.

Every vector keeps its cluster, an upper bound of the distance to its centroid and k lower bounds of the distances to all
centroids. When centroids move, bounds move with them, and a distance is calculated only where neither a lower bound nor
half the distance between two centroids shows that another centroid is farther away. Upper bounds are rounded up, lower
ones down, and a centroid is skipped only if it is farther for certain, never if it may be as near; so ties go to the
smaller number as they do without bounds. Distances that decide are whole numbers and exact.

A round is one pass over the vectors, which travel with their bounds, and one aggregate of sums by cluster; only the
centroids (k times dims numbers, both parameters) meet on the driver. The table of a round is removed when the next is
complete.

Defined results: vectors with another number of components, with a null or with one that is not finite are left out;
components beyond LARGEST (squared distances would leave 64 bits) are an error; a null id is kept and comes last among
the seeds; rows that repeat an id are vectors of their own; fewer vectors than k make as many centroids; empty in, empty
out. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scratch

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
LARGEST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, upper float, lower array<float>"


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (floor(scale * x) of each component) of the vectors that are complete and finite."""
    v = F.col("embedding").cast("array<double>")
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    told = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))
    whole = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("int")).otherwise(told)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound).select("vec_id", F.transform(v, whole).alias("v"))


def seeds(table: DataFrame, k: int = K) -> list[list[int]]:
    """The vectors whose ids hash lowest, in that order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in table.orderBy(mark.asc_nulls_last(), "v").limit(k).collect()]


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a row, or to a row each."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """What all tasks of a round know: the centroids, halves of their distances (rounded down) and how far each has moved (rounded up)."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None = None) -> None:
        self.at = np.array(now, np.int64)
        self.half = _down(np.sqrt(np.array([squares(self.at, c) for c in self.at], np.float64)) / 2)
        self.moved = None if before is None else _up(np.sqrt(squares(self.at, np.array(before, np.int64)).astype(np.float64)))

    def start(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nothing known: cluster 0, no upper bound, lower bounds of zero."""
        return np.zeros(len(v), np.int32), np.full(len(v), np.inf, np.float32), np.zeros((len(v), len(self.at)), np.float32)

    def shift(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds after the centroids have moved."""
        return _up(upper.astype(np.float64) + self.moved[cluster]), _down(lower.astype(np.float64) - self.moved)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper, lower after a round, and how many distances it took."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        open_ = (lower <= upper[:, None]) & (self.half[cluster] <= upper[:, None])
        open_[np.arange(len(v)), cluster] = False
        rows = np.flatnonzero(open_.any(axis=1))  # all others keep their cluster, whatever their distance is
        if not len(rows):
            return cluster, upper, lower, 0
        x, a, low = v[rows].astype(np.int64), cluster[rows], lower[rows]
        best = squares(x, self.at[a])
        far = np.sqrt(best.astype(np.float64))
        up, low[np.arange(len(rows)), a] = _up(far), _down(far)
        taken = len(rows)
        for j in range(len(self.at)):
            may = np.flatnonzero((a != j) & (low[:, j] <= up) & (self.half[a, j] <= up))
            if not len(may):
                continue
            d = squares(x[may], self.at[j])
            taken += len(may)
            far = np.sqrt(d.astype(np.float64))
            low[may, j] = _down(far)
            won = (d < best[may]) | ((d == best[may]) & (j < a[may]))
            a[may[won]], best[may[won]], up[may[won]] = j, d[won], _up(far[won])
        cluster[rows], upper[rows], lower[rows] = a, up, low
        return cluster, upper, lower, taken

    def run(self, batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        k, dims = self.at.shape
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if "cluster" in b.schema.names:
                cluster = b.column("cluster").to_numpy()
                upper, lower = self.shift(cluster, b.column("upper").to_numpy(), b.column("lower").flatten().to_numpy().reshape(-1, k))
            else:
                cluster, upper, lower = self.start(v)
            cluster, upper, lower, _ = self.assign(v, cluster, upper, lower)
            if last:
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "cluster": cluster, "distance": squares(v, self.at[cluster])})
            else:
                ends = pa.array(np.arange(0, k * len(v) + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": b.column("v"), "cluster": cluster, "upper": upper, "lower": pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))})


def centre(state: DataFrame, before: list[list[int]]) -> list[list[int]]:
    """Floors of the means of the clusters; an empty cluster's centroid stays. Sums of whole numbers: exact, or an overflow error."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(len(before[0]))])
    found = {r.cluster: [r[f"s{i}"] // r.n for i in range(len(before[0]))] for r in sums.collect()}  # k rows at most
    return [found.get(j, c) for j, c in enumerate(before)]


def k_means(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance: squared) and the centroids after so many rounds of assigning and centring, and a last assignment."""
    spark = vectors.sparkSession
    state, path = scratch.written(whole_vectors(vectors, dims, scale), "vectors")
    at, before = seeds(state, k), None
    if not at:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for turn in range(rounds + 1):
        known, last = Bounds(at, before), turn == rounds
        done = state.mapInArrow(lambda b, known=known, last=last: known.run(b, last), "vec_id long, cluster int, distance long" if last else STATE)
        old = path
        state, path = scratch.written(done, f"round{turn}")
        scratch.remove(spark, old)
        if not last:
            at, before = centre(state, at), at
    return state, at


def cluster_digests(vectors: DataFrame) -> DataFrame:
    """The contract's columns: clusters with their inertia and digests of the final centroids."""
    spark = vectors.sparkSession
    out, at = k_means(vectors)
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    rows = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for j in sorted(sums)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
