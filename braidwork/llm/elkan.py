"""Centroid clustering: k-means in whole numbers with Elkan's bounds.

A component x becomes floor(scale * x), so distances, sums and centroids are
whole numbers, and the result doesn't depend on how rows are dealt to tasks.

Every vector keeps an upper bound of its distance to its own centroid and a
lower bound of its distance to each of the k centroids.  When centroids move,
the bounds move with them by the distance moved.  A centroid c can't be nearer
than the vector's own centroid a if the upper bound is below c's lower bound, or
below half the distance of a and c: such distances aren't calculated.  Bounds are
rounded away from pruning and pruning is strict, so a centroid that may tie is
always calculated and the smaller number wins.

A round is one pass over a table of vectors and bounds in the shared folder
(Arrow batches, numpy), and one aggregation of their sums that leaves k x dims
numbers; only centroids, k x dims whole numbers, go to the driver and back to the
tasks.  A round's table replaces the one before.  A lost executor costs the tasks
that it worked on.

Defined results: rows whose vector is null, has another number of components, or
has a null or non-finite component are left out.  Starting centroids are the kept
vectors with the smallest SHA-256 of ``2:<key>``; rows of one key start in
the byte order of their components, a null key comes last.  Fewer vectors than k give as
many clusters.  Repeated rows are clustered each by itself; an empty centroid
stays where it is.  No vectors give an empty result.  Columns other than the key
and the vector aren't read, whatever their names.  A component of LARGEST or more
after scaling raises an error: squared distances would leave 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.shared import Written, bounded_batches

LARGEST = 1 << 27
#: Relative error of bounds in double precision, far above that of their few operations.
_SLACK = 1e-12


def _above(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not below x."""
    return np.nextafter((x * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = vectors - centroids
    return np.einsum("...i,...i->...", d, d)


class Centroids:
    """Centroids of a round, how far they moved since the last one, and half the distances between them."""

    def __init__(self, now: np.ndarray, was: np.ndarray | None = None):
        self.at = now
        self.moved = None if was is None else np.sqrt(squared(now, was).astype(np.float64)) * (1 + _SLACK)
        between = np.stack([squared(now, c) for c in now])
        self.half = _below(np.sqrt(between.astype(np.float64)) / 2)
        others = self.half + np.where(np.eye(len(now), dtype=bool), np.float32(np.inf), np.float32(0))
        self.nearest = others.min(axis=1)


def start(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) of vectors without bounds: all distances are calculated."""
    far = np.stack([squared(vectors, c) for c in centroids.at], axis=1)
    own = far.argmin(axis=1)
    root = np.sqrt(far.astype(np.float64))
    return own, _above(root[np.arange(len(own)), own]), _below(root)


def move(vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) once centroids have moved, and how many distances were calculated."""
    own = own.copy()
    upper = _above(upper.astype(np.float64) + centroids.moved[own])
    lower = np.maximum(_below(lower.astype(np.float64) - centroids.moved[None, :]), 0)
    k = len(centroids.at)
    # a vector whose bound is below half the distance to the nearest other centroid stays where it is
    rows = np.flatnonzero(upper >= centroids.nearest[own])
    may = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= centroids.half[own[rows]])
    may[np.arange(len(rows)), own[rows]] = False
    rows = rows[may.any(axis=1)]
    best = squared(vectors[rows], centroids.at[own[rows]])
    upper[rows] = _above(np.sqrt(best.astype(np.float64)))
    lower[rows, own[rows]] = _below(np.sqrt(best.astype(np.float64)))
    done = len(rows)
    for c in range(k):
        a, u = own[rows], upper[rows]
        at = np.flatnonzero((a != c) & (u >= lower[rows, c]) & (u >= centroids.half[a, c]))
        some = rows[at]
        far = squared(vectors[some], centroids.at[c])
        done += len(some)
        root = np.sqrt(far.astype(np.float64))
        lower[some, c] = _below(root)
        better = (far < best[at]) | ((far == best[at]) & (c < own[some]))
        best[at[better]], own[some[better]], upper[some[better]] = far[better], c, _above(root[better])
    return own, upper, lower, done


def _numbers(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def whole(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(key, v) of kept rows: components as 32-bit whole numbers in one binary."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").alias("key"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            if len(v) and np.abs(v).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST} or more after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(v.astype("<i4"))], names=["key", "v"])

    return bounded_batches(rows).mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("v", T.BinaryType())]))


def first_centroids(kept: DataFrame, k: int, dims: int) -> np.ndarray:
    """The k vectors with the smallest hash of their key, in its order: a bounded top-k."""
    hashed = kept.select(F.sha2(F.concat(F.lit("2:"), F.col("key").cast("string")).cast("binary"), 256).alias("hash"), "v")
    rows = hashed.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.v), "<i4") for r in rows], np.int64).reshape(-1, dims)


def sums(state: DataFrame, dims: int) -> DataFrame:
    """(cluster, n, total): size and componentwise sums; tasks add up their rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own, v = batch.column(0).to_numpy(), _numbers(batch.column(1), "<i4", dims).astype(np.int64)
            for c in np.unique(own).tolist():
                mine = v[own == c]
                total[c] = total.get(c, 0) + np.concatenate([[len(mine)], mine.sum(axis=0)])
        flat = [(c, j, x) for c, row in total.items() for j, x in enumerate(row.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "at", "x"])

    parts = bounded_batches(state.select("cluster", "v")).mapInArrow(run, "cluster int, at int, x bigint")
    return parts.groupBy("cluster", "at").agg(F.sum("x").alias("x"))


def moved_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Floors of the means of all clusters; empty ones stay. k x (dims + 1) rows come to the driver."""
    k, dims = now.shape
    found = np.zeros((k, dims + 1), np.int64)
    for r in sums(state, dims).collect():
        found[r.cluster, r["at"]] = r.x
    size = found[:, :1]
    return np.where(size > 0, found[:, 1:] // np.maximum(size, 1), now)


def assigned(state: DataFrame, centroids: Centroids, last: bool = False) -> DataFrame:
    """State (key, v, cluster, upper, lower) of vectors with or without bounds; if last (key, cluster, distance)."""
    k, dims = centroids.at.shape
    fresh = "lower" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _numbers(batch.column(1), "<i4", dims).astype(np.int64)
            if fresh:
                own, upper, lower = start(v, centroids)
            else:
                own, upper, lower = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _numbers(batch.column(4), "<f4", k)
                own, upper, lower, _ = move(v, own, upper, lower, centroids)
            cluster = pa.array(own.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), cluster, pa.array(squared(v, centroids.at[own]))], names=["key", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cluster, pa.array(upper), _binary(lower)], names=["key", "v", "cluster", "upper", "lower"])

    kinds = "cluster int, distance bigint" if last else "v binary, cluster int, upper float, lower binary"
    return bounded_batches(state).mapInArrow(run, T.StructType([state.schema["key"], *T.StructType.fromDDL(kinds).fields]))


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every kept vector, centroids as k rows of whole numbers).

    distance is the squared distance to the vector's own centroid.
    """
    state = Written(whole(vectors, key, vector, dims, scale), "vectors")
    now = first_centroids(state.df, k, dims)
    if not len(now):
        return state.df.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    was = None
    for _ in range(rounds):
        then, state = state, Written(assigned(state.df, Centroids(now, was)), "bounds")
        then.drop()
        was, now = now, moved_centroids(state.df, now)
    out = Written(assigned(state.df, Centroids(now, was), last=True), "clusters").df
    state.drop()
    return out.withColumnRenamed("key", key), now


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256; k rows are collected and broadcast."""
    spark = found.sparkSession
    each = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(each.values()), digest(centroids[c])) for c, s in each.items()]
    return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
