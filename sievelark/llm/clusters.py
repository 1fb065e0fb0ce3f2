"""Centroid clustering of integer vectors, exact, by a progressive search in Walsh-Hadamard space.

A vector becomes the integers ``floor(scale * x)``. Their Walsh-Hadamard transform is again made of integers, and squared
distances between transforms are ``dims`` times those between vectors, so sums, ties and centroids have no rounding.

Coefficients are kept from coarse to fine (by their number of sign changes). The search adds the squared differences of the first few
to all centroids, finishes the best of them, and drops every centroid whose sum so far is already larger than that finished
distance. What is left goes on to the next, finer group, until the survivors have all coefficients. A dropped centroid is strictly
worse than the finished one, so the nearest centroid, and among equals the smallest number, is always found.

Each round is one job over the stored transforms. A task adds up its own vectors by centroid, so a hot centroid is no hot key; the
driver sees ``k`` centroids of ``dims`` sums. The transform is linear, so the sums of coefficients give the sums of components.

- A vector that is NULL, of another length, or with a NULL or non-finite component takes no part, nor does one with a component
  of ``LARGEST`` / scale or beyond, whose transform would not fit 32 bits.
- Repeated rows are vectors of their own and get a row each. A NULL id counts as an empty text when first centroids are chosen.
  First centroids of equal hash (repeated ids) are ordered by their vectors.
- With fewer than ``k`` vectors each is a first centroid; an empty table has no rows in its result.
- Of two equal centroids the one with the larger number stays empty and keeps its place. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.plans.shared import write_shared

DIMS, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
GROUPS = (8, 8, 16, 16)
"""Coefficients of each step of the search; one more step takes all that are left."""

LARGEST = 1 << 25
_FLOAT, _SAFE = 1 << 22, 1 << 27
"""Coefficients below have squared distances that are exact as doubles, and as 64-bit integers; larger ones become Python integers."""

_SPARSE = 8
"""The search goes on by single pairs once fewer than one pair in so many is left."""

_ROWS = 4096


def hadamard(values: np.ndarray) -> np.ndarray:
    """The transform of each row, natural order, exact for integers. Applied twice it gives ``dims`` times the row."""
    out = values.copy()
    dims, half = values.shape[1], 1
    while half < dims:
        pairs = out.reshape(len(out), dims // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), dims)
        half *= 2
    return out


def coarse_first(dims: int) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their basis row."""
    basis = hadamard(np.eye(dims, dtype=np.int64))
    return np.argsort((basis[:, 1:] != basis[:, :-1]).sum(axis=1), kind="stable")


def nearest(own: np.ndarray, centroids: np.ndarray, groups: tuple[int, ...] = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the squared distance, both in coefficients from coarse to fine.

    Ties go to the smaller number.
    """
    rows, dims = own.shape
    largest = max(int(np.abs(own).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if largest < _FLOAT else np.int64 if largest < _SAFE else object  # each of them exact there
    own, centroids = own.astype(kind), centroids.astype(kind)
    everyone, low = np.arange(rows), 0
    row = number = partial = limit = None  # pairs of a row and a centroid that may still be its nearest
    dense, columns = np.zeros((rows, len(centroids)), dtype=kind), np.arange(len(centroids))
    for size in (*groups, dims):
        high = min(low + size, dims)
        if high == low:
            break
        if row is None:
            a, b = own[:, low:high], centroids[columns, low:high]
            dense = dense + ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))
            if limit is None:
                lead = dense.argmin(axis=1)  # its whole distance is a limit: what is above it cannot win
                limit = dense[everyone, lead] + ((own[:, high:] - centroids[lead, high:]) ** 2).sum(axis=1)
            alive = dense <= limit[:, None]
            if alive.sum() * _SPARSE < alive.size or high == dims:
                row, at = np.nonzero(alive)
                number, partial = columns[at], dense[row, at]
            else:
                used = alive.any(axis=0)
                dense, columns = dense[:, used], columns[used]
        else:
            partial = partial + ((own[row, low:high] - centroids[number, low:high]) ** 2).sum(axis=1)
            alive = partial <= limit[row]
            row, number, partial = row[alive], number[alive], partial[alive]
        low = high
    order = np.lexsort((number, partial if kind is not object else _ranks(partial), row))
    firsts = order[np.searchsorted(row[order], everyone)]
    distance = partial[firsts]
    return number[firsts], distance if kind is object else distance.astype(np.int64)


def _ranks(values: np.ndarray) -> np.ndarray:
    place = {v: n for n, v in enumerate(sorted(set(values.tolist())))}
    return np.array([place[v] for v in values.tolist()], dtype=np.int64)


def _kept(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and the integers of those."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths == dims)
    if not len(whole):
        return whole, np.zeros((0, dims), np.int64)
    values = column.take(pa.array(whole)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # NULL: NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * values)
        fits = (np.isfinite(scaled) & (np.abs(scaled) < LARGEST)).all(axis=1)
    return whole[fits], scaled[fits].astype(np.int64)


def transforms(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS,
               scale: int = SCALE) -> DataFrame:
    """(vec_id, coefficients) of the vectors that take part: 32-bit integers from coarse to fine."""
    if dims < 1 or dims & (dims - 1):
        raise ValueError("the number of components has to be a power of two")
    order = coarse_first(dims)

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for at in range(0, len(column), _ROWS):
                rows, values = _kept(column.slice(at, _ROWS), dims, scale)
                found = hadamard(values)[:, order].astype("<i4")
                limits = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (4 * dims))
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, limits.buffers()[1], pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, _ROWS).take(pa.array(rows)), packed],
                                                 names=["vec_id", "coefficients"])

    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return chosen.mapInArrow(transformed, "vec_id long, coefficients binary")


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, limits, data = column.buffers()
    if not len(column):
        return np.zeros((0, dims), np.int64)
    start = np.frombuffer(limits, np.int64)[column.offset]
    return np.frombuffer(data, "<i4", len(column) * dims, int(start)).reshape(-1, dims).astype(np.int64)


def _key(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


class Centroids:
    """Integer centroids, their transforms and the sums of a round."""

    def __init__(self, points: np.ndarray):
        self.dims = points.shape[1]
        self.points = points
        self.order = coarse_first(self.dims)
        self.coefficients = hadamard(points)[:, self.order]

    @classmethod
    def first(cls, stored: DataFrame, k: int, dims: int, seed: int) -> Centroids:
        rows = stored.select(_key(seed).alias("key"), "coefficients").orderBy("key", "coefficients").limit(k).collect()
        packed = np.array([np.frombuffer(r.coefficients, "<i4") for r in rows], dtype=np.int64).reshape(-1, dims)
        return cls(cls._components(packed, coarse_first(dims)))

    @staticmethod
    def _components(coefficients: np.ndarray, order: np.ndarray) -> np.ndarray:
        natural = np.empty_like(coefficients)
        natural[:, order] = coefficients
        return hadamard(natural) // coefficients.shape[1]

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
        """Each centroid at the floor of the mean of its vectors; one without vectors stays."""
        points = self.points.copy()
        for number, (count, total) in sums.items():
            whole = self._components(np.array([total], dtype=object), self.order)[0]  # Python integers: no overflow
            points[number] = [int(v) // count for v in whole]
        return Centroids(points)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points.tolist()]


def _round(stored: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of coefficients of each centroid's vectors, added up in the tasks first."""
    sent = stored.sparkSession.sparkContext.broadcast(centroids.coefficients)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums, counts = np.zeros(own.shape, np.int64), np.zeros(len(own), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = _rows(batch.column(0).slice(at, _ROWS), own.shape[1])
                number, _ = nearest(rows, own)
                counts += np.bincount(number, minlength=len(own))
                order = np.argsort(number, kind="stable")
                present, starts = np.unique(number[order], return_index=True)
                sums[present] += np.add.reduceat(rows[order], starts, axis=0)
        used = np.flatnonzero(counts)
        place = np.tile(np.arange(-1, own.shape[1]), len(used))  # -1: the count
        value = np.concatenate([counts[used, None], sums[used]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, own.shape[1] + 1).astype(np.int32)),
                                          pa.array(place.astype(np.int32)), pa.array(value)], names=["cluster", "place", "value"])

    parts = stored.select("coefficients").mapInArrow(added, "cluster int, place int, value long")
    found: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found.setdefault(row.cluster, {})[row.place] = int(row.value)
    return {c: (v[-1], [v[p] for p in range(len(v) - 1)]) for c, v in found.items()}


def assign(stored: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of each stored transform."""
    sent = stored.sparkSession.sparkContext.broadcast(centroids.coefficients)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                number, distance = nearest(_rows(batch.column(1).slice(at, _ROWS), own.shape[1]), own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, _ROWS), pa.array(number.astype(np.int32)),
                     pa.array((distance // own.shape[1]).astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(assigned, "vec_id long, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
                      dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, Centroids]:
    """``rounds`` times assignment and replacement, then the last assignment and the centroids it was made with.

    The first centroids are the ``k`` vectors whose ids have the smallest hashes. Transforms and the last assignment are
    written to the shared folder once.
    """
    stored = write_shared(transforms(vectors, vec_id, vector, dims, scale), "transforms")
    centroids = Centroids.first(stored, k, dims, seed)
    if not len(centroids.points):
        return stored.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = centroids.moved(_round(stored, centroids))
    return write_shared(assign(stored, centroids), "clusters"), centroids


def cluster_table(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia and inertia (NULL if beyond 64 bits), centroid_sha256."""
    assigned, centroids = centroid_clusters(vectors, **options)
    spark = assigned.sparkSession
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    sums = {r.cluster: int(r.own) for r in per_cluster.collect()}  # a row a centroid
    fits = [(c, d, n if n < 1 << 63 else None, total if total < 1 << 63 else None)
            for total in [sum(sums.values())] for c, d in enumerate(centroids.digests()) if (n := sums.get(c, 0)) is not None]
    figures = spark.createDataFrame(fits, "cluster int, centroid_sha256 string, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(figures), "cluster").select(  # a row a centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
