"""Nearest neighbours by inner product: inverted lists with an adaptive scan of the dimensions.

Largest inner product becomes least distance by one more component, ``sqrt(M^2 - |x|^2)`` with the largest norm ``M``
(0 for queries). k-means on a bounded sample gives the lists; every vector is put on the list of its nearest
centroid. A query probes as many lists as held the target share of true neighbours within the sample.

Vectors are rotated at random, so that a partial distance over the first ``d`` of ``D`` dimensions estimates the whole one.
Within a list, dimensions are scanned in column blocks of ``COLUMNS``; after each block a
candidate is abandoned if its estimate exceeds the query's bound by the factor ``(1 + EPSILON * sqrt((1 - d / D) / d))^2``, a test
of the hypothesis that it belongs to the result (the dimensions are drawn without replacement: the estimate gets surer as fewer are left). The bound is the distance of the query's (``BOUND_FACTOR`` k)-th neighbour in
the sample. What survives all blocks is ranked by the exact inner product of the original vectors. A query that
found fewer than k candidates is asked again, of all lists and without a bound.

A list is split into parts of about ``PART_ROWS``, so a list of any size is many units of work. A unit holds one part and
at most ``QUERY_ROWS`` of the queries that probe it, and passes on at most k candidates a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelark.plans.shared import write_shared

SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64_000_000
"""The fit sees about so many vectors at most, drawn by the hash of the id."""

COLUMNS = 16
EPSILON = 1.3
BOUND_FACTOR = 3
RECALL = 0.97
PART_ROWS = 2048
QUERY_ROWS = 1024
MOST_LISTS = 1024


@dataclass
class Index:
    dimension: int
    largest: float
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray

    def rotated(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        extra = np.zeros(len(vectors)) if queries else np.sqrt(
            np.maximum(self.largest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        return (np.hstack([vectors, extra[:, None]]) @ self.rotation).astype(np.float32)

    def every_list(self) -> "Index":
        return replace(self, probes=len(self.centroids), sample=self.sample[:0], sample_ids=self.sample_ids[:0])

    def nearest_lists(self, rotated: np.ndarray, count: int) -> np.ndarray:
        distance = (self.centroids**2).sum(axis=1)[None, :] - 2 * rotated @ self.centroids.T
        if count >= distance.shape[1]:
            return np.argsort(distance, axis=1, kind="stable")
        near = np.argpartition(distance, count - 1, axis=1)[:, :count]
        return np.sort(near, axis=1)

    def bounds(self, vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Inner product of each query's k-th neighbour in the sample, -inf if that has fewer."""
        found = vectors @ self.sample.T
        found[ids[:, None] == self.sample_ids[None, :]] = -np.inf
        if found.shape[1] < k:
            return np.full(len(vectors), -np.inf)
        return np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not NULL, all components finite, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _k_means(rows: np.ndarray, count: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centroids = rows[rng.choice(len(rows), count, replace=False)].copy()
    for _ in range(steps):
        nearest = np.concatenate([((centroids**2).sum(axis=1)[None, :] - 2 * part @ centroids.T).argmin(axis=1)
                                  for part in np.array_split(rows, max(1, len(rows) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        sizes = np.bincount(nearest, minlength=count)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
    return centroids


def fit(sample: np.ndarray, ids: np.ndarray, rows: int, largest: float, k: int, recall: float = RECALL, seed: int = 5) -> Index:
    """Rotation, lists and number of probes from a sample of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dimension + 1, dimension + 1)))[0]
    lists = int(min(MOST_LISTS, max(1, math.isqrt(rows)), max(1, len(sample) // 16)))
    index = Index(dimension, largest, rotation, np.zeros((1, dimension + 1)), 1, sample, ids)
    moved = index.rotated(sample, queries=False)
    index.centroids = _k_means(moved.astype(np.float64), lists, rng).astype(np.float32)
    home = index.nearest_lists(moved, 1)[:, 0]
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    found = sample[asked] @ sample.T
    found[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-found, axis=1)[:, : min(k, len(sample) - 1)]
    order = index.nearest_lists(index.rotated(sample[asked], queries=True), lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(asked), axis=0), axis=1)
    places = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    index.probes = int(places[min(len(places) - 1, int(recall * len(places)))]) + 1 if len(places) else 1
    return index


def scan(part: np.ndarray, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places whose squared distance was never rejected against ``limits``."""
    dimension = part.shape[1]
    columns = [np.ascontiguousarray(part[:, low : low + COLUMNS]) for low in range(0, dimension, COLUMNS)]
    seen = min(COLUMNS, dimension)
    head = queries[:, :seen]
    distance = (head**2).sum(axis=1)[:, None] + (columns[0] ** 2).sum(axis=1)[None, :] - 2 * head @ columns[0].T
    q, c = np.nonzero(distance * (dimension / seen) <= (limits * _slack(seen, dimension))[:, None])
    distance = distance[q, c]
    for block in columns[1:]:
        if not len(q):
            break
        low, seen = seen, seen + block.shape[1]
        difference = queries[q, low:seen] - block[c]
        distance = distance + np.einsum("ij,ij->i", difference, difference)
        kept = distance * (dimension / seen) <= limits[q] * _slack(seen, dimension)
        q, c, distance = q[kept], c[kept], distance[kept]
    return q, c


def _slack(seen: int, dimension: int) -> float:
    return 1.001 if seen >= dimension else (1 + EPSILON * math.sqrt((1 - seen / dimension) / seen)) ** 2


def _searched(index: Index, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list, part and kind (0 vectors, 1 queries): the best k of each unit for each query."""
    current, held, part = None, [], None

    def answer(ids, keys, vectors, bounds) -> pa.RecordBatch:
        own_ids, own, moved = part
        asked = index.rotated(vectors, queries=True)
        limits = np.einsum("ij,ij->i", vectors, vectors) + index.largest**2 - 2 * bounds
        limits = np.maximum(limits, 0) + 1e-5 * (1 + index.largest**2)
        out: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(2)]
        q, c = scan(moved, asked, limits.astype(np.float32))
        other = ids[q] != own_ids[c]
        q, c = q[other], c[other]
        scores = (vectors[q] * own[c]).sum(axis=1) if len(q) else np.zeros(0)
        order = np.lexsort((own_ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        first = np.searchsorted(q, q)
        out = np.flatnonzero(np.arange(len(q)) - first < k)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[q[out]]), pa.array(keys[q[out]]), pa.array(own_ids[c[out]]), pa.array(scores[out])],
            names=["query_id", "query_key", "vec_id", "score"])

    for batch in batches:
        lists, parts, kinds, ids, keys, bounds = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(6))
        vectors = _matrix(batch.column(6), index.dimension)
        unit = lists.astype(np.int64) << 32 | parts.astype(np.int64)
        change = np.flatnonzero((unit[1:] != unit[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), len(unit)], strict=True):
            if low == high:
                continue
            if unit[low] != current:
                current, held, part = unit[low], [], None
            if kinds[low] == 0:
                held.append((ids[low:high], vectors[low:high]))
                continue
            if part is None and held:
                own_ids, own = np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held])
                part, held = (own_ids, own, index.rotated(own, queries=False)), []
            if part is not None:
                for at in range(low, high, QUERY_ROWS):
                    some = slice(at, min(at + QUERY_ROWS, high))
                    yield answer(ids[some], keys[some], vectors[some], bounds[some])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            recall: float = RECALL, seed: int = 5) -> DataFrame:
    """The k nearest of each query found: query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``.

    NULL, zero or non-finite vectors and rows without an id take no part, nor do vectors whose length is not the most frequent one. Rows
    with the id of a query are never its candidates; a repeated query row is asked once; repeated candidates each count.
    With fewer than k candidates all are returned, an empty table gives an empty result. Only the two columns are read.
    """
    kind = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    shapes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"))
    shape = shapes.orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], kind)
    rows = rows.filter(F.size("vector") == shape.d)
    wanted = min(SAMPLE_ROWS, max(1024, SAMPLE_BYTES // (8 * shape.d)))
    share = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows if shape.n <= wanted else rows.filter(share < wanted / shape.n).orderBy(share, "vector").limit(2 * wanted)
    sample = sorted((r.vec_id, r.vector) for r in sample.collect())
    index = fit(np.array([v for _, v in sample]), np.array([i for i, _ in sample]), shape.n, shape.largest, k, recall, seed)
    sent = spark.sparkContext.broadcast(index)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            moved = own.rotated(_matrix(batch.column(1), own.dimension), queries=False)
            home = own.nearest_lists(moved, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *batch.columns], names=["list", "vec_id", "vector"])

    def probes(index: Index):
        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, len(batch), 512):
                    some = batch.slice(low, 512)
                    matrix, ids = _matrix(some.column(1), index.dimension), some.column(0).to_numpy()
                    lists = index.nearest_lists(index.rotated(matrix, queries=True), index.probes)
                    per = lists.shape[1]
                    at = pa.array(np.repeat(np.arange(len(some)), per))
                    bounds = np.repeat(index.bounds(matrix, ids, BOUND_FACTOR * k), per)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists.ravel().astype(np.int32)), some.column(0).take(at), some.column(1).take(at),
                         pa.array(bounds)], names=["list", "vec_id", "vector", "bound"])

        return probed

    homes = write_shared(rows.mapInArrow(assigned, "list int, vec_id long, vector array<double>"), "lists")
    sizes = homes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # a row a list, MOST_LISTS at most
    stored = homes.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id",
        F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("bound"), "vector")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"])

    def search(queries: DataFrame, everywhere: bool) -> DataFrame:
        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return probes(sent.value.every_list() if everywhere else sent.value)(batches)

        routes = queries.mapInArrow(routed, "list int, vec_id long, vector array<double>, bound double").join(sizes, "list")
        routes = routes.select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "vec_id",
            F.xxhash64("vector").alias("key"), "bound", "vector")
        units = stored.unionByName(routes).repartition("list", "part").sortWithinPartitions("list", "part", "kind", "vec_id")
        found = units.mapInArrow(lambda batches: _searched(sent.value, k, batches),
                                 "query_id long, query_key long, vec_id long, score double")
        best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    first = write_shared(search(asked, False), "nearest")
    full = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"))
    short = asked.withColumn("key", F.xxhash64("vector")).join(full, ["vec_id", "key"], "left_anti").select("vec_id", "vector")
    short = write_shared(short, "short")
    if not short.isEmpty():
        again = search(short, True)
        kept = first.join(full.withColumnRenamed("vec_id", "query_id").withColumnRenamed("key", "query_key"),
                          ["query_id", "query_key"], "left_semi")
        first = kept.unionByName(again)
    return first.select("query_id", "rank", "vec_id", "score")
