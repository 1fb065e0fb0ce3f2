import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=40, rounds=5, dims=64, scale=256, seed=2):
    """Rows of the result, with Python integers alone."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < clusters.LARGEST
                                                              for x in vector):
            kept.append((vec_id, [math.floor(scale * x) for x in vector]))
    key = lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assigned()
        for n in range(len(centres)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f[1] == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assigned()
    total = sum(d for d, _ in found)
    return sorted(((i, n, d, sum(e for e, m in found if m == n), total,
                    hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, found, strict=True)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)


def result(frame):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def odd_vectors(count=150, dims=64, seed=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(6)]
    rows = [(n, [c + rng.gauss(0, 0.1) for c in rng.choice(centre)]) for n in range(count)]
    rows += [(500, None), (501, []), (502, [0.5] * (dims - 1)), (503, [0.5] * (dims + 1)), (504, [None] + [0.1] * (dims - 1)),
             (505, [math.nan] * dims), (506, [math.inf] + [0.0] * (dims - 1)), (507, [0.0] * dims), (508, rows[0][1]), (509, rows[0][1]),
             (None, rows[3][1]), (510, [1e300] + [0.0] * (dims - 1)), (511, [-7.25] * dims), rows[7], rows[7]]
    return rows


def test_equals_the_plain_version(spark):
    rows = odd_vectors()
    assert result(clusters.cluster_table(table(spark, rows).repartition(5))) == plain(rows)


def test_other_sizes_and_many_equal_vectors(spark):
    rows = [(n, [float(n % 3)] * 8) for n in range(60)]  # three values: most centroids are equal and stay empty
    got = result(clusters.cluster_table(table(spark, rows), k=10, rounds=3, dims=8, scale=10, seed=9))
    assert got == plain(rows, 10, 3, 8, 10, 9)
    with pytest.raises(ValueError):
        clusters.cluster_table(table(spark, rows), dims=12)


def test_few_and_no_vectors(spark):
    rows = odd_vectors()[:4]
    assert result(clusters.cluster_table(table(spark, rows))) == plain(rows)
    assert result(clusters.cluster_table(table(spark, []))) == []
    assert result(clusters.cluster_table(table(spark, [(1, None)]))) == []


def test_clashing_names(spark):
    rows = odd_vectors(20)
    extra = table(spark, rows).withColumns({n: F.lit("own") for n in ("cluster", "coefficients", "distance", "key", "vector")})
    assert result(clusters.cluster_table(extra)) == plain(rows)


@pytest.mark.parametrize("size", [1, 1 << 15, 1 << 18, 1 << 24])  # doubles, 64-bit integers, Python integers
def test_search_equals_all_distances(size):
    rng = np.random.default_rng(size)
    own = rng.integers(-4, 5, (300, 64)) * size
    centroids = np.concatenate([own[:20], own[:5], rng.integers(-4, 5, (15, 64)) * size])
    order = clusters.coarse_first(64)
    number, distance = clusters.nearest(clusters.hadamard(own)[:, order], clusters.hadamard(centroids)[:, order])
    every = ((own[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(axis=2)
    assert number.tolist() == every.argmin(axis=1).tolist()
    assert distance.tolist() == [64 * d for d in every.min(axis=1)]


def test_transform_is_exact_and_coarse_first():
    basis = clusters.hadamard(np.eye(64, dtype=np.int64))
    assert (basis @ basis == 64 * np.eye(64)).all()
    changes = (basis[:, 1:] != basis[:, :-1]).sum(axis=1)[clusters.coarse_first(64)]
    assert changes.tolist() == list(range(64))
