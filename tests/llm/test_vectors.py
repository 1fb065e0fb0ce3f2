import math
from collections import defaultdict

import numpy as np
import pytest

from sievelark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def plain(rows, k=20, every=20):
    known = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in known:
        if i % every == 0:
            scored = sorted(((-float((v * w).sum()), j) for j, w in known if j != i))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(rows, got):
    want = plain(rows)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in near}) for q, near in want.items())
    return hits / sum(len(n) for n in want.values())


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 1024)
    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24)) * 2
    rows = [(n, (centres[n % 12] + rng.standard_normal(24) * rng.uniform(0.3, 1)).tolist()) for n in range(3000)]
    got = found(vectors.nearest(table(spark, rows)))
    assert set(got) == {n for n in range(0, 3000, 20)} and all(len(v) == 20 for v in got.values())
    assert recall(rows, got) >= 0.9
    by_id = dict(rows)
    for q, near in got.items():
        for j, score in near:
            want = float((np.array(by_id[q], np.float32).astype(float) * np.array(by_id[j], np.float32).astype(float)).sum())
            assert math.isclose(score, want, rel_tol=0, abs_tol=1e-9)
        assert near == sorted(near, key=lambda n: (-n[1], n[0]))


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(n, rng.standard_normal(8).tolist()) for n in range(100)]
    bad = [(200, None), (220, [0.0] * 8), (240, [1.0] * 7 + [None]), (260, [float("nan")] * 8), (280, [float("inf")] * 8),
           (300, [1.0] * 5), (None, [1.0] * 8), (320, [])]
    got = found(vectors.nearest(table(spark, good + bad).withColumnsRenamed({"label": "score"})))
    assert set(got) == {0, 20, 40, 60, 80} and all(len(v) == 20 for v in got.values())
    assert recall(good, got) >= 0.9


def test_few_candidates_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [-1.0, 0.0])]
    got = found(vectors.nearest(table(spark, rows)))
    assert got[0] == [(3, 1.0), (5, 1.0), (20, 0.5), (7, -1.0)]
    assert [j for j, _ in got[20]] == [0, 3, 5, 7]
    assert vectors.nearest(table(spark, [])).count() == 0
    assert vectors.nearest(table(spark, [(0, [1.0])])).count() == 0
    assert vectors.nearest(table(spark, [(0, [0.0, 0.0])])).count() == 0


def test_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 64)
    rng = np.random.default_rng(3)
    common = rng.standard_normal(16).tolist()
    rows = [(n, common if n % 3 == 0 else rng.standard_normal(16).tolist()) for n in range(1500)]
    got = found(vectors.nearest(table(spark, rows)))
    near = [j for j, _ in got[60]]
    assert near == [n for n in range(0, 66, 3) if n != 60][:20]
    assert recall(rows, got) >= 0.9


def test_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(n, rng.standard_normal(6).tolist()) for n in range(60)]
    got = vectors.nearest(table(spark, rows + rows[:1] * 2)).filter("query_id = 0").collect()
    assert len(got) == 20 and 0 not in {r.vec_id for r in got}


@pytest.mark.parametrize("dimension", [3, 16, 40])
def test_scan_keeps_what_is_near(dimension):
    rng = np.random.default_rng(5)
    part, queries = rng.standard_normal((500, dimension)), rng.standard_normal((20, dimension))
    distance = ((part[None] - queries[:, None]) ** 2).sum(axis=2)
    limits = np.sort(distance, axis=1)[:, 20]
    q, c = vectors.scan(part.astype(np.float32), queries.astype(np.float32), limits.astype(np.float32))
    near = set(zip(*np.nonzero(distance < limits[:, None])))
    assert len(near & set(zip(q, c))) >= 0.95 * len(near)
    assert (distance[q, c] <= limits[q] * 1.002).all()
