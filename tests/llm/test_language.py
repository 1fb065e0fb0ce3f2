import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievelark.llm import language
from tests.llm.common import clashing, documents, odd_rows

PARTS = {"aa": "tion ing the er on at".split(), "bb": "ché eau ment ère oi ais".split(), "cc": "keit ung sch ein über ß".split()}


def made(rng, name, words):
    return " ".join("".join(rng.choice(PARTS[name]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(count=400, seed=1):
    rng = random.Random(seed)
    names = sorted(PARTS)
    return [(n, made(rng, names[n % 3], rng.randrange(3, 80)), names[n % 3], "s") for n in range(count)]


def test_held_out_accuracy(spark):
    docs = documents(spark, corpus())
    model = language.fit(language.learnable(docs))
    found = language.identify(docs, model).select("doc_id", "lang", language.held_out().alias("held_out"), "language.*").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {n for n in range(400) if zlib.crc32(str(n).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found) and np.mean([r.accepted for r in found]) > 0.97
    again = language.fit(language.learnable(docs.repartition(5)))
    assert np.array_equal(model.scores, again.scores) and model.temperature == again.temperature


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = documents(spark, corpus())
    changed = docs.withColumn("lang", F.when(language.held_out(), F.lit("aa")).otherwise(F.col("lang")))
    assert np.array_equal(language.fit(language.learnable(docs)).scores, language.fit(language.learnable(changed)).scores)


def test_odd_texts(spark):
    docs = clashing(documents(spark, odd_rows() + corpus(90)), "language", "score")
    model = language.fit(language.learnable(docs))
    rows = {r.doc_id: r for r in language.identify(docs, model).select("doc_id", "text", "language.*").collect()}
    for key in (100, 101, 102, 104):
        assert (rows[key].lang_pred, rows[key].score, rows[key].accepted) == ("und", 0.0, False)
    assert all(r.lang_pred in model.languages for k, r in rows.items() if k not in (100, 101, 102, 104, None))


def test_no_labels(spark):
    docs = documents(spark, [(1, "some text", None, None), (None, "more", "en", None)])
    assert language.fit(language.learnable(docs)) is None
    assert [r.lang_pred for r in language.identify(docs, None).select("language.*").collect()] == ["und", "und"]
    assert language.fit(language.learnable(documents(spark, []))) is None


def test_pieces_lose_no_gram(monkeypatch):
    column = pa.array(["Abc défg 1x " * 50, None, "", "ünïted  kingdom" * 30, "q" * 500])
    whole = sorted((o, b) for owner, buckets in language.gram_groups(column) for o, b in zip(owner.tolist(), buckets.tolist()))
    monkeypatch.setattr(language.texts, "GROUP_BYTES", 37)
    parts = sorted((o, b) for owner, buckets in language.gram_groups(column) for o, b in zip(owner.tolist(), buckets.tolist()))
    assert whole == parts and len(whole) > 1000


def test_probabilities_are_the_plain_average():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b", "c"], rng.standard_normal((language.BUCKETS, 3)).astype(np.float32), 1.5, 0.5)
    column = pa.array(["hello wide world", "x", None, "again and again"])
    got = model.probabilities(column)
    totals = {n: [] for n in range(4)}
    for owner, buckets in language.gram_groups(column):
        for o, b in zip(owner.tolist(), buckets.tolist()):
            totals[o].append(model.scores[b])
    for n, rows in totals.items():
        want = language.softmax(np.mean(rows, axis=0) / 1.5) if rows else np.zeros(3)
        assert np.allclose(got[n], want, atol=1e-5)


def test_calibration():
    logits = np.array([[4.0, 0], [3, 0], [0, 3], [0.2, 0], [0, 0.1], [0, 0.05]] * 20)
    labels = np.array([0, 0, 1, 1, 0, 0] * 20)
    temperature, threshold = language.calibrate(logits, labels, 0.01, 0.5)
    confidence = language.softmax(logits / temperature).max(axis=1)
    assert 0.5 < threshold <= confidence[:3].min() and threshold > confidence[3:6].max()
