import random

import numpy as np
from pyspark.sql import functions as F

from sievelark.llm import language, toxicity
from tests.llm.common import clashing, documents, odd_rows, sentence

BAD = ["vermin", "halfwit", "rotten", "cretin", "dunce"]


def labelled(seed=1, count=500):
    rng = random.Random(seed)
    rows, labels = [], []
    for n in range(count):
        words = "".join(c for c in sentence(rng, rng.randrange(20, 120)) if not c.isdigit()).split()
        toxic = n % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((n, " ".join(words), "en", "s"))
        if n % 5:
            labels.append((n, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = labelled()
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, language.learnable(known))
    found = toxicity.score(docs, model).select("doc_id", "toxicity", language.held_out().alias("held_out")).collect()
    held = [((r.toxicity >= toxicity.THRESHOLD), r.doc_id % 4 == 0) for r in found if r.held_out]
    assert np.mean([p for p, t in held if t]) > 0.9 and np.mean([p for p, t in held if not t]) < 0.05
    again = toxicity.fit(docs.repartition(3), language.learnable(known))
    assert (again.toxic, again.ordinary) == (model.toxic, model.ordinary) and np.allclose(again.weights, model.weights)


def test_odd_texts(spark):
    rows, labels = labelled(2, 200)
    known = spark.createDataFrame(labels + labels[:9] + [(None, 1), (3, None), (7, 5)], "doc_id long, toxic int")
    docs = clashing(documents(spark, rows), "toxic", "score")
    model = toxicity.fit(docs, known)
    odd = toxicity.score(clashing(documents(spark, odd_rows()), "toxicity", "features"), model)
    found = odd.select("doc_id", "text", "toxicity").collect()
    assert len(found) == len(odd_rows()) and all(0 <= r.toxicity <= 1 for r in found)
    assert len({r.toxicity for r in found if not (r.text or "").strip()}) == 1
    assert max(r.toxicity for r in found if not (r.text or "").strip()) < toxicity.THRESHOLD


def test_without_classes(spark):
    docs = documents(spark, odd_rows())
    assert toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")) is None
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.toxicity for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), None).count() == 0


def test_characteristic_words(spark):
    rows, labels = labelled()
    sample = documents(spark, rows).join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id").select("doc_id", "toxic", "text")
    assert {w for w, _ in toxicity.characteristic_words(sample)} == set(BAD)


def test_tiny_sample(spark):
    docs = documents(spark, [(1, "you vermin", "en", "s"), (2, "a fine day", "en", "s")])
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs.filter(F.col("doc_id") > 0), model).count() == 2


def test_rare_words_of_another_language_count(spark):
    rng, stems = random.Random(4), [f"schimpf{c}" for c in "abcdefghij"]
    rows, labels = labelled(4)
    for n in range(1000, 1300):
        words = [rng.choice(["haus", "baum", "strasse", "wasser", "himmel", "abend", "morgen"]) for _ in range(60)]
        if n % 4 == 0:
            words[rng.randrange(60)] = rng.choice(stems)
        rows.append((n, " ".join(words), "de", "s"))
        labels.append((n, int(n % 4 == 0)))
    sample = documents(spark, rows).join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id").select("doc_id", "toxic", "text")
    assert {w for w, _ in toxicity.characteristic_words(sample)} == {*BAD, *stems}
    learned, tested = toxicity._folds(sample, 2)
    assert learned.count() + tested.count() == len(labels) and learned.join(tested, "doc_id").count() == 0
