from collections import Counter

import corpus_pipeline
import __spark_entry__ as registered
import pytest

from sievelark.llm import queries
from tests.compare import connect, difference
from tests.conftest import SF
from tests.llm.common import clashing, documents, odd_rows
from tests.llm.test_language import corpus
from tests.llm.test_leaks import plain
from tests.llm.test_neardup import plain_classes


def test_registered():
    found = registered.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in found)] == list(range(1, 11)) and "pipeline" in found
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "token_files"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert difference(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_stages_take_effect(spark):
    docs = queries.table(spark, SF, "documents")
    before = [tuple(r) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, SF)
    assert kept.columns == docs.columns
    alive = [r for r in before if any(c.isalpha() for c in r[1] or "")]
    assert len(kept.collect()) >= 0.99 * len(alive)
    single = stage["near_duplicates"](spark, docs, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in plain_classes(before)})
    clean = stage["decontamination"](spark, docs, SF)
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
    bad = {key for key, *_ in plain(before, items)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in before if r[0] not in bad) and bad


def test_whole_run(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    assert found and all(r.n_tokens > 1 for r in found)
    assert max(Counter(r.doc_id for r in found).values()) <= 2
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_stages_on_odd_rows(spark):
    for rows in (odd_rows() + corpus(60), []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SF)
            assert name == "token_files" or result.columns == docs.columns
            result.count()


def test_columns_of_any_name_stay(spark):
    rows = odd_rows() + corpus(60)
    names = ["__language", "__matches", "__row", "__file", "__at", "__words", "__spans", "__id", "node", "check", "__own_node", "matches"]
    docs = clashing(documents(spark, rows), *names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, SF)
        assert result.columns == docs.columns, name
        kept = result.collect()
        assert kept and all(r[n] == f"own {n}" for r in kept for n in names), name


def test_two_runs_do_not_disturb_each_other(spark):
    docs = documents(spark, corpus(120))
    first = corpus_pipeline.STAGES[-1][1](spark, docs, "one")
    other = corpus_pipeline.STAGES[0][1](spark, docs, "two")
    corpus_pipeline.STAGES[1][1](spark, docs, "one")
    assert first.count() == 120 and other.count() > 0
