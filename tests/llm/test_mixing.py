import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sievelark.llm import mixing
from tests.llm.common import clashing, documents, odd_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Targets by source, refilled until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / rest >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        full |= over


def test_report(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 32)
    monkeypatch.setattr(mixing, "PACK_ROWS", 50)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 300)
    rng = random.Random(1)
    rows = odd_rows() + [(1000 + n, sentence(rng, rng.randrange(1, 300)), "en", "s0" if n % 3 else f"s{n % 7}") for n in range(300)]
    docs = clashing(documents(spark, rows), "number", "size", "__row")
    got = mixing.mix_report(docs).collect()
    assert sorted(got, key=str) == sorted(mixing.mix_report(docs.repartition(3)).collect(), key=str)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    want = plain_targets(sizes)
    assert all(r.taken <= 2 * r["size"] for r in got)
    by_size = {}
    for r in got:
        by_size.setdefault((r.source_size, round(r.target, 6)), 0)
        by_size[r.source_size, round(r.target, 6)] += r.taken
    assert {k for k in by_size} == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (size, target), taken in by_size.items():
        assert abs(taken - target) <= 64 + 0.02 * target


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 256):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(2)).alias("p"),
                                     mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(3)).alias("q")).collect()
        assert sorted(r.p for r in rows) == sorted(r.q for r in rows) == list(range(n))
        assert n < 90 or [r.p for r in rows] != [r.q for r in rows]


def test_slots_fill_every_quota(spark):
    sized = mixing.sized_documents(mixing.placed_documents(documents(spark, odd_rows())))
    sources = mixing.targets(sized)
    placed = mixing.slots(sources).collect()
    assert Counter(r.number for r in placed) == Counter({r.number: r.quota for r in sources.collect() if r.quota})
    for number in {r.number for r in placed}:
        own = [r for r in placed if r.number == number]
        assert sorted(r.turn for r in own) == list(range(len(own)))
        assert max(Counter(r.block for r in own).values()) <= 2
        assert len({(r.use, r.block) for r in own}) == len(own)


def test_documents_hold_what_the_mix_takes(spark):
    rows = odd_rows()
    docs = clashing(documents(spark, rows), "use", "block", "__words")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, taken = Counter(), Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r.text
    for r in mixing.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    assert got == Counter({k: v for k, v in taken.items() if v})
    whole = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in mixed.filter("doc_id IS NOT NULL").collect():
        if len(WORD.findall(r.text)) == len(WORD.findall(whole[r.doc_id])):
            assert r.text == whole[r.doc_id].lstrip(" \t\n\v\f\r")


def test_empty(spark):
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "", None, "a")]
    assert [(r["size"], r.target, r.taken) for r in mixing.mix_report(documents(spark, rows)).collect()] == [(0, 0.0, 0)] * 2


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix_report(documents(spark, odd_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
