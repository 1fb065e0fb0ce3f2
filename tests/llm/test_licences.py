import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelark.llm import licences
from tests.llm.common import clashing, documents, odd_rows

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(words, phrases):
    for phrase, label in phrases.items():
        own = phrase.split()
        yield from ((k, label) for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own)


def plain(text):
    """What a text without expressions comes to."""
    words = words_of(text)
    base, notices = list(places(words, licences.PHRASES)), list(places(words, licences.NOTICES))
    starts, labels = [k for k, _ in base], {label for _, label in base}
    score = 1 - (1 - 0.8 * bool(base)) * (1 - 0.6 * bool(notices))
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {label for _, label in notices})), round(score, 9))


def rows_of(frame):
    return sorted((repr(r.doc_id), repr(r.text), (*tuple(r.licence)[:6], round(r.licence.score, 9))) for r in frame.collect())


def mixed_text(rng, count):
    voc = "under the mit License Apache LICENSE version 2 cc by nc sa gnu general public Über x 中 all rights reserved".split()
    return "".join(rng.choice(voc) + rng.choice([" ", "-", "\n", ", ", "", " -- ", "_"]) for _ in range(count))


def odd(seed=5):
    rng = random.Random(seed)
    rows = odd_rows()
    rows += [(300 + n, mixed_text(rng, rng.randrange(80)), "en", "s") for n in range(200)]
    rows += [(600, "Released under the MIT License.", None, None), (601, "Apache License, Version 2.0", None, None),
             (602, "cc by nc " * 20_000, None, None), (603, "under the mit license" * 3, None, None), (604, "CC-BY-NC", None, None),
             (605, "cc by nc by nc cc by nc", None, None), (606, "K under the mit license", None, None)]
    return rows


def test_equals_the_plain_version(spark):
    rows = odd()
    got = rows_of(licences.scan(documents(spark, rows)))
    assert got == sorted((repr(r[0]), repr(r[1]), plain(r[1])) for r in rows)
    assert max(g[2][1] for g in got) >= 20_000


@pytest.mark.parametrize("window", [3, 8, 61])
def test_windows_change_nothing(monkeypatch, window):
    def hits(values):
        batch = licences._Batch(pa.array(values, pa.string()), licences._automaton(
            tuple(licences.PHRASES.items()), tuple(licences.NOTICES.items()), tuple(licences.TAGS.items())))
        return batch.words.tolist(), sorted(map(repr, batch.hits))

    rng = random.Random(window)
    cases = [[rng.choice([None, "", mixed_text(rng, rng.randrange(40)), "x license: MIT"]) for _ in range(6)] for _ in range(40)]
    whole = [hits(c) for c in cases]
    monkeypatch.setattr(licences, "WINDOW", window)
    assert [hits(c) for c in cases] == whole


def read(text, only_known=True):
    data = text.encode()
    tokens = licences.expression_at(memoryview(data), 0, len(data), only_known)
    return (" ".join(tokens), licences.evaluate(tokens)) if tokens else ("", None)


@pytest.mark.parametrize("text, tokens, required, burden", [
    ("MIT", "mit", {"mit"}, 1),
    ("MIT OR Apache-2.0", "mit or apache-2.0", set(), 1),
    ("MIT AND Apache-2.0.", "mit and apache-2.0", {"mit", "apache-2"}, 1),
    ("GPL-3.0-only OR MIT AND AGPL-3.0", "gpl-3.0-only or mit and agpl-3.0", set(), 3),
    ("(GPL-3.0-only OR MIT) AND AGPL-3.0", "( gpl-3.0-only or mit ) and agpl-3.0", {"agpl"}, 4),
    ("GPL-2.0+ WITH Classpath-exception-2.0", "gpl-2.0+ with classpath-exception-2.0", {"gpl"}, 2),
    ("(MIT AND GPL-2.0) OR (MIT AND MPL-2.0)", "( mit and gpl-2.0 ) or ( mit and mpl-2.0 )", {"mit"}, 2),
    ("MIT/Apache-2.0", "mit or apache-2.0", set(), 1),
    ("MIT OR", "mit", {"mit"}, 1),
    ("MIT) OR GPL-3.0", "mit", {"mit"}, 1),
    ("MIT AND (GPL-3.0 OR", "mit", {"mit"}, 1),
    ("MIT and the rest is prose", "mit", {"mit"}, 1),
    ("see the file", "", None, None),
    ("OR MIT", "", None, None),
    ("()", "", None, None),
])
def test_expressions(text, tokens, required, burden):
    found, value = read(text)
    assert found == tokens
    assert value is None or (value.required, value.burden) == (required, burden)


def brute(tokens):
    """Ways to comply of a whole expression by recursive descent, and all its licences."""
    at = 0

    def unit():
        nonlocal at
        if tokens[at] == "(":
            at += 1
            ways = choice()
            at += 1
        else:
            ways = [{licences.label_of(tokens[at])}]
            at += 1
        return ways

    def both():
        nonlocal at
        ways = unit()
        while at < len(tokens) and tokens[at] == "and":
            at += 1
            other = unit()
            ways = [a | b for a in ways for b in other]
        return ways

    def choice():
        nonlocal at
        ways = both()
        while at < len(tokens) and tokens[at] == "or":
            at += 1
            ways = ways + both()
        return ways

    return choice()


def test_random_expressions_against_recursive_descent():
    rng = random.Random(8)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(["mit", "gpl-3.0", "apache-2.0", "mpl-2.0", "agpl-3.0", "cc0-1.0", "odd-thing"])]
        inner = made(depth - 1) + [rng.choice(["and", "or"])] + made(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(300):
        tokens = made(3)
        value, ways = licences.evaluate(tokens), brute(tokens)
        assert value.licences == {name for way in ways for name, _ in way}
        assert value.burden == min(max(k for _, k in way) for way in ways)
        assert all(value.required <= {n for n, _ in way} for way in ways)


def test_deep_and_long_expressions():
    assert read("(" * 50_000 + "MIT" + ")" * 50_000)[1].licences == {"mit"}
    assert len(read(" and ".join(f"x{k}" for k in range(20_000)), False)[1].licences) == 20_000


def test_tags_in_documents(spark):
    rows = [(1, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND X-own\ncode", "en", "s"), (2, '{"license": "GPL-3.0-or-later"}', "en", "s"),
            (3, "License: see below", "en", "s"), (4, "the licence of the shop", "en", "s"), (5, "x" * 2_000_000 + " License: MIT", "en", "s"),
            (6, "License", "en", "s"), (7, "SPDX-License-Identifier: MIT", None, None)]
    got = {r.doc_id: r for r in licences.licence_table(documents(spark, rows)).collect()}
    assert got[1].labels == "apache-2,mit,x-own" and got[1].burden == licences.UNKNOWN and got[1].n_expressions == 1
    assert (got[2].labels, got[2].burden, got[2].score) == ("gpl", 3, pytest.approx(0.9))
    assert [got[k].labels for k in (3, 4, 6)] == ["", "", ""] and [got[k].score for k in (3, 4, 6)] == [0, 0, 0]
    assert got[5].labels == got[7].labels == "mit" and got[7].base_labels == "" and got[7].first_word is None


def test_empty_and_clashing(spark):
    assert licences.licence_table(documents(spark, [])).count() == 0
    docs = clashing(documents(spark, odd_rows()[:4]), "licence", "labels", "score", "n_words")
    found = licences.scan(docs)
    assert set(found.columns) == set(docs.columns) and found.filter(F.col("labels") != "own labels").count() == 0
    assert licences.licence_table(docs).columns[:3] == ["doc_id", "n_words", "n_base"]
