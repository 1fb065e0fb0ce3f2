import random
from collections import defaultdict

from sievelark.llm import neardup
from sievelark.llm.components import components
from tests.llm.common import clashing, documents, odd_rows, sentence, shingles


def plain_classes(rows):
    """(doc_id, class_id, n_links) by comparing all pairs of rows."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n, r in enumerate(rows):
        groups[find(n)].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], least[find(n)] if sets[n] else r[0], links[n]) for n, r in enumerate(rows)), key=str)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edited" + str(rng.randrange(10**6))
    return " ".join(words)


def family(rng, first, members, words, edits, text=None):
    text = text or sentence(rng, words)
    return [(first + n, edited(rng, text, rng.randrange(edits + 1)), "en", "s") for n in range(members)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_classes_match_all_pairs(spark):
    rng = random.Random(3)
    rows = odd_rows() + family(rng, 1000, 25, 200, 6) + family(rng, 2000, 12, 60, 2) + family(rng, 3000, 8, 9, 1)
    assert got(neardup.jaccard_classes(documents(spark, rows))) == plain_classes(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 10)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    rng = random.Random(4)
    rows = family(rng, 0, 60, 150, 5) + family(rng, 500, 3, 150, 1)
    assert got(neardup.jaccard_classes(clashing(documents(spark, rows), "node", "class_id"))) == plain_classes(rows)


def test_empty_and_wordless(spark):
    assert neardup.jaccard_classes(documents(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "", None, None), (3, "  ", None, None)]
    assert got(neardup.jaccard_classes(documents(spark, rows))) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_one_per_class(spark):
    rows = [(1, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (3, "z y x w v", "en", "s"),
            (3, "z y x w v", "en", "s"), (None, "q", None, None), (4, None, None, None), (5, None, None, None)]
    kept = neardup.one_per_class(clashing(documents(spark, rows), "class_id", "node"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, None]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "class_id", "node"]


def test_null_ids_link_like_others(spark):
    rng = random.Random(8)
    text = sentence(rng, 200)
    rows = [(None, text + " extra", "en", "s"), (None, text + " more extra", "en", "s"), (7, text, "en", "s"), (None, sentence(rng, 50), "en", "s"),
            (None, sentence(rng, 60), None, None)]
    found = got(neardup.jaccard_classes(documents(spark, rows)))
    assert found == sorted([(7, 7, 2), (None, 7, 2), (None, 7, 2), (None, None, 0), (None, None, 0)], key=str)
    kept = neardup.one_per_class(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(7, text), (0, rows[3][1]), (0, rows[4][1])])
    alone = neardup.one_per_class(documents(spark, rows[:2])).collect()
    assert len(alone) == 1 and alone[0].doc_id is None


def test_one_row_of_a_class_that_shares_an_id(spark):
    text = sentence(random.Random(9), 200)
    rows = [(1, text, "en", "s"), (1, text + " extra", "en", "s"), (2, text + " extra more", "en", "s"), (1, "quite another text of six words", "en", "s")]
    kept = sorted((r.doc_id, r.text) for r in neardup.one_per_class(documents(spark, rows)).collect())
    assert len(kept) == 2 and kept[1][0] == 1 and rows[3][1] in (kept[0][1], kept[1][1])


def test_components(spark):
    rng = random.Random(5)
    pairs = [(n + 1, n) for n in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(60)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(roots[n] == 0 for n in range(41))
    assert all(roots[a] == roots[b] for a, b in pairs if a != b)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bands():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999), (1.0, 0.99)):
        count, rows = neardup.bands(threshold, recall)
        assert count * rows <= neardup.MOST_HASHES
        assert 1 - (1 - threshold**rows) ** count >= recall - 1e-9
