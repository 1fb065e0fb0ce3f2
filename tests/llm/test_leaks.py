import random

from sievelark.llm import leaks
from tests.llm.common import clashing, documents, odd_rows, sentence, shingles

ITEMS = "item_id long, text string"


def plain(rows, items):
    out = []
    for key, text, *_ in rows:
        words = [w for w in (text or "").lower().split()]
        for item, wanted in items:
            own = [w for w in (wanted or "").lower().split()]
            width = min(5, len(own))
            if not width:
                continue
            small = {" ".join(own[k : k + width]) for k in range(len(own) - width + 1)}
            big = {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}
            shared = len(small & big)
            if shared >= 0.8 * len(small) - 1e-9:
                out.append((key, item, shared, len(small)))
    return sorted(out, key=str)


def planted(seed=2):
    rng = random.Random(seed)
    items = [(n, sentence(rng, 3 + 5 * n)) for n in range(30)] + [(90, None), (91, ""), (92, "one"), (93, " "), (None, sentence(rng, 20))]
    rows = odd_rows()
    for n, (_, text) in enumerate(items):
        words = (text or "x").split()
        if len(words) > 12 and n % 3 == 0:
            words[len(words) // 2] = "changed"
        body = sentence(rng, 400) + "\n" + " ".join(words).title() + " \t" + sentence(rng, rng.choice([0, 3, 3000]))
        rows.append((500 + n, body, "en", "s"))
    return rows, items


def found(df):
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in df.collect()), key=str)


def test_all_pairs(spark):
    rows, items = planted()
    result = leaks.leaks(clashing(documents(spark, rows), "matches", "item_id"), spark.createDataFrame(items, ITEMS))
    assert found(result) == plain(rows, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 1500)
    rows, items = planted()
    result = leaks.leaks(documents(spark, rows), spark.createDataFrame(items, ITEMS))
    assert found(result) == plain(rows, items)


def test_without_leaks(spark):
    rows, items = planted()
    bad = {key for key, *_ in plain(rows, items)}
    docs = clashing(documents(spark, rows), "matches")
    kept = leaks.without_leaks(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert leaks.leaks(documents(spark, []), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
    assert leaks.without_leaks(documents(spark, odd_rows()), none).count() == len(odd_rows())


def test_hash_count_reaches_recall():
    for upper in (16, 64, 1024):
        size = upper // 2 + 1
        least = 0.8 * size / (2 * upper + size - 0.8 * size)
        assert (1 - least) ** leaks.hash_count(0.8, 0.9999, upper) <= 1e-4


def test_shingles_agree_with_the_plain_way():
    import pyarrow as pa

    from sievelark.llm import text as texts

    values = [r[1] for r in odd_rows()]
    counts = {}
    for first, hashes, sizes in texts.shingles(pa.array(values, pa.string())):
        for n, own in enumerate(texts.split(hashes, sizes)):
            counts[first + n] = len(set(own.tolist()))
    assert [counts[n] for n in range(len(values))] == [len(shingles(v)) for v in values]


def test_every_size_partition_has_enough_hash_functions():
    items = leaks.Items([(1, " ".join(f"w{n}" for n in range(40)))], leaks.THRESHOLD, leaks.RECALL)
    assert all(items.count >= leaks.hash_count(leaks.THRESHOLD, leaks.RECALL, leaks.SMALLEST << level) for level in range(20))


def test_repeated_items(spark):
    text = sentence(random.Random(4), 30)
    rows = [(1, "before " + text + " after", "en", "s"), (2, text[:40], "en", "s")]
    items = [(1, text), (1, text), (1, text + " and more of it that is only here"), (None, text), (None, text)]
    result = leaks.leaks(documents(spark, rows), spark.createDataFrame(items, ITEMS))
    assert found(result) == plain(rows, list(dict.fromkeys(items)))
    assert [r[1] for r in found(result)].count(None) == 1


def test_a_pass_for_each_block_of_items(spark, monkeypatch):
    rows, items = planted(7)
    whole = found(leaks.leaks(documents(spark, rows), spark.createDataFrame(items, ITEMS)))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 900)
    docs = clashing(documents(spark, rows), "__matches", "matches")
    assert found(leaks.leaks(documents(spark, rows), spark.createDataFrame(items, ITEMS))) == whole
    kept = leaks.without_leaks(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {w[0] for w in whole}
