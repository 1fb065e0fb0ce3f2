import random

from sievelark.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"

TALK = [
    (1, 0, "user", "Hello there.\nI have a question.\n\nHow do I join two tables?"),
    (1, 1, "assistant", "> How do I join   two TABLES?\n\nUse join()."),
    (1, 2, "user", "Ann wrote:\n>> How do I join two tables?\n> Use join().\nThanks, and skew?"),
    (1, 3, "assistant", "Unrelated."),
    (1, 4, "user", ">I have a question.\r\nYes?"),
    (1, 5, "user", "> never said\nno link"),
    (1, 6, "user", ""), (1, 7, "user", ">"), (1, 2049, "user", "x"), (1, 2050, "user", "> Unrelated.\n> > > deep"),
    (2, 0, "user", None), (2, 1, None, "> Hello there.\nother talk"), (None, 1, "user", "> a\nb"), (2, None, "user", "> Hello there."),
]


def found(spark, rows, **changes):
    return quotes.linked_conversations(spark.createDataFrame(rows, SCHEMA).withColumns(changes)).collect()


def test_links_threads_and_texts(spark):
    rows = {(r.conv_id, r.turn): r for r in found(spark, TALK)}
    assert len(rows) == len(TALK)
    links = {k: (r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked) for k, r in rows.items()}
    assert links[1, 1] == (0, 0, 1, 1, 1) and links[1, 2] == (1, 0, 2, 2, 2)
    assert links[1, 4] == (0, 0, 1, 1, 1) and links[1, 5] == (None, 5, 0, 1, 0)
    assert links[1, 2050] == (3, 3, 1, 2, 1) and links[2, 1] == (None, 1, 0, 1, 0)
    assert rows[1, 1].text == "Use join()." and rows[1, 2].text == "Thanks, and skew?" and rows[1, 4].text == "Yes?"
    assert rows[1, 0].text == TALK[0][3] and rows[2, 0].text is None and rows[1, 7].text == ""
    assert rows[1, 3].formatted == "<|assistant|>\nUnrelated.\n<|end|>"
    assert rows[2, 1].formatted.startswith("<|unknown|>")


def test_reply_order(spark):
    order = [(r.conv_id, r.turn) for r in found(spark, TALK) if r.conv_id == 1]
    assert order == [(1, n) for n in (0, 1, 2, 4, 3, 2050, 5, 6, 7, 2049)]


def test_no_quotes_gives_the_same_columns(spark):
    plain = found(spark, [(1, 1, "user", "b"), (1, 0, "user", "a > b")])
    assert [(r.turn, r.text, r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked) for r in plain] == [
        (0, "a > b", None, 0, 0, 0, 0), (1, "b", None, 1, 0, 0, 0)]
    assert plain[0].asDict().keys() == found(spark, TALK)[0].asDict().keys()
    assert found(spark, []) == []


def test_repeated_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = TALK[:2] + TALK[:2]
    got = found(spark, rows, row=F.lit("own"), thread=F.lit("own"), text2=F.lit(1))
    assert [(r.turn, r.reply_to) for r in got] == [(0, None), (0, None), (1, 0), (1, 0)]


def test_common_passage_in_a_long_conversation(spark, monkeypatch):
    """The latest earlier message is found across blocks, against a plain search."""
    monkeypatch.setattr(quotes, "BLOCK_TURNS", 8)
    rng = random.Random(2)
    rows = [(1, n, "user", f"> {rng.choice(['ok', 'fine', 'no'])}\nsaid {n}" if n % 3 == 0 else rng.choice(["ok", "fine", "no", "maybe"]))
            for n in range(120)]
    said = {n: t for _, n, _, t in rows if not t.startswith(">")}
    for r in found(spark, rows):
        text = dict((n, t) for _, n, _, t in rows)[r.turn]
        want = None
        if text.startswith(">"):
            wanted = text.split("\n")[0][2:]
            want = max((n for n, t in said.items() if n < r.turn and t == wanted), default=None)
        assert r.reply_to == want


def test_deep_threads(spark):
    rows = [(1, 0, "user", "start 0")] + [(1, n, "user", f"> start {n - 1}\nstart {n}") for n in range(1, 20)]
    assert {r.turn: (r.thread, r.depth) for r in found(spark, rows)} == {n: (0, n) for n in range(20)}


def test_long_text(spark):
    body = "\n".join(f"line {n}" for n in range(20_000))
    got = {r.turn: r for r in found(spark, [(1, 0, "user", body), (1, 1, "user", "> line 19999\n" + body)])}
    assert got[1].reply_to == 0 and got[1].text == body


def test_sentences_are_linked(spark):
    rows = [(1, 0, "user", "I like tea. Coffee is too strong for me. What about you?"), (1, 1, "assistant", "> Coffee is too strong for me.\nTry half of it."),
            (1, 2, "user", "> coffee is too\n> strong for me. What about you?\nI asked first! You know."), (1, 3, "user", "> Try half\nno whole sentence"),
            (1, 4, "assistant", "> What about you? Something else.\nhalf a quote"), (1, 5, "user", "> You know.\nDo I?")]
    got = {r.turn: (r.reply_to, r.n_quotes, r.n_linked) for r in found(spark, rows)}
    assert got == {0: (None, 0, 0), 1: (0, 1, 1), 2: (0, 1, 1), 3: (None, 1, 0), 4: (0, 1, 1), 5: (2, 1, 1)}


def test_no_python_on_the_main_path(spark):
    import re

    plan = quotes.linked_conversations(spark.createDataFrame(TALK, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
