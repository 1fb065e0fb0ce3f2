import random

from sievelark.llm import pages
from sievelark.llm.html import blocks

SCHEMA = "page_id long, url string, html string"


def found(spark, rows, schema=SCHEMA):
    return {r.page_id: (r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, schema)).collect()}


def text_of(page):
    return pages.main_text(blocks(page), set())


def test_structure_rules():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body class='has-sidebar'>"
            "<header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><!-- <p>no</p> --><div class='ad box'>Buy</div>"
            "<article><header><h1>Head&amp;line</h1></header><p><b>One &lt;two&gt;<br>three<p>Four\n  five&nbsp;six</p><div class=\"promo\">x</div>"
            "<form>f<input></form><aside>side</aside><ul><li>item</li></ul></article>"
            "<section id=comments><article class='comment'><p>first!</p></article></section><footer>&copy; me</footer></body></html>")
    assert text_of(page) == "Head&line\n\nOne <two> three\n\nFour five six\n\nitem"


def test_without_article():
    page = "<div id='cookie-notice'>We use</div><div role=navigation>nav</div><h1>A</h1>text <i>in</i>line<table><tr><td>c<td>d</table>"
    assert text_of(page) == "A\n\ntext inline\n\nc\n\nd"
    assert text_of(None) == text_of("") == text_of("<p> </p>") == ""
    assert text_of("<article>cut <b>short") == "cut short"
    assert text_of("a < b and <3 </nosuch> c") == "a < b and <3 c"


def site(n, body):
    return f"<div>Welcome to site</div><div>Sections: a b c</div>{''.join(f'<p>{p}</p>' for p in body)}<div>All rights reserved</div>"


def test_differencing(spark):
    rng = random.Random(1)
    body = {n: [f"paragraph {n} {k} {rng.random()}" for k in range(rng.randrange(2, 6))] for n in range(8)}
    rows = [(n, f"http://h.example/a/{n}?q=1", site(n, body[n])) for n in body]
    rows += [(50, "http://lone.example/", site(50, ["alone"])), (51, None, "<p>no url</p>"), (52, "http://h.example/z", None),
             (53, "not a url", "")]
    got = found(spark, rows)
    for n in body:
        assert got[n][0] == "\n\n".join(body[n]) and got[n][1] == len(got[n][0])
    assert got[50][0].startswith("Welcome") and got[51][0] == "no url" and got[52] == ("", 0) and got[53] == ("", 0)


def test_copies_prove_nothing(spark):
    text = ["one long paragraph of the page", "and another one"]
    rows = [(1, "http://h/a/1", site(1, text)), (2, "http://h/a/2", site(2, text)), (3, "http://h/a/3", site(3, ["quite another"]))]
    got = found(spark, rows)
    assert got[2][0] == "\n\n".join(text) and got[3][0] == "quite another"
    assert "\n\n".join(text) in got[1][0]


def test_articles_keep_shared_lines(spark):
    page = "<nav>m</nav><article><h1>{}</h1><p>A passage that many share.</p></article><footer>f</footer>"
    got = found(spark, [(n, f"http://h/{n}", page.format(n)) for n in range(4)])
    assert all(got[n][0] == f"{n}\n\nA passage that many share." for n in range(4))


def test_split_hosts_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(n, f"http://{'big' if n % 4 else 'small'}.example/p/{rng.randrange(10**6)}", site(n, [f"own {n} {rng.random()}"])) for n in range(60)]
    rows += [rows[0]]
    want = found(spark, rows)
    monkeypatch.setattr(pages, "GROUP_ROWS", 10)
    monkeypatch.setattr(pages, "BROADCAST_LINES", 0)
    assert found(spark, rows) == want
    assert all(text.startswith("own") for text, _ in want.values())


def test_empty_and_clashing(spark):
    assert found(spark, []) == {}
    rows = [(1, "http://h/1", "<p>a</p>", "own", "own")]
    assert found(spark, rows, SCHEMA + ", text string, key string") == {1: ("a", 1)}


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(16))] for _ in range(2))
        places = pages.common_lines(a, b)
        rest = iter(b)
        assert len(places) == longest(a, b) == len(set(places)) and all(any(x == a[p] for x in rest) for p in places)
    many = list(range(20_000))
    assert pages.common_lines(many, many[::2]) == many[::2]


def test_layout_names_are_no_furniture():
    for name in ("content has-sidebar", "no-sidebar", "with-ads", "widget-area", "search-results", "header-fixed"):
        page = f"<nav>m</nav><div class='{name}'><p>The text</p></div><p>and a much longer line behind it</p>"
        assert text_of(page) == "The text\n\nand a much longer line behind it", name
        assert text_of(page.replace("class", "id")) == text_of(page), name
    for name in ("sidebar", "site-footer", "cookie-notice", "box ad", "menu_left"):
        assert text_of(f"<div class='{name}'>x</div><p>text</p>") == "text", name


def test_marks_do_not_discard_the_body():
    assert text_of("<div class='sidebar'><p>m</p><article><p>Body</p></article></div><p>longer line outside of all that</p>").startswith("Body")
    assert text_of("<div class=widget><p>The whole page lies here.</p></div><p>short</p>") == "The whole page lies here.\n\nshort"
    assert text_of("<p>short</p><div id=comments><article><p>A much longer comment</p></article></div>") == "short"


def test_body_beside_teaser_articles(spark):
    rng = random.Random(5)
    body = {n: [f"body {n} {k} {rng.random()} of some length" for k in range(4)] for n in range(5)}
    cards = "<article>Most read</article><article>Latest</article>"
    got = found(spark, [(n, f"http://h/{n}", site(n, body[n]) + cards) for n in body])
    assert all(got[n][0] == "\n\n".join(body[n]) for n in body)


def test_unshared_lines_outside_an_article_stay(spark):
    page = "<div>Welcome to site</div><article><h1>{0}</h1><p>A passage that many share.</p></article><p>Correction {0}</p>"
    got = found(spark, [(n, f"http://h/{n}", page.format(n)) for n in range(4)])
    assert all(got[n][0] == f"{n}\n\nA passage that many share.\n\nCorrection {n}" for n in range(4))
