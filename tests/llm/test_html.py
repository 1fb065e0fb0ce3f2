import random
import time

import pytest

from sievelark.llm import pages
from sievelark.llm.html import _careful_tags, blocks, decode_references, facts, tags

BROKEN = {
    "long reference": "<p>x &#" + "9" * 5000 + "; y</p>", "zeros": "<p>&#" + "0" * 6000 + "65;&#x" + "0" * 6000 + "42;</p>",
    "open tags": "<a " * 30_000, "open quotes": '<a "' * 25_000, "mixed quotes": "<a '\" " * 15_000, "crossed quotes": "<a x=\"'>" * 12_000,
    "stray ends": "<div>" * 10_000 + "</section>" * 10_000, "titles": "<title>" * 14_000, "nested marks": "<div class=ad>x" * 7_000,
    "comments": "<!--" * 25_000, "data": "<![CDATA[" * 11_000, "scripts": "<script>" * 12_000, "signs": "&" * 100_000, "ends": "</p>" * 25_000,
    "adverts": "<span class=ad>" * 5_000 + "</span>" * 5_000, "paragraphs": "<p>" * 33_000, "late end": "<a href='x" * 10_000 + ">",
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    page = BROKEN[name]
    start = time.perf_counter()
    blocks(page)
    facts(page)
    assert time.perf_counter() - start < 5  # some tenths of a second; growth with the square took minutes


def test_references():
    assert decode_references("&#65;&#x41;&#" + "0" * 5000 + "65;&amp;&#99999999999;&#xFFFFFFFFFF &lt &#1114112;") == "AAA&�� < �"
    assert blocks("<p>x &#" + "9" * 5000 + "; y</p>")[0].text == "x � y"


def test_random_tag_soup():
    """Nothing raises, text is never made up, and every plain word outside markup is found."""
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div class='ad'>", "<div>", "</div>", "<article>", "</article>", "<", ">", '"', "'", "<a href=\"x", "<!--", "-->", "<script>",
             "</script>", "<b class=\"ad box\">", "</b>", "&#", "&amp;", "word", " ", "é", "<title>", "</title", "=", "/", "<br/>", "<![CDATA[", "]]>", "<p "]
    for _ in range(1000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        found = blocks(page)
        assert sum(b.text.count("word") for b in found) <= page.count("word")
        assert all(b.text == " ".join(b.text.split()) and b.text for b in found)
        last = 0
        for tag in tags(page):
            assert last <= tag[0] < tag[1] <= len(page)
            last = tag[1]
        careful = list(_careful_tags(page, 0))
        assert list(tags(page)) == careful  # both ways read a page alike
        facts(page)
        pages.main_text(found, set())


def test_facts():
    page = ("<!doctype html><html class=x lang='pt-BR'><head><title>A &amp; B</title></head><a data-href=no href=\"/a?x=1&amp;y\">1</a>"
            "<a name=n>2</a><A HREF='b'>3</A><a href=c/>4</a><script><a href=no></script><!-- <a href=no> --><title>second</title>")
    assert facts(page) == ("A & B", "pt-BR", ["/a?x=1&y", "b", "c/"])
    assert facts("<title>never ends") == (None, None, []) == facts("")


@pytest.mark.parametrize("mark", ["p class='ad-hoc'", "p class='share-price'", "div class='social-science'", "section class='related work'",
                                  "p id='search-theory'", "p class='comment-on-policy'", "div class='menu of the day'"])
def test_subjects_in_articles_are_no_furniture(mark):
    page = f"<article><h1>Head</h1><{mark}>A part of the article.</{mark.split()[0]}><p>More text.</p></article>"
    assert pages.main_text(blocks(page), set()) == "Head\n\nA part of the article.\n\nMore text."


@pytest.mark.parametrize("mark", ["div class='ad'", "div class='ad box'", "div class='promo'", "div class='related'", "div class='share social'",
                                  "section id='comments'", "div class='comment-list'", "div class='user comments'", "aside", "form"])
def test_furniture_in_articles_goes(mark):
    page = f"<article><h1>Head</h1><p>Some text of the article.</p><{mark}>No part of it.</{mark.split()[0]}><p>More text.</p></article>"
    assert pages.main_text(blocks(page), set()) == "Head\n\nSome text of the article.\n\nMore text."


def test_inline_adverts():
    page = "<article><p>Hello <span class='advert'>Buy <span>very</span> now</span> wide <b class=x>world</b></p><p>Next <i class=ad>x</p><p>End</p></article>"
    assert pages.main_text(blocks(page), set()) == "Hello wide world\n\nNext\n\nEnd"
