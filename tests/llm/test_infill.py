import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelark.llm import infill
from sievelark.llm import text as texts
from tests.llm.common import clashing, documents, odd_rows


def plain(doc_id, text, share=90, spm=20, seed=1):
    text, key = text or "", "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= share:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def odd():
    rows = odd_rows()
    rows += [(200 + k, t, "en", "s") for k, t in enumerate(
        ["a<P>b", "<S>", "x<M", "<P", ">tail", "<", "<M>" * 40, "\U0001f600" * 3000, "é", "a\x00b", "<<S", "P>", "<p>low</p>"] * 4)]
    return rows


def test_equals_the_plain_version(spark):
    rows = odd()
    made = infill.transform(documents(spark, rows))
    got = sorted((repr(r.doc_id), repr(r.text), tuple(r.infill)) for r in made.select("doc_id", "text", "infill").collect())
    assert got == sorted((repr(r[0]), repr(r[1]), plain(r[0], r[1])) for r in rows)
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}


def test_restores_every_text(spark):
    back = infill.restore(infill.transform(documents(spark, odd()), share=100).select("text", "infill.*"))
    assert all(r.restored == (r.text or "") for r in back.collect())


def test_digests(spark):
    rows = odd()
    got = sorted((repr(r.doc_id), r.output_sha256, r.restored_sha256, r.n) for r in infill.digests(documents(spark, rows)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted((repr(r[0]), sha(plain(r[0], r[1])[4]), sha(r[1] or ""), len(r[1] or "")) for r in rows)
    assert infill.digests(documents(spark, [])).count() == 0


def test_clashing_names(spark):
    docs = clashing(documents(spark, odd_rows()[:5]), "infill", "output", "form", "n", "h1", "restored")
    made = infill.transform(docs)
    assert {c for c in made.columns if c != "infill"} == {c for c in docs.columns if c != "infill"}
    assert made.filter(F.col("output") != "own output").count() == 0
    assert infill.digests(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@pytest.mark.parametrize("window", [4, 7, 64, 1 << 20])
def test_windows_change_nothing(monkeypatch, window):
    monkeypatch.setattr(infill, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(40):
        values = ["".join(rng.choice("ab<é中\U0001f600>PSM") for _ in range(rng.randrange(30))).replace("<P>", "").replace("<S>", "").replace("<M>", "")
                  for _ in range(rng.randrange(1, 12))]
        data, offsets = texts.text_bytes(pa.array(["pad", *values, "pad"], pa.large_string()).slice(1, len(values)))
        n = infill.code_points(data, offsets)
        assert n.tolist() == [len(v) for v in values]
        cuts = [sorted((rng.randrange(len(v) + 1), rng.randrange(len(v) + 1))) for v in values]
        form = np.array([rng.randrange(3) if v else 0 for v in values])
        at = infill.byte_places(data, offsets, (np.cumsum(n) - n)[:, None].repeat(2, 1).ravel() + np.array(cuts).ravel()).reshape(-1, 2)
        out, limits = infill.scatter(data, offsets, at[:, 0], at[:, 1], form)
        for k, (v, (a, b)) in enumerate(zip(values, cuts, strict=True)):
            want = (v, f"<P>{v[:a]}<S>{v[b:]}<M>{v[a:b]}", f"<S>{v[b:]}<P>{v[:a]}<M>{v[a:b]}")[form[k]]
            assert out[limits[k] : limits[k + 1]].tobytes().decode() == want
        back, ends = infill.gather(out, limits, form)
        assert [back[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == values


def test_an_output_without_its_markers_is_refused():
    data, offsets = texts.text_bytes(pa.array(["<P>a<S>b"], pa.large_string()))
    with pytest.raises(ValueError):
        infill.gather(data, offsets, np.array([infill.PSM]))
