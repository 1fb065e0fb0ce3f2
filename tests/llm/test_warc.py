import gzip
import random
import time

from pyspark.sql import functions as F

from sievelark.llm import warc

PAGE = "<html lang=\"fr\"><head><title>A &amp; B</title></head><body><p>Un</p><p>deux <a href='/x?a=1&amp;b=2'>lien</a></p></body></html>"
SCHEMA = "page_id long, url string, html string"


def response(spark, rows):
    return warc.responses(spark.createDataFrame(rows, SCHEMA))


def headers(row):
    return {h.name: h.value for h in row.headers}


def test_derivatives(spark):
    source = response(spark, [(1, "http://h/1", PAGE)])
    first = source.first()
    meta, text = sorted(warc.build_derivatives(source, "page_id").collect(), key=lambda r: r.warc_type == "conversion")
    assert (meta.warc_type, text.warc_type) == ("metadata", "conversion")
    assert bytes(text.block).decode() == "Un\ndeux lien"
    assert "title: A & B\r\n" in bytes(meta.block).decode() and "outlink: /x?a=1&b=2\r\n" in bytes(meta.block).decode()
    assert "source-content-type: text/html; charset=utf-8\r\n" in bytes(meta.block).decode()
    for row in (meta, text):
        own = headers(row)
        assert own["WARC-Refers-To"] == row.refers_to == first.record_id and row.page_id == 1
        assert own["WARC-Refers-To-Payload-Digest"] == headers(first)["WARC-Payload-Digest"] == warc.digest(PAGE.encode())
        assert own["WARC-Refers-To-Block-Digest"] == warc.digest(bytes(first.block))
        assert own["WARC-Block-Digest"] == warc.digest(bytes(row.block)) and int(own["Content-Length"]) == len(row.block)
        assert own["WARC-Target-URI"] == "http://h/1" and own["WARC-Date"] == first.warc_date
    assert headers(text)["WARC-Concurrent-To"] == meta.record_id


def test_file_round_trip(spark, tmp_path):
    source = response(spark, [(n, f"http://h/{n}", PAGE * n) for n in range(5)])
    everything = source.drop("page_id").unionByName(warc.build_derivatives(source))
    members = [bytes(r.member) for r in warc.serialised(everything).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(m) for m in members))
    for name in ("a.warc.gz", "b.warc"):
        back = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert len(back) == 15
        assert {bytes(r.block) for r in back} == {bytes(r.block) for r in everything.collect()}
    made = warc.build_derivatives(warc.read_warc(spark, str(tmp_path / "a.warc.gz")))
    assert sorted(r.record_id for r in made.collect()) == sorted(r.record_id for r in everything.collect() if r.warc_type != "response")
    assert list(warc.parse(b"".join(members)[:-40]))[-1]["record_id"] is not None


def test_http_blocks():
    status, found, payload = warc.http_parts(b"HTTP/1.1 404 No\r\nA: b\r\n  c\r\nX-Y: z\r\n\r\nbody")
    assert (status, found, payload) == ("HTTP/1.1 404 No", [("A", "b c"), ("X-Y", "z")], b"body")
    assert warc.http_parts(b"plain") == ("", [], b"plain")
    assert warc.decoded([("Content-Type", "text/html; charset=latin-1")], "é".encode("latin-1")) == "é"
    assert warc.decoded([("Content-Encoding", "gzip")], gzip.compress(b"hi")) == "hi"
    assert warc.decoded([("Content-Type", "text/html; charset=nosuch")], b"hi") == "hi"
    assert warc.decoded([("Content-Encoding", "gzip")], b"not gzip") == "not gzip"


def test_odd_rows(spark):
    rows = [(1, "http://h/1", None), (2, None, ""), (None, None, None), (3, "http://h/3", PAGE), (3, "http://h/3", PAGE),
            (4, "http://h/4", "<p>" + "word " * 200_000)]
    got = warc.build_derivatives(response(spark, rows).withColumn("title", F.lit("own")), "page_id").collect()
    assert len(got) == 2 * len(rows)
    assert len({r.record_id for r in got if r.page_id == 3}) == 2
    assert [bytes(r.block) for r in got if r.warc_type == "conversion" and r.page_id in (1, 2)] == [b"", b""]
    assert warc.build_derivatives(response(spark, [])).count() == 0
    other = response(spark, rows[:1]).withColumn("warc_type", F.lit("request")).withColumn("block", F.lit(None).cast("binary"))
    assert warc.build_derivatives(other).count() == 0
    empty = response(spark, rows[:1]).withColumn("block", F.lit(None).cast("binary")).withColumn("record_id", F.lit(None).cast("string"))
    assert [r.refers_to for r in warc.build_derivatives(empty).collect()] == [None, None]


def test_native_digest(spark):
    for r in response(spark, [(n, "u", "é" * n) for n in range(6)]).collect():
        assert headers(r)["WARC-Payload-Digest"] == warc.digest(("é" * r.page_id).encode())


def plain_unchunked(sizes, text):
    out, at = b"", 0
    for n in sizes:
        out += f"{n:x};ext=1\r\n".encode() + text[at : at + n] + b"\r\n"
        at += n
    return out + b"0\r\nTrailer: x\r\n\r\n"


def test_chunked_transfer():
    text = b"<p>one</p>" * 50
    chunked = plain_unchunked([7, 100, len(text) - 107], text)
    assert warc.unchunked(chunked) == text and warc.unchunked(chunked[:60]) == text[: 60 - len("7;ext=1\r\n") - 2 - len("64;ext=1\r\n")]
    for same in (text, b"", b"zz\r\n", b"5"):
        assert warc.unchunked(same) == same
    packed = gzip.compress(b"hi there")
    assert warc.decoded([("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], plain_unchunked([9, len(packed) - 9], packed)) == "hi there"
    response = {"block": b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab c \r\n4\r\nd ef\r\n0\r\n\r\n", "headers": None, "record_id": "r",
                "target_uri": "u", "warc_date": "d"}
    assert warc.derivatives(response)[1]["block"] == b"ab c d ef"


def record(block, length=None, **more):
    lines = ["WARC/1.1", "WARC-Type: response", *(f"{k}: {v}" for k, v in more.items()), f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_bad_lengths_lose_one_record():
    good = [record(b"one"), record(b"WARC/1.1 inside"), record(b"")]
    for bad in ("abc", "-1", "9" * 30, "99999999", "1e3"):
        data = good[0] + record(b"lost", bad) + good[1] + good[2]
        assert [r["block"] for r in warc.parse(data)] == [b"one", b"WARC/1.1 inside", b""], bad
    assert [r["block"] for r in warc.parse(b"noise" + good[0] + b"\r\n" + good[1][:-9])] == [b"one"]
    assert list(warc.parse(b"")) == list(warc.parse(b"WARC/" * 3000)) == []


def test_files_are_read_member_by_member(monkeypatch):
    blocks = [bytes([65 + n % 26]) * (n * 37 % 5000) for n in range(200)]
    plain = [record(b, None, **{"WARC-Record-ID": f"<{n}>"}) for n, b in enumerate(blocks)]
    for piece in (64, 1000, 1 << 20):
        monkeypatch.setattr(warc, "_PIECE", max(piece, 300))
        for data in (b"".join(plain), b"".join(map(gzip.compress, plain)), gzip.compress(b"".join(plain))):
            assert [(r["record_id"], r["block"]) for r in warc.parse(data)] == [(f"<{n}>", b) for n, b in enumerate(blocks)]
    cut = b"".join(map(gzip.compress, plain))
    assert [r["block"] for r in warc.parse(cut[:-30])] == blocks[:-1]
    start = time.perf_counter()
    assert sum(1 for _ in warc.parse(gzip.compress(plain[3]) * 30_000)) == 30_000
    assert time.perf_counter() - start < 20


def test_derivatives_against_a_plain_version(spark):
    """Every field of both records, from the parts of the response, with plain string work."""
    rng = random.Random(6)
    rows = []
    for n in range(30):
        words = [[rng.choice(["alpha", "b&amp;c", "dé"]) for _ in range(rng.randrange(1, 6))] for _ in range(4)]
        links = [f"/l{n}?a={k}&amp;b" for k in range(rng.randrange(3))]
        page = (f"<html lang=en><head><title>T {n}</title><script>var a = '<p>no</p>';</script></head><body>"
                + "".join(f"<p>{' '.join(w)}</p>" for w in words) + "".join(f"<a href='{x}'>x</a>" for x in links) + "</body></html>")
        text = [" ".join(w).replace("&amp;", "&") for w in words] + (["x" * len(links)] if links else [])
        rows.append((n, f"http://h/{n}", page, text, [x.replace("&amp;", "&") for x in links]))
    got = warc.build_derivatives(response(spark, [r[:3] for r in rows]), "page_id").collect()
    for n, url, page, text, links in rows:
        meta, body = sorted((r for r in got if r.page_id == n), key=lambda r: r.warc_type, reverse=True)
        assert bytes(body.block).decode() == "\n".join(text)
        size = len(page.encode())
        assert bytes(meta.block).decode() == "".join(f"{k}: {v}\r\n" for k, v in [
            ("http-status", "HTTP/1.1 200 OK"), ("source-content-type", "text/html; charset=utf-8"), ("source-content-length", size),
            ("title", f"T {n}"), ("language", "en"), *(("outlink", x) for x in links)])
        for r in (meta, body):
            own = headers(r)
            assert own["WARC-Refers-To-Payload-Digest"] == warc.digest(page.encode()) and own["WARC-Block-Digest"] == warc.digest(bytes(r.block))
            assert own["WARC-Target-URI"] == url == r.target_uri and own["WARC-Type"] == r.warc_type
