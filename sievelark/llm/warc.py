"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: type, id, the record it refers to, target, date, headers in their order, and block. For each
response record two others are built:

* ``metadata`` (application/warc-fields): HTTP status, all source headers as ``source-<name>`` fields, title, language and
  links found in the page;
* ``conversion`` (text/plain): the visible text, a line for each block.

Both keep ``WARC-Refers-To`` (the id of the response), target and date of the response, its payload digest as
``WARC-Refers-To-Payload-Digest``, and have digests of their own. Ids are name-based, so reruns agree. Every record is
built in the task that reads its response: nothing is shuffled.

:func:`serialised` gives the bytes of a record as a gzip member of its own, the layout of ``.warc.gz`` files;
:func:`read_warc` reads such files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.llm.html import Facts, blocks

CRLF = b"\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the standard name space of URLs
RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "headers array<struct<name: string, value: string>>, block binary")
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("warc_date", pa.string()), ("content_type", pa.string()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,8})[ \t]*(?:;[^\r\n]*)?\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_LENGTH = re.compile(r"[0-9]{1,18}")
_NEXT = re.compile(rb"\n\r?\nWARC/[0-9]")
_PIECE = 1 << 20
"""Bytes handled at a time when a file is read, and the longest head of a record."""

_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, kind + ' ' + name)}>"


def _record(kind: str, identity: str, refers_to: str | None, target: str | None, date: str | None, content_type: str,
            block: bytes, more: list[tuple[str, str | None]]) -> dict:
    own = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", target),
           ("WARC-Date", date), *more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type),
           ("Content-Length", str(len(block)))]
    return {"warc_type": kind, "record_id": identity, "refers_to": refers_to, "target_uri": target, "warc_date": date,
            "content_type": content_type, "headers": [{"name": n, "value": _one_line(v)} for n, v in own if v is not None], "block": block}


def _one_line(text: str) -> str:
    return " ".join(text.split())


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    cut = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
    status, *lines = re.split(r"\r?\n", head.decode("utf-8", "replace"))
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:  # a folded header
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return status, headers, payload


def unchunked(payload: bytes) -> bytes:
    """The payload without the sizes of a chunked transfer; one that is not chunked, or not any more, as it is."""
    parts, at = [], 0
    while found := _CHUNK.match(payload, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(parts)
        end = found.end() + size
        parts.append(payload[found.end() : end])
        at = end + 2 if payload[end : end + 2] == CRLF else end + 1 if payload[end : end + 1] == b"\n" else end
        if end >= len(payload):  # cut short
            return b"".join(parts)
    return payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    """The payload as text: transfer and content encoding undone, character set from the header, else from the page, else UTF-8."""
    by_name = {n.lower(): v for n, v in headers}
    if "chunked" in by_name.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    coding = by_name.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            payload = gzip.decompress(payload)
        elif coding == "deflate":
            payload = zlib.decompress(payload)
    except (OSError, EOFError, zlib.error):
        pass
    named = _CHARSET.search(by_name.get("content-type", "")) or _CHARSET.search(payload[:2048].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    block = response["block"] or b""
    status, headers, payload = http_parts(block)
    page = decoded(headers, payload)
    given = {h["name"].lower(): h["value"] for h in response["headers"] or []}
    source_digest = given.get("warc-payload-digest") or digest(payload)
    identity, target, date = response["record_id"], response["target_uri"], response["warc_date"]
    seen = Facts(page)
    found = blocks(page, seen)
    fields = [("http-status", status)] if status else []
    fields += [(f"source-{name.lower()}", value) for name, value in headers]
    fields += [("title", seen.title)] if seen.title else []
    fields += [("language", seen.language)] if seen.language else []
    fields += [("outlink", link) for link in seen.links]
    listed = "".join(f"{name}: {_one_line(value)}\r\n" for name, value in fields).encode()
    text = "\n".join(b.text for b in found).encode()
    kept = [("WARC-Refers-To-Payload-Digest", source_digest),
            ("WARC-Refers-To-Block-Digest", given.get("warc-block-digest") or digest(block))]
    kept += [(name, given[name.lower()]) for name in ("WARC-IP-Address", "WARC-Concurrent-To") if name.lower() in given]
    name = f"{identity} {source_digest}"
    meta = record_id("metadata", name)
    return [
        _record("metadata", meta, identity, target, date, "application/warc-fields", listed, kept),
        _record("conversion", record_id("conversion", name), identity, target, date, "text/plain; charset=utf-8", text,
                [*kept, ("WARC-Concurrent-To", meta)] if "warc-concurrent-to" not in given else kept),
    ]


def build_derivatives(records: DataFrame, *extra: str) -> DataFrame:
    """Metadata and conversion records of all ``response`` records (columns of ``RECORD``), with the columns ``extra``
    of their response.

    Records of other types are left out. A NULL block is an empty response: it still gets both records, with empty
    blocks. Repeated responses give repeated records with equal ids; a response without id gets records
    that refer to nothing. An empty table gives an empty result; columns not named are dropped.
    """
    names = [f.name for f in _ARROW]
    chosen = records.filter(F.col("warc_type") == "response").select(*names, *extra)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows = [r for response in part.select(names).to_pylist() for r in derivatives(response)]
                twice = pa.array([n for n in range(len(part)) for _ in range(2)], pa.int64())
                made = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                yield pa.RecordBatch.from_arrays([*made.columns, *(part.column(c).take(twice) for c in extra)], names=[*names, *extra])

    kinds = [f"{c} {chosen.schema[c].dataType.simpleString()}" for c in extra]
    return chosen.mapInArrow(built, ", ".join([RECORD, *kinds]))


def _text_digest(data: Column) -> Column:
    """``sha1:`` and the base32 digest, from the hexadecimal one: five hexadecimal digits are four of base32."""
    def coded(hexadecimal: Column) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.lpad(
            F.conv(F.substring(hexadecimal, (n * 5 + 1).cast("int"), F.lit(5)), 16, 32), 4, "0"))
        return F.concat(F.lit("sha1:"), F.translate(F.upper(F.array_join(bits, "")), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                                                    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))

    return F.transform(F.array(F.sha1(data)), coded)[0]  # hashed once, not for each of the eight parts


def responses(pages: DataFrame, url: str = "url", html_column: str = "html", page_id: str = "page_id",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages as response records; ids follow from page id and URL. NULL pages have an empty payload.

    ``date`` is the capture date of tables that hold none.
    """
    text = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    payload = F.encode(text, "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "UTF-8"), payload)
    name = F.md5(F.concat_ws(" ", F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))))
    identity = F.concat(F.lit("<urn:uuid:"), F.concat_ws(
        "-", F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("3"), F.substring(name, 14, 3)),
        F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12)), F.lit(">"))

    def header(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("name"), value.alias("value"))

    kind = F.lit("application/http; msgtype=response")
    headers = F.filter(F.array(
        header("WARC-Type", F.lit("response")), header("WARC-Record-ID", identity), header("WARC-Target-URI", F.col(url).cast("string")),
        header("WARC-Date", F.lit(date)), header("WARC-Payload-Digest", _text_digest(payload)),
        header("WARC-Block-Digest", _text_digest(block)), header("Content-Type", kind),
        header("Content-Length", F.octet_length(block).cast("string"))), lambda h: h.value.isNotNull())
    return pages.select(
        F.lit("response").alias("warc_type"), identity.alias("record_id"), F.lit(None).cast("string").alias("refers_to"),
        F.col(url).alias("target_uri"), F.lit(date).alias("warc_date"), kind.alias("content_type"),
        headers.alias("headers"),
        block.alias("block"), F.col(page_id).alias("page_id"))


def record_bytes(record: dict) -> bytes:
    """A record as it stands in a file, with version line, headers and block."""
    lines = ["WARC/1.1", *(f"{h['name']}: {h['value']}" for h in record["headers"])]
    return CRLF.join(line.encode() for line in lines) + 2 * CRLF + (record["block"] or b"") + 2 * CRLF


def serialised(records: DataFrame, out: str = "member") -> DataFrame:
    """``records`` with their bytes as gzip members; members in any order, one after the other, are a ``.warc.gz`` file."""
    @F.arrow_udf("binary")
    def packed(headers: pa.Array, block: pa.Array) -> pa.Array:
        rows = zip(headers.to_pylist(), block.to_pylist(), strict=True)
        return pa.array([gzip.compress(record_bytes({"headers": h or [], "block": b}), 6, mtime=0) for h, b in rows], pa.binary())

    return records.withColumn(out, packed("headers", "block"))


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces; gzip members are undone one after the other, up to the first that is broken."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[at : at + _PIECE]) for at in range(0, len(view), _PIECE))
        return
    at = 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            part = view[at : at + _PIECE]
            at += len(part)
            try:
                while part and not member.eof:
                    yield member.decompress(part, _PIECE)
                    part = member.unconsumed_tail
            except zlib.error:
                return
        at -= len(member.unused_data)


class _Buffer:
    """Pieces as one run of bytes, of which only what is not yet used is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > _PIECE:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def has(self, count: int) -> bool:
        while len(self.held) - self.at < count:
            if not self.more():
                return False
        return True

    def search(self, pattern: re.Pattern, most: int | None = None) -> re.Match | None:
        """The first match behind the place reached, among ``most`` bytes; no stretch is searched twice but for an overlap."""
        low = 0
        while True:
            found = pattern.search(self.held, self.at + low, *([] if most is None else [self.at + most]))
            if found or most is not None and len(self.held) - self.at >= most:
                return found
            low = max(0, len(self.held) - self.at - 16)
            if not self.more():
                return None


def parse(data: bytes) -> Iterator[dict]:
    """The records of a file, compressed or not, one after the other.

    A record cut short at the end is left out. One whose length is missing, no number or beyond the end of the file is left out too,
    and reading goes on at the next version line.
    """
    buffer = _Buffer(_plain(data))
    version = re.compile(rb"WARC/")
    while found := buffer.search(version):
        buffer.at = found.start()
        del found  # a match holds on to the buffer, which could not grow then
        if not (cut := buffer.search(_HEAD_END, _PIECE)):
            buffer.at += 5
            continue
        head, body = bytes(buffer.held[buffer.at : cut.start()]), cut.end()
        del cut
        lines = re.split(r"\r?\n", head.decode("utf-8", "replace"))[1:]
        headers = [{"name": n.strip(), "value": v.strip()} for n, _, v in (line.partition(":") for line in lines)]
        by_name = {h["name"].lower(): h["value"] for h in headers}
        length = by_name.get("content-length") or "0"
        buffer.at = body
        if not _LENGTH.fullmatch(length) or not buffer.has(int(length)):
            buffer.at = max(0, body - 4)
            following = buffer.search(_NEXT)
            if not following:
                return
            buffer.at = following.end() - 6
            del following
            continue
        block = bytes(buffer.held[buffer.at : buffer.at + int(length)])
        buffer.at += int(length)
        yield {"warc_type": by_name.get("warc-type"), "record_id": by_name.get("warc-record-id"),
               "refers_to": by_name.get("warc-refers-to"), "target_uri": by_name.get("warc-target-uri"),
               "warc_date": by_name.get("warc-date"), "content_type": by_name.get("content-type"), "headers": headers,
               "block": block}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.warc`` and ``.warc.gz`` files, a file to a task: files of 2 GB or more have to be cut at member
    borders before. A file is held as it is on disk, its records are given out as they are met."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held: list[dict] = []
                for record in parse(data.as_py()):
                    held.append(record)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)
