"""Main text of pages by differencing pages with near URLs.

Within each host pages are ordered by URL path; a page is compared with the neighbour whose path shares the longer
beginning. Their text lines (blocks) are aligned by a longest common subsequence, and the lines they share are deleted as the
furniture of the site. Three rules keep that right:

* Lines inside article or main elements are content even if a neighbour has them too (articles are copied and share
  passages), where these elements hold most of the page's unshared text. Where they do not, as on a page of teasers
  beside a plain body, and for lines outside them differencing decides.
* Menus, headers, footers, sidebars, notices, adverts, forms and comments that say so by element, class or id are deleted
  also where the neighbours' differ.
* A neighbour that shares ``COPY`` or more of a page's characters is a copy of the page and proves nothing; the page is
  then compared with the other one.

Only hashes of lines are shuffled. Pages are parsed once for the hashes and once for the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelark.llm.html import Block, blocks
from sievelark.plans.ordered import ordered
from sievelark.plans.shared import write_shared

COPY = 0.8
GROUP_ROWS = 200_000
"""Pages of one host that a single task orders; larger hosts are split."""

BROADCAST_LINES = 1_000_000
"""Most deleted lines (4 bytes each, and 24 a page) that are sent to all tasks; more are joined by a shuffle."""


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b`` (a bit for each item of b)."""
    where: dict[int, int] = {}
    for n, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << n
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        here = row & where.get(x, 0)
        row = ((row + here) | (row - here)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``, in linear memory (halving ``a``)."""
    found: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        low, high, left, right = work.pop()
        while low < high and left < right and a[low] == b[left]:
            found.append(low)
            low, left = low + 1, left + 1
        while low < high and left < right and a[high - 1] == b[right - 1]:
            high, right = high - 1, right - 1
            found.append(high)
        if low == high or left == right:
            continue
        if high - low == 1:
            if a[low] in b[left:right]:
                found.append(low)
            continue
        middle = (low + high) // 2
        before = _lengths(a[low:middle], b[left:right])
        after = _lengths(a[middle:high][::-1], b[left:right][::-1])[::-1]
        cut = left + int(np.argmax(before + after))
        work += [(low, middle, left, cut), (middle, high, cut, right)]
    return sorted(found)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def shared_beginning(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deletions(lines: list[int], sizes: list[int], path: str, neighbours: list[tuple[str, list[int]]]) -> list[int]:
    """Places of the lines that the page shares with its nearest neighbour that is no copy of it."""
    near = sorted(neighbours, key=lambda n: -shared_beginning(path, n[0]))
    total = sum(sizes)
    for _, other in near:
        common = common_lines(lines, other)
        if sum(sizes[n] for n in common) < COPY * total:
            return common
    return []


def main_text(found: list[Block], deleted: set[int]) -> str:
    """The blocks that are content, joined by empty lines."""
    left = [(n, b) for n, b in enumerate(found) if not b.furniture]
    inside = sum(len(b.text) for _, b in left if b.article)
    body = inside > sum(len(b.text) for n, b in left if not b.article and n not in deleted)
    return "\n\n".join(b.text for n, b in left if n not in deleted or body and b.article)


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    page = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return page.withColumn("key", F.xxhash64("page_id", "url", "html"))


def page_lines(pages: DataFrame) -> DataFrame:
    """key, host, path, and for each line of a page its hash, its length and whether differencing decides any."""
    parts = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)", 1)
    path = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)", 2)
    placed = pages.select("key", F.coalesce(F.lower(parts), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes, open_lines = [], [], []
            for page in batch.column(3).to_pylist():
                found = blocks(page)
                hashes.append([_hash(b.text) for b in found])
                sizes.append([len(b.text) for b in found])
                open_lines.append(any(not b.furniture and not b.article for b in found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(open_lines, pa.bool_())],
                names=["key", "host", "path", "lines", "sizes", "open"])

    return placed.mapInArrow(parsed, "key long, host string, path string, lines array<long>, sizes array<int>, open boolean")


def shared_lines(lines: DataFrame) -> DataFrame:
    """key and places of the lines each page shares with its neighbour, for pages where that decides anything."""
    rows = ordered(lines, ["host"], ["path", "key"], before=1, after=1, group_rows=GROUP_ROWS)
    around = rows.df.withColumns({
        "path_before": F.lag("path").over(rows.window), "lines_before": F.lag("lines").over(rows.window),
        "path_after": F.lead("path").over(rows.window), "lines_after": F.lead("lines").over(rows.window)})
    around = rows.finish(around).select("key", "path", "lines", "sizes", "open", "path_before", "lines_before", "path_after", "lines_after")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [], []
            for key, path, own, sizes, open_lines, *others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = [(others[n], others[n + 1]) for n in (0, 2) if others[n + 1] is not None]
                common = deletions(own, sizes, path, pairs)
                if common and open_lines:
                    keys.append(key)
                    places.append(common)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["key", "deleted"])

    return around.mapInArrow(aligned, "key long, deleted array<int>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text (empty if none) and n_chars.

    NULL and empty pages have an empty text; a NULL URL is a host of its own. A page without neighbour in its
    host keeps all lines that are not marked as furniture. Repeated rows are copies of each other: they get the same text. Only
    the three columns are read; an empty table gives an empty result.
    """
    own = _keyed(pages, page_id, url, html)
    shared = write_shared(shared_lines(page_lines(own)), "shared-lines")
    shared = shared.dropDuplicates(["key"])
    if (shared.agg(F.sum(F.size("deleted"))).first()[0] or 0) <= BROADCAST_LINES:
        shared = F.broadcast(shared)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = [main_text(blocks(page), set(gone or ())) for page, gone in
                      zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(result, pa.string()), pa.array([len(t) for t in result], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = own.schema["page_id"].dataType.simpleString()
    joined = own.join(shared, "key", "left").select("page_id", "url", "html", "deleted")
    return joined.mapInArrow(written, f"page_id {kind}, url string, text string, n_chars long")
