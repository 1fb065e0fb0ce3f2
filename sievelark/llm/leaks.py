"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size: those of ``u/2`` to ``u`` shingles (u = 16, 32, 64, ...) share a
partition. A document is cut into blocks of 16 shingles; the MinHash of a longer stretch is the
minimum over its blocks, so one pass serves all partitions. A stretch of two neighbouring blocks of
``u`` shingles holds any passage of ``u`` shingles whole. That bounds the Jaccard similarity of item and
stretch from below, and the lowest bound of all partitions sets the number of hash functions that finds an item with the
target recall. That holds for unbroken passages; an item scattered over a long document is found less surely. One equal hash value makes a candidate; a candidate is then verified on the full shingle
sets: ``|item and document| / |item|``. Items of up to eight shingles, for which hashing saves
nothing, are looked up by their shingles directly.

Documents are read once and never shuffled; only their texts go through Python. The items travel to the tasks, in blocks of
at most ``BLOCK_CHARS`` characters, one block after the other: with several blocks each has a pass over the documents of its own, whose
result is written, so a task never holds more than one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelark.llm import text as texts
from sievelark.llm.names import hidden
from sievelark.plans.shared import write_shared

THRESHOLD = 0.8
RECALL = 0.9999
BLOCK_CHARS = 32_000_000
"""Most characters of items sent to the tasks at once."""

SMALLEST = 16
LARGEST = 1 << 40
"""Size partition whose bound, the lowest, sets the number of hash functions of all."""

DIRECT = 8

MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()),
    T.StructField("n_shingles", T.LongType()), T.StructField("containment", T.DoubleType()),
]))


def hash_count(threshold: float, recall: float, upper: int = SMALLEST) -> int:
    """Hash functions needed for the smallest item of a partition inside a stretch of ``2 * upper``."""
    size = upper // 2 + 1
    least = threshold * size / (2 * upper + size - threshold * size)
    return math.ceil(math.log(1 - recall) / math.log(1 - least))


class Items:
    """Shingle sets and hash tables of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, recall: float):
        self.threshold = threshold
        self.ids = [i for i, _ in rows]
        self.count = hash_count(threshold, recall, LARGEST)
        self.masks, self.factors = texts.hash_functions(self.count, seed=10)
        self.sets: list[np.ndarray] = []
        self.width: list[int] = []  # words in a shingle of the item
        column = pa.array([t for _, t in rows], pa.large_string())
        data, offsets = texts.text_bytes(texts.lowered(column))
        for first, last in texts.groups(offsets):
            words, counts = texts.word_hashes(data, offsets, first, last)
            for own in texts.split(words, counts):
                width = min(len(own), texts.SHINGLE_WORDS)
                found = texts.run_hashes(own, np.array([len(own)]), width, False)[0] if width else own
                self.sets.append(np.unique(found))
                self.width.append(width)
        partitions: dict[int, list[int]] = defaultdict(list)
        direct: dict[int, list[int]] = defaultdict(list)
        for n, own in enumerate(self.sets):
            if not len(own):
                continue
            if self.width[n] < texts.SHINGLE_WORDS or len(own) <= DIRECT:
                direct[self.width[n]].append(n)
            else:
                partitions[max(0, math.ceil(math.log2(len(own) / SMALLEST)))].append(n)
        self.direct = {w: self._table([self.sets[n] for n in own], own) for w, own in direct.items()}
        self.partitions = {}
        for level, own in partitions.items():
            flat = np.concatenate([self.sets[n] for n in own])
            starts = np.cumsum([0, *(len(self.sets[n]) for n in own[:-1])])
            low = texts.minima(flat, starts, self.masks, self.factors)
            self.partitions[level] = [self._table([low[m, k : k + 1] for m in range(len(own))], own)
                                      for k in range(self.count)]

    @staticmethod
    def _table(values: list[np.ndarray], items: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(values)
        owner = np.repeat(np.array(items), [len(v) for v in values])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    @staticmethod
    def _hits(table: tuple[np.ndarray, np.ndarray], values: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(owner, item) of equal values."""
        keys, items = table
        low = np.searchsorted(keys, values)
        near = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == values)
        found = set()
        high = np.searchsorted(keys, values[near], "right")
        for at, end in zip(near.tolist(), high.tolist(), strict=True):
            for item in items[low[at] : end].tolist():
                found.add((int(owner[at]), item))
        return found

    def _candidates(self, hashes: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        full = np.flatnonzero(counts)
        if not self.partitions or not len(full):
            return found
        owner = np.repeat(np.arange(len(counts)), -(-counts // SMALLEST))
        begin = np.cumsum(counts) - counts
        inner = np.arange(len(owner)) - np.searchsorted(owner, owner)
        low = texts.minima(hashes, begin[owner] + inner * SMALLEST, self.masks, self.factors)
        for level in range(max(self.partitions) + 1):
            if level:  # blocks of twice the size
                even = np.flatnonzero((np.arange(len(owner)) - np.searchsorted(owner, owner)) % 2 == 0)
                low, owner = np.minimum.reduceat(low, even, axis=0), owner[even]
            if level in self.partitions:
                pairs = low.copy()
                same = np.flatnonzero(owner[1:] == owner[:-1])
                pairs[same] = np.minimum(low[same], low[same + 1])
                for k, table in enumerate(self.partitions[level]):
                    found |= self._hits(table, pairs[:, k], owner)
        return found

    def matches(self, column: pa.Array) -> list[list[dict]]:
        """For each text the items whose containment reaches the threshold, in order of their ids."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        data, offsets = texts.text_bytes(texts.lowered(column))
        for first, last in texts.groups(offsets):
            words, word_counts = texts.word_hashes(data, offsets, first, last)
            runs = {w: texts.run_hashes(words, word_counts, w, False)
                    for w in {texts.SHINGLE_WORDS, *self.direct}}
            candidates = self._candidates(*runs[texts.SHINGLE_WORDS])
            for width, table in self.direct.items():
                hashes, counts = runs[width]
                candidates |= self._hits(table, hashes, np.repeat(np.arange(len(counts)), counts))
            by_text = defaultdict(list)
            for at, item in candidates:
                by_text[at].append(item)
            for at, items in by_text.items():
                for item in items:
                    hashes, counts = runs[self.width[item]]
                    end = int(counts[: at + 1].sum())
                    own = self.sets[item]
                    shared = int(np.isin(own, hashes[end - int(counts[at]) : end]).sum())
                    if shared >= self.threshold * len(own) - 1e-9:
                        out[first + at].append({"item_id": self.ids[item], "n_shared": shared,
                                                "n_shingles": len(own), "containment": shared / len(own)})
        for found in out:
            found.sort(key=lambda m: (m["item_id"] is None, m["item_id"]))
        return out


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).dropDuplicates()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").toLocalIterator()]


def _finder(index: Broadcast):
    """The items of a broadcast block that each text contains."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64())]))

    @F.arrow_udf(MATCHES)
    def found(column: pa.Array) -> pa.Array:
        return pa.array(index.value.matches(column), kind)

    return found


def mark_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
               out: str = "matches") -> DataFrame:
    """``docs`` with a column ``out``: the items each text contains, as structs of item_id,
    n_shared, n_shingles and containment.

    NULL and empty texts hold no item, an item without words is in no text, an empty table of items
    gives empty lists. Items of fewer than five words count as one shingle of that many words. Repeated
    rows each get their list. An item is a distinct row of ``items``: rows repeated with id and text are one, rows that share
    an id and differ in text are items of their own, and so are rows with a NULL id. A column of ``docs`` named like ``out`` is
    replaced; others pass through untouched.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    columns, seen = docs.columns, None
    for rows in _item_blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(Items(rows, threshold, recall))

        matches = _finder(index)(F.col(text).cast("string"))
        if seen is not None:
            docs = write_shared(docs, "marked")  # the block before is done with
            matches = F.concat(F.col(out), matches)
        docs = docs.select(*[F.col(f"`{c}`") for c in columns], matches.alias(out))
        seen = index
    return docs


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, n_shared, n_shingles, containment."""
    marked = mark_leaks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")),
                        items, text="text", **options)
    return marked.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with their columns."""
    names, own = docs.columns, hidden(docs.columns)
    marked = mark_leaks(docs.withColumnsRenamed(own), items, out="__matches", **options)
    return marked.filter(F.size("__matches") == 0).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in names])
