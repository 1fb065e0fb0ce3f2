"""N-gram Jaccard join by MinHash banding.

1. Each text gets MinHash values of its five-word shingles in ``b`` bands of ``r`` values; the two
   numbers follow from the threshold and the target recall (:func:`bands`). Texts that are equal
   byte for byte are one node from here on, told apart by two 64-bit hashes.
2. Nodes are shuffled on band hashes. In a bucket every node is tied to the least one: no pairs are made.
   The components of these ties are the candidate groups.
3. The full shingle sets of each group are compared. A group is split into blocks of bounded
   size and each pair of blocks is a unit of work of its own, so a group of any size spreads over the
   cluster and no task holds more than two blocks. All pairs of texts in a group are compared inside
   the tasks, but only a row per text leaves them: its number of links and a local root.
4. Classes are the components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.llm import text as texts
from sievelark.llm.components import components
from sievelark.llm.names import hidden
from sievelark.plans.shared import write_shared

THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 20
"""A block of a group holds about so many texts or shingles, whatever is reached first."""

BROADCAST_ROWS = 500_000
"""Most keys of candidate texts or removed documents (48 and 24 bytes each) that are sent to all tasks; more are joined by a shuffle."""


def bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that reach ``recall`` at ``threshold`` with
    ``most`` hash functions."""
    for rows in range(most, 0, -1):
        hit = threshold**rows  # the chance that a band of a pair at the threshold agrees
        count = 1 if hit >= 1 else math.log1p(-recall) / math.log1p(-hit)
        if math.ceil(count) * rows <= most:
            return math.ceil(count), rows
    return most, 1


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
    ).withColumns({"node": F.xxhash64("text"), "check": F.xxhash64(F.lit(7), F.col("text"))})


def sketches(docs: DataFrame, threshold: float, recall: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the two hashes of its text, number of shingles, band hashes (none without words)."""
    count, rows = bands(threshold, recall)
    masks, factors = texts.hash_functions(count * rows, seed=9)
    steps = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    salts = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, lengths = np.zeros(len(batch), np.int64), [], np.zeros(len(batch), np.int64)
            for first, hashes, counts in texts.shingles(batch.column(1)):
                sizes[first : first + len(counts)] = counts
                full = counts > 0
                if full.any():
                    values = texts.minima(hashes, (np.cumsum(counts) - counts)[full], masks, factors)
                    joined = (values.reshape(-1, count, rows) * steps).sum(axis=2, dtype=np.uint64)
                    found.append(texts.mixed(joined ^ salts).view(np.int64).ravel())
                    lengths[first : first + len(counts)][full] = count
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes),
                 texts.lists(found or np.zeros(0, np.int64), lengths, pa.int64())],
                names=["doc_id", "node", "check", "size", "bands"])

    return _keyed(docs, doc_id, text).mapInArrow(
        sketched, "doc_id long, node long, check long, size long, bands array<long>")


def _with_sets(keyed: DataFrame) -> DataFrame:
    """The sorted distinct shingle hashes of each text, as bytes, in place of the text."""
    kept = [c for c in keyed.columns if c != "text"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            for _, hashes, counts in texts.shingles(batch.column(batch.schema.names.index("text"))):
                sets += [np.unique(own).tobytes() for own in texts.split(hashes, counts)]
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema if f.name != "text"]
    return keyed.mapInArrow(build, ", ".join([*fields, "shingles binary"]))


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices over the values in two sets or more."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    often = (np.bincount(column) > 1)[column]
    column, owner = column[often], owner[often]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]))
        for low in range(0, int(column[-1]) + 1, chunk):
            here = slice(*np.searchsorted(column, [low, low + chunk]))
            marks = np.zeros((len(sets), chunk), dtype=np.float32)
            marks[owner[here], column[here] - low] = 1
            out += marks @ marks.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] < 0:
            front = np.array([start])
            root[start] = start
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = start
    return root


def _verify(threshold: float):
    """Compares the texts of each unit of work (rows sorted by cluster, low and high block)."""

    def unit(rows: list[tuple]) -> list[tuple]:
        seen: dict[tuple, tuple] = {}
        for r in rows:
            seen[r[4], r[5]] = r
        rows = list(seen.values())
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[7], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        shared = shared_counts(sets)
        linked = shared * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
        linked &= shared > 0
        np.fill_diagonal(linked, False)
        if rows[0][1] != rows[0][2]:
            block = np.array([r[3] for r in rows])
            linked &= block[:, None] != block[None, :]
        links = linked @ np.array([r[6] for r in rows], dtype=np.int64)
        root = _roots(linked)
        return [(r[4], r[5], int(n), rows[int(at)][4]) for r, n, at in zip(rows, links, root, strict=True) if n]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)],
                names=["node", "check", "n_links", "root"])

        current, rows, found = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != current:
                    found += unit(rows)
                    current, rows = row[:3], []
                    if len(found) > 10_000:
                        yield out(found)
                        found = []
                rows.append(row)
        found += unit(rows)
        yield out(found)

    return verified


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """A row for each document: doc_id, class_id (least doc_id of its class) and n_links (other
    documents with a similarity of ``threshold`` or more, exact copies included).

    NULL, empty and white-space texts have no links and are classes of their own. A row with a NULL id links like any other; a
    class of which no id is known has class_id NULL. Repeated rows and rows that share an id are
    documents like any other: they link to each other and share a class. Only ``doc_id`` and ``text`` are
    read, so other columns cannot clash; an empty table gives an empty result.
    """
    return _classes(docs, doc_id, text, threshold, recall).select("doc_id", "class_id", "n_links")


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, the two hashes of the text, whether the row is the first of its class, class_id, n_links.

    The first row is the least by (NULL ids last, doc_id, hashes of the text); texts without words are classes of their own.
    """
    keys = ["node", "check"]
    sketch = write_shared(sketches(docs, threshold, recall, doc_id, text), "sketch")
    nodes = sketch.filter("size > 0").groupBy(*keys).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    nodes = write_shared(nodes, "nodes")

    sized, least = sketch.filter("size > 0"), nodes.select(*keys, "doc_id")
    one = sized.join(least, [*(sized[k] == least[k] for k in keys), sized["doc_id"].eqNullSafe(least["doc_id"])], "left_semi")
    buckets = one.select("node", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("most > hub")
    ties = buckets.join(hubs, "bucket").filter(F.col("node") > F.col("hub"))
    groups = components(ties.select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    groups = groups.withColumnRenamed("root", "cluster")

    members = nodes.join(groups, "node")
    members = write_shared(members, "members")
    blocks = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "cluster").withColumn("block", F.pmod(F.col("check"), F.col("blocks")).cast("int"))
    members = write_shared(members, "members")
    wanted = members.select(*keys, "doc_id", "cluster", "blocks", "block", "copies")
    if members.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    kept = _keyed(docs, doc_id, text).withColumnRenamed("doc_id", "id")
    same = [kept[k] == wanted[k] for k in keys] + [kept["id"].eqNullSafe(wanted["doc_id"])]
    sets = _with_sets(kept.join(wanted, same[0] & same[1] & same[2]).select(
        kept["node"], kept["check"], "cluster", "blocks", "block", "copies", "text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sets.withColumn("other", other).select(
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node", "check", "copies", "shingles")
    units = units.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    verified = write_shared(
        units.mapInArrow(_verify(threshold), "node long, check long, n_links long, root long"), "verified")

    links = verified.groupBy(*keys).agg(F.sum("n_links").alias("n_links"))
    roots = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    found = nodes.join(links, keys, "left").join(roots, "node", "left").select(
        *keys, "doc_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    leader = F.struct(F.col("doc_id").isNull(), "doc_id", *keys)
    classes = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(leader).alias("leader"))
    found = found.join(classes, "root").select(*keys, "class_id", "n_links", "leader")
    documents = sketch.select("doc_id", "size", *keys)
    return documents.join(found, keys, "left").select(
        "doc_id", *keys, (F.col("leader").isNull() | leader.eqNullSafe(F.col("leader"))).alias("first"), F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each near-duplicate class, the first by doc_id (NULL last, then by the hashes of the text), with all columns.

    Of rows that repeat the id and the text of the first document one stays. The others are removed by a join with their
    keys, which is broadcast while they are at most ``BROADCAST_ROWS``.
    """
    keys = ["__id", "node", "check"]
    names, own = docs.columns, hidden(docs.columns, ("node", "check"))
    docs = docs.withColumnsRenamed(own)
    classes = _classes(docs, doc_id, text, **options).withColumnRenamed("doc_id", "__id")
    marked = write_shared(classes.select(*keys, "first"), "firsts")
    others = marked.filter(~F.col("first")).select(*keys)
    kept = docs.withColumns({"__id": F.col(doc_id).cast("long"), "node": F.xxhash64(text), "check": F.xxhash64(F.lit(7), F.col(text))})
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["__id"].eqNullSafe(b["__id"]) & (a["node"] == b["node"]) & (a["check"] == b["check"])

    kept = kept.join(others, same(kept, others), "left_anti")
    repeated = write_shared(marked.filter("first").groupBy(*keys).count().filter("count > 1").select(*keys), "repeated")
    if not repeated.isEmpty():
        single = kept.join(repeated, same(kept, repeated), "left_anti")
        again = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(keys)
        kept = single.unionByName(again)
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in names])
