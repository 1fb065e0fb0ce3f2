"""Mixing sources to target weights, in DataFrame operations only.

1. The words of each source form one stream, cut into blocks of ``BLOCK_WORDS``; a block knows which words
   of which documents it covers, so a long document lies in many blocks and a block in one or several documents.
2. The mix is a row of slots, ``SHARD_SLOTS`` to an output shard. Every slot draws its source at random in
   proportion to the sources' quotas, so the counts of a shard are multinomial. Draws beyond a source's quota
   go to the sources below theirs: over all shards each source gets exactly its quota.
3. The slots of a source are numbered in shard order and mapped to its blocks by a pseudorandom permutation
   (swap-or-not), a new one for every pass over the source. A quota of at most two passes uses no block more than twice.
4. Slots and blocks are joined by source and block number.

Streams and slot numbers come from counts of bounded packs and shards plus a running sum over those, so a
source may hold any share of the rows. All draws are hashes of numbers: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelark.llm.names import hidden
from sievelark.plans.rowid import is_scan, with_place
from sievelark.plans.shared import write_shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_USES = 2
BLOCK_WORDS = 256
SHARD_SLOTS = 16_384
PACK_ROWS = 16_384
ROUNDS = 24
CELL = 4096
"""Width of the cells by which a number is joined to the interval that holds it."""


def placed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, the file and the place in it: what tells repeated rows apart, also when a task runs again.

    Rows of a file scan have a place; any other frame is written first. Columns of these names are the caller's to keep elsewhere.
    """
    docs = docs.drop("__row", "__file", "__at")
    placed = with_place(docs, "__file", "__at") if is_scan(docs) else None
    if placed is None:
        placed = with_place(write_shared(docs, "documents"), "__file", "__at")
    return placed.withColumn("__row", F.struct(F.xxhash64("__file").alias("file"), F.col("__at").alias("at"))).drop("__file", "__at")


def sized_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``__row``, doc_id, source, size in words and a hash of the text of placed documents, written once."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return write_shared(docs.select(
        "__row", F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        words.alias("size"), F.xxhash64(text).alias("__hash")), "sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_USES,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each source: number, source_size, target, blocks and quota (slots), with the running totals.

    Targets fill up by weight until they reach ``most`` times the source's size: the sources are taken in the order of
    size over weight, and one is full if the level that the rest allows reaches its limit. Windows
    here run over one row a source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("number", F.row_number().over(named) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double"))
    sources = sources.withColumn("limit", most * F.col("source_size"))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    sources = sources.withColumn("level", left / F.sum("weight").over(rest))
    sources = sources.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    sources = sources.withColumn("target", target)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("blocks", blocks).withColumn("quota", quota.cast("long"))
    upto = named.rowsBetween(Window.unboundedPreceding, -1)
    return sources.select("number", "source", "source_size", "target", "blocks", "quota",
                          F.coalesce(F.sum("quota").over(upto), F.lit(0)).alias("first_slot"))


def _in_interval(rows: DataFrame, value: Column, intervals: DataFrame, low: Column, length: Column) -> DataFrame:
    """Join each row to the interval ``low <= value < low + length`` that holds its value, by cells."""
    cells = intervals.filter(length > 0).withColumns({"__low": low, "__high": low + length})
    cells = cells.withColumn("__cell", F.explode(F.sequence(
        F.floor(F.col("__low") / CELL), F.floor((F.col("__high") - 1) / CELL))))
    rows = rows.withColumn("__value", value).withColumn("__cell", F.floor(F.col("__value") / CELL))
    inside = (F.col("__value") >= F.col("__low")) & (F.col("__value") < F.col("__high"))
    return rows.join(cells, "__cell").filter(inside).drop("__cell")


def permuted(index: Column, size: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of ``0 .. size - 1`` chosen by ``key``, at ``index``.

    Swap-or-not: in each round a value and its partner (their sum is fixed modulo the size) change places or not, by a bit
    that depends on the larger of the two. That is a permutation whatever the size.
    """
    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(1), r, *key), size) + size - x, size)
        swap = F.pmod(F.xxhash64(F.lit(2), r, *key, F.greatest(x, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def slots(sources: DataFrame, seed: int = 8, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, slot, number (of the source), turn (0, 1, ... within the source), use (pass over the source) and block."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    drawn = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"))
    drawn = _in_interval(drawn, F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(total, 1))),
                         sources.select("number", "quota", "first_slot"), F.col("first_slot"), F.col("quota"))
    drawn = write_shared(drawn.select("slot", "shard", "number"), "draws")
    counts = drawn.groupBy("number", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("number", "shard").orderBy("slot")) - 1
    turns = drawn.withColumn("inner", within).join(counts, ["number", "shard"])
    turns = turns.select("slot", "shard", "number", (F.col("earlier") + F.col("inner")).alias("turn"))

    # One row a source: draws beyond the quota, and places left, numbered through over all sources.
    got = drawn.groupBy("number").agg(F.count(F.lit(1)).alias("drawn"))
    got = sources.join(got, "number", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    got = got.withColumns({"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)),
                           "under": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))})
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    got = got.withColumns({"over_before": F.coalesce(F.sum("over").over(upto), F.lit(0)),
                           "under_before": F.coalesce(F.sum("under").over(upto), F.lit(0))})
    turns = turns.join(got.select("number", "quota", "over_before"), "number")
    kept = turns.filter(F.col("turn") < F.col("quota")).select("slot", "shard", "number", "turn")
    moved = turns.filter(F.col("turn") >= F.col("quota")).select(
        "slot", "shard", (F.col("over_before") + F.col("turn") - F.col("quota")).alias("spare"))
    moved = _in_interval(moved, F.col("spare"), got.select("number", "drawn", "under", "under_before"),
                         F.col("under_before"), F.col("under"))
    moved = moved.select("slot", "shard", "number", (F.col("drawn") + F.col("spare") - F.col("under_before")).alias("turn"))
    placed = kept.unionByName(moved).join(sources.select("number", "blocks"), "number")
    use = F.floor(F.col("turn") / F.col("blocks"))
    placed = placed.withColumn("use", use)
    block = permuted(F.col("turn") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("number"), F.col("use"))
    return placed.select("shard", "slot", "number", "turn", "use", block.alias("block"))


def pieces(sized: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Which words of which document lie in which block: number, block, __row, doc_id, first_word, n_words."""
    rows = sized.count()
    packs = max(1, -(-rows // pack_rows))
    named = sized.filter("size > 0").join(
        sources.select("number", F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source")))
    named = named.withColumn("pack", F.pmod(F.xxhash64("doc_id", "__hash", "__row"), F.lit(packs)))
    inside = Window.partitionBy("number", "pack").orderBy("doc_id", "__hash", "__row").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = sized.filter("size > 0").join(
        sources.select("number", F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source")))
    sums = sums.groupBy("number", F.pmod(F.xxhash64("doc_id", "__hash", "__row"), F.lit(packs)).alias("pack")).agg(
        F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "pack", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("outer"))
    named = named.join(sums, ["number", "pack"]).withColumn("at", F.col("outer") + F.col("inner"))
    covered = F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))
    named = named.withColumn("block", F.explode(covered))
    low = F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0))
    high = F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size"))
    return named.select("number", "block", "__row", "doc_id", low.alias("first_word"), (high - low).alias("n_words"))


def mixture(sized: DataFrame, sources: DataFrame, seed: int = 8) -> DataFrame:
    """The mix as spans: shard, slot, number, use, block, __row, doc_id, first_word, n_words."""
    return slots(sources, seed).join(pieces(sized, sources), ["number", "block"])


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               seed: int = 8) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target (its source's) and taken (words the mix takes).

    NULL and empty texts have size 0 and are never taken; NULL is a source of its own, last in order. Repeated
    rows are documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    sized = sized_documents(placed_documents(docs.select(doc_id, text, source)), doc_id, text, source)
    sources = write_shared(targets(sized), "sources")
    taken = mixture(sized, sources, seed).groupBy("__row").agg(F.sum("n_words").alias("taken"))
    named = sources.select(F.col("source").alias("__source"), "source_size", "target")
    return sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).join(taken, "__row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    length: str | None = "n_chars", seed: int = 8) -> DataFrame:
    """The mix as documents: for each document and pass over its source, one row with the words taken.

    A document of which a pass takes all words keeps its text (but for white space before the first word); of
    others the text is what the pass takes, in order, and ``length`` its characters. Documents that the mix
    does not take are absent, twice-taken ones appear twice. All columns of ``docs`` stay.
    """
    names = docs.columns
    own = hidden(names)
    docs = docs.withColumnsRenamed(own)
    placed = placed_documents(docs)
    sized = sized_documents(placed, doc_id, text, source)
    sources = write_shared(targets(sized), "sources")
    spans = mixture(sized, sources, seed).groupBy("__row", "use").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("__spans"))
    tokens = F.regexp_extract_all(F.col(text), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    joined = F.array_join(F.transform("__spans", lambda s: F.array_join(
        F.slice(F.col("__words"), (s.first_word + 1).cast("int"), s.n_words.cast("int")), "")), "")
    mixed = placed.join(spans.drop("use"), "__row").withColumn("__words", tokens).withColumn(text, joined)
    if length in docs.columns:
        mixed = mixed.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return mixed.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in names])
