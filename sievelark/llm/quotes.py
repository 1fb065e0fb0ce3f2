"""Quotation linking: conversations in reply order without quotes, in DataFrame operations only.

1. Lines of messages that quote are parsed: their level is the number of leading ``>``. Neighbouring lines of one level
   form a passage; blank lines end it. A line that announces the quote below it ("... wrote:") belongs to the quote.
2. Passages, and their lines and sentences one by one, are normalised (lower case, single spaces) and hashed.
3. A quoted passage is joined to the latest earlier message of its conversation whose own text, a paragraph, a line or a sentence
   of it has the hash of the passage or of one of its lines or sentences. The lookup runs in blocks of ``BLOCK_TURNS`` turns, with the last hit of earlier
   blocks carried forward, so neither a long conversation nor a common passage gathers in one task.
4. A message replies to the message that its longest linked passage of the lowest level comes from. Threads are followed to
   their first message by pointer doubling. Rows come ordered by conversation, thread and turn: a reply comes after what
   it answers, and threads stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelark.plans.shared import write_shared

BLOCK_TURNS = 1024
QUOTED = r"(?m)^[ \t]*>"
LINE_END = r"\r\n|\r|\n"
PREFIX = r"^[ \t]*>(?:[ \t]*>)*"
ANNOUNCED = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"

SENTENCE_END = r"(?<=[.!?\u2026\u3002]) "

_KEY = ["conv_id", "turn"]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(text: Column) -> Column:
    """The sentences of a normalised text, with their signs."""
    return F.split(text, SENTENCE_END)


def quote_lines(messages: DataFrame) -> DataFrame:
    """A row for each line of the messages: level, body, number of its passage (run) and whether it announces a quote."""
    lines = messages.select("row", *_KEY, F.posexplode(F.split("text", LINE_END)).alias("place", "line"))
    prefix = F.regexp_extract("line", PREFIX, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(prefix, "[^>]", "")))
    lines = lines.withColumn("body", F.expr(rf"substring(line, length(regexp_extract(line, r'{PREFIX}', 0)) + 1)"))
    lines = lines.withColumn("body", F.when(F.col("level") > 0, F.trim("body")).otherwise(F.col("line")))
    order = Window.partitionBy("row").orderBy("place")
    blank = F.trim("body") == ""
    lines = lines.withColumn("announces", F.col("body").rlike(ANNOUNCED) & (
        F.coalesce(F.lead("level").over(order), F.lit(0)) > F.col("level")))
    lines = lines.withColumn("breaks", blank | F.col("announces"))
    new = F.coalesce((F.lag("level").over(order) != F.col("level")) | F.lag("breaks").over(order) | F.col("breaks"), F.lit(True))
    return lines.withColumn("run", F.sum(new.cast("int")).over(order))


def passages(lines: DataFrame) -> DataFrame:
    """row, conv_id, turn, level, run, key (hash) and weight of all passages and of their single lines and sentences."""
    whole = lines.filter(~F.col("breaks")).groupBy("row", *_KEY, "level", "run").agg(
        F.sort_array(F.collect_list(F.struct("place", "body"))).alias("lines"))
    bodies = F.transform("lines", lambda s: normalised(s.body))
    joined = whole.select("row", *_KEY, "level", "run", bodies.alias("bodies"), normalised(F.array_join(bodies, " ")).alias("joined"))
    pieces = F.array_distinct(F.concat(F.array("joined"), "bodies", sentences(F.col("joined"))))
    return joined.select("row", *_KEY, "level", "run", F.explode(pieces).alias("piece")).filter("piece <> ''").select(
        "row", *_KEY, "level", "run", F.xxhash64("piece").alias("key"), F.length("piece").alias("weight"))


def own_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn and key of the whole text, the paragraphs, the lines and the sentences of messages without quotes."""
    parts = F.concat(sentences(normalised(F.col("text"))), F.array(F.col("text")), F.split("text", r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)"), F.split("text", LINE_END))
    pieces = F.array_distinct(F.transform(parts, normalised))
    return messages.select(*_KEY, F.explode(pieces).alias("piece")).filter("piece <> ''").select(
        *_KEY, F.xxhash64("piece").alias("key"))


def latest_before(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """``quotes`` (conv_id, turn, key, ...) with ``found``, the largest turn below theirs among ``originals`` of the same key."""
    by = ["conv_id", "key"]
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    origin = originals.select(*by, "turn").distinct().withColumn("block", block)
    asked = quotes.select(*by, "turn").distinct().withColumn("block", block)
    both = origin.select(*by, "turn", "block", F.lit(1).alias("kind")).unionByName(
        asked.select(*by, "turn", "block", F.lit(0).alias("kind")))
    inside = Window.partitionBy(*by, "block").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("kind") == 1, F.col("turn"))).over(inside)).filter("kind = 0")
    blocks = both.groupBy(*by, "block").agg(F.max(F.when(F.col("kind") == 1, F.col("turn"))).alias("last"))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.max("last").over(earlier)).select(*by, "block", "carried")
    found = near.join(blocks, [*by, "block"], "left").select(*by, "turn", F.coalesce("near", "carried").alias("found"))
    return quotes.join(found, [*by, "turn"], "left")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (first turn) and depth, by pointer doubling over (conv_id, turn, reply_to)."""
    state = write_shared(links.select(*_KEY, "reply_to", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        above = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        joined = state.join(above, ["conv_id", "thread"], "left")
        further = joined.select(*_KEY, "reply_to", F.coalesce("up", "thread").alias("thread"),
                                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "up")
        further = write_shared(further, "threads")
        state = further.drop("up")
        if further.filter("up IS NOT NULL").isEmpty():
            return state


def linked_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """A row for each message, in reply order: conv_id, turn, role, text (without quotes), reply_to, thread, depth,
    n_quotes, n_linked and formatted (role and text as a chat turn).

    A message without a linked quote has no reply_to, depth 0 and is the first of its thread. NULL texts stay NULL and
    neither quote nor are quoted; a NULL role is formatted as ``unknown``. Rows without conv_id or turn
    are never linked. Messages that repeat a conv_id and turn each stay, and share one reply_to: that of their longest linked
    passage. Other columns are not read; an empty table gives an empty result.
    """
    rows = write_shared(messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "messages")
    quoting = rows.filter(F.col("text").rlike(QUOTED))
    nothing = F.lit(None).cast("long")
    if quoting.isEmpty():  # nothing to join: the same result without moving the texts
        result = rows.select(*_KEY, "role", "text", nothing.alias("reply_to"), F.col("turn").alias("thread"),
                             F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"))
        return _ordered(result)

    lines = write_shared(quote_lines(quoting), "lines")
    parts = write_shared(passages(lines), "passages")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    talks = quoting.filter(placed).select("conv_id").distinct()
    plain = rows.filter(placed & ~F.coalesce(F.col("text").rlike(QUOTED), F.lit(True))).join(talks, "conv_id", "left_semi")
    originals = own_passages(plain).unionByName(parts.filter(placed & (F.col("level") == 0)).select(*_KEY, "key"))
    quotes = latest_before(parts.filter(placed & (F.col("level") > 0)), originals)
    found = quotes.filter("found IS NOT NULL")
    best = F.max_by("found", F.struct(-F.col("level"), "weight", "found"))
    links = threads(found.groupBy(*_KEY).agg(best.alias("reply_to")))
    counts = parts.filter("level > 0").groupBy("row").agg(F.count_distinct("run").alias("n_quotes"))
    hits = found.groupBy("row").agg(F.count_distinct("run").alias("n_linked"))
    kept = lines.filter(~F.col("announces") & (F.col("level") == 0)).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("place", "body"))).alias("kept"))
    kept = kept.select("row", F.regexp_replace(
        F.array_join(F.col("kept.body"), "\n"), r"^\s+|\s+$", "").alias("clean"))
    figures = quoting.select("row").join(kept, "row", "left").join(counts, "row", "left").join(hits, "row", "left")
    result = rows.join(figures.withColumn("quoted", F.lit(True)), "row", "left").join(links, _KEY, "left")
    result = result.select(
        *_KEY, "role", F.when(F.col("quoted"), F.coalesce("clean", F.lit(""))).otherwise(F.col("text")).alias("text"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    return _ordered(result)


def _ordered(result: DataFrame) -> DataFrame:
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>"))
    return result.withColumn("formatted", chat).orderBy("conv_id", "thread", "turn", "text")
