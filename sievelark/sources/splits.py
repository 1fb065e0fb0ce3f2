"""Large CSV files with line breaks in quotes, and JSON files that are one array, read by many tasks a file.

Spark splits a text file at any line break, but a break may lie inside a quoted field or a record. Whether it does depends on all
bytes before it, and that dependence is a small state: inside quotes or not (CSV); inside a string or not, and the depth of
brackets (JSON). What a split of the file does to the state does not need the state itself, so

1. a first pass gives each split's effect for every state it can begin in (one short row a split),
2. the effects are composed along each file, which gives the state at the beginning of every split,
3. a second pass cuts the splits into records. A record that lies in one split is written as it is; the parts of one that crosses an edge
   are marked, and put together by file and place (at most two parts a split).

Both passes see the same splits: they are planned in a session of their own whose split size is fixed and does not
depend on the cores of the cluster. A split unknown to the first pass means that a file was changed meanwhile, and is an error.
The records are written to the shared folder once, so finding types and all later passes read them and not the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelark.plans.shared import new_path

_WINDOW = 1 << 20
_WHOLE, _OPENED, _CONTINUED, _CLOSED = range(4)
"""A record; the first part of one that goes on in the next split; a part that goes on; its last part."""

_PARTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("value", pa.binary())])
_PARTS_DDL = "file string, start long, kind int, first boolean, value binary"

Key = tuple[str, int]


def split_session(spark: SparkSession, split_bytes: int) -> SparkSession:
    """A session in which files are cut every ``split_bytes``, whatever the cluster."""
    own = spark.newSession()
    for name, value in (("maxPartitionBytes", split_bytes), ("openCostInBytes", split_bytes), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{name}", str(value))
    return own


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file, from the listing alone."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def _pieces(own: SparkSession, path: str, separator: str) -> DataFrame:
    text = own.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Key, pa.Array]]:
    """The pieces of a batch by split; those of one split follow each other."""
    file, start = batch.column(0), batch.column(1).to_numpy()
    if not len(start):
        return
    change = start[1:] != start[:-1]
    change |= pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(start)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield (file[low].as_py(), int(start[low])), batch.column(2).slice(low, high - low)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Key, pa.Array, bool]]:
    """Key and pieces, and whether the split begins here."""
    before = None
    for batch in batches:
        for key, values in _runs(batch):
            yield key, values, key != before
            before = key


def _effects(pieces: DataFrame, begin: list[int], step: Callable) -> dict[str, list[tuple[int, list[int]]]]:
    """Effect of each split, by file and in order; a row a split, of which the driver plans a task each anyhow."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([held], pa.list_(pa.int64()))],
                                              names=["file", "start", "effect"])

        for own, values, new in _by_split(batches):
            if new:
                if key is not None:
                    yield row()
                key, held = own, begin
            held = step(held, values)
        if key is not None:
            yield row()

    found: dict[str, list[tuple[int, list[int]]]] = {}
    for r in pieces.mapInArrow(summed, "file string, start long, effect array<long>").collect():
        found.setdefault(r.file, []).append((r.start, [int(x) for x in r.effect]))
    return {file: sorted(rows) for file, rows in found.items()}


class _Out:
    """Rows of the second pass of one task, given out in batches."""

    def __init__(self):
        self.rows: list[tuple[Key, int, bool, bytes]] = []

    def batch(self) -> pa.RecordBatch:
        keys, kinds, firsts, values = zip(*self.rows, strict=True)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()),
                                           pa.array(kinds, pa.int32()), pa.array(firsts), pa.array(values, pa.binary())], schema=_PARTS)


def _cut(pieces: DataFrame, states: dict[Key, tuple[int, ...]], cutter: Callable, path: str, spark: SparkSession) -> DataFrame:
    """Write the records and parts of records of all splits; what ``cutter(state)`` holds does the work for a split."""
    sent = pieces.sparkSession.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, work, out = sent.value, None, None, _Out()
        for own, values, new in _by_split(batches):
            if new:
                if work is not None:
                    work.finish(out, key)
                if own not in known:
                    raise RuntimeError(f"{own[0]} was changed while it was read")
                key, work = own, cutter(known[own])
            yield from work.take(values, out, key)
            if len(out.rows) >= 1000:
                yield out.batch()
        if work is not None:
            work.finish(out, key)
        if out.rows:
            yield out.batch()

    pieces.mapInArrow(cut, _PARTS_DDL).write.parquet(path)
    return spark.read.schema(_PARTS_DDL).parquet(path)


def _joined(stored: DataFrame, separator: bytes, ended: bool) -> DataFrame:
    """The records that cross an edge, put together from their parts: at most two a split. With ``ended``, only those with a last part."""
    parts = stored.filter(F.col("kind") != _WHOLE)
    place = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == _OPENED, 1).otherwise(0))
    numbered = parts.withColumns({"number": F.sum(F.when(F.col("kind") == _OPENED, 1).otherwise(0)).over(place),
                                  "at": F.row_number().over(place)})
    whole = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("at", "value", "first"))).alias("p"), F.bool_or(F.col("kind") == _CLOSED).alias("last"))
    text = F.transform("p", lambda x: x["value"].cast("string"))
    if ended:
        whole = whole.filter("last")
    return whole.select(F.array_join(text, separator.decode()).alias("value"), F.col("p")[0]["first"].alias("first"))


def _records(stored: DataFrame, separator: bytes, ended: bool = False) -> DataFrame:
    """All records as text, without those marked as first of a file."""
    inner = stored.filter(F.col("kind") == _WHOLE).select(F.col("value").cast("string").alias("value"), "first")
    return inner.unionByName(_joined(stored, separator, ended)).filter(~F.col("first")).select("value")


# --- CSV ------------------------------------------------------------------------------------

_QUOTED = rb'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rb'(?:' + _QUOTED + rb'"[^,]*+|[^",][^,]*+|)'
_FROM_OUTSIDE = re.compile(rb"(?:" + _FIELD + rb",)*+" + _QUOTED)
_FROM_INSIDE = re.compile(rb'[^"]*+(?:""[^"]*+)*+(?:"[^,]*+,(?:' + _FIELD + rb",)*+" + _QUOTED + rb")?+")
"""Lines after which a quoted field is open. A quote opens a field only at its beginning, a quote after other text is text; what
follows a closing quote belongs to the field up to the next comma, as Spark's own reader has it."""


def _open_after(line: bytes, inside: int) -> int:
    return int((_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line) is not None)


def _csv_step(effect: list[int], lines: pa.Array) -> list[int]:
    """The state after these lines, for a split that begins outside and inside quotes."""
    for line in pc.drop_null(lines).to_pylist():
        both = [_open_after(line, 0), _open_after(line, 1)]
        effect = [both[effect[0]], both[effect[1]]]
    return effect


class _CsvCutter:
    """Cuts the lines of a split into records; lines of a record are joined by the break between them."""

    def __init__(self, state: tuple[int, ...]):
        self.inside, at_start = state
        self.first = bool(at_start)
        self.crosses = bool(self.inside)  # what is held began in a split before
        self.held: list[bytes] = []

    def take(self, lines: pa.Array, out: _Out, key: Key) -> Iterator[pa.RecordBatch]:
        after = np.zeros(len(lines), np.int8)  # the state after each line
        quoted = np.flatnonzero(pc.match_substring(lines, b'"').to_numpy(zero_copy_only=False))
        low, state = 0, self.inside
        for at in quoted.tolist():
            after[low:at] = state
            state = _open_after(lines[at].as_py(), state)
            after[at] = state
            low = at + 1
        after[low:] = state
        self.inside = state
        ends = np.flatnonzero(after == 0)
        if not len(ends):
            self.held += lines.to_pylist()
            return
        at = 0
        if self.held or self.crosses or self.first:  # the record that was begun, or the first of the file
            at = int(ends[0]) + 1
            self.held += lines[:at].to_pylist()
            out.rows.append((key, _CLOSED if self.crosses else _WHOLE, self.first, b"\n".join(self.held)))
            self.held, self.crosses, self.first = [], False, False
            ends = ends[1:]
        if len(ends):
            if out.rows:
                yield out.batch()
            high = int(ends[-1]) + 1
            limits = pa.array(np.concatenate([[0], ends + 1 - at]).astype(np.int32))
            values = pc.binary_join(pa.ListArray.from_arrays(limits, lines[at:high].cast(pa.binary())), b"\n")
            count = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]]).take(pa.array(np.zeros(count, np.int64))), pa.array(np.full(count, key[1])),
                 pa.array(np.full(count, _WHOLE, np.int32)), pa.array(np.zeros(count, bool)), values.cast(pa.binary())], schema=_PARTS)
            at = high
        self.held = lines[at:].to_pylist()

    def finish(self, out: _Out, key: Key) -> None:
        if self.held:
            out.rows.append((key, _CONTINUED if self.crosses else _OPENED, self.first, b"\n".join(self.held)))


def _ddl(schema) -> str:
    return ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema.fields)


def read_csv_splits(spark: SparkSession, path: str, schema, split_bytes: int) -> DataFrame:
    """A CSV file in UTF-8 with a header line, every split of it a task.

    ``schema`` names the columns. Records come in the order of the splits, those that cross an edge last. Empty lines are no records.
    A file that ends inside quotes ends its last record there.
    """
    own = split_session(spark, split_bytes)
    lines = _pieces(own, path, "\n")
    marked = lines.withColumn("value", F.when(F.contains(F.col("value"), F.lit(b'"')), F.col("value")))
    effects = _effects(marked, [0, 1], _csv_step)
    states = {}
    for file, rows in effects.items():
        state = 0
        for start, effect in rows:
            states[file, start] = (state, int(start == 0))
            state = effect[state]
    stored = _cut(lines, states, _CsvCutter, new_path(spark, "csv-records"), spark)
    value = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    records = _records(stored, b"\n").select(value.alias("value")).filter(F.col("value") != "")
    parsed = F.from_csv("value", _ddl(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(parsed.alias("r")).select("r.*")


# --- JSON arrays ----------------------------------------------------------------------------

_QUOTE, _BACKSLASH, _OPENING, _CLOSING, _MARK = 34, 92, 123, 125, 3
_STEPS = np.zeros(256, dtype=np.int64)
_STEPS[[91, 123]], _STEPS[[93, 125]] = 1, -1


def _byte_windows(pieces: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of the pieces, each with the brace that ended it, about ``_WINDOW`` at a time."""
    pieces = pieces.cast(pa.large_binary())
    _, limits, data = pieces.buffers()
    offsets = np.frombuffer(limits, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _WINDOW, "right")) - 1)
        ends = offsets[first + 1 : last + 1] - offsets[first]
        yield np.insert(raw[offsets[first] : offsets[last]], ends, _CLOSING)
        first = last


def _strings_open(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Whether each byte lies in a string, for a window that begins outside one, and the state at its end."""
    quotes = np.flatnonzero(data == _QUOTE)
    other = np.flatnonzero(data != _BACKSLASH)  # a quote behind an odd number of backslashes is text
    before = np.searchsorted(other, quotes) - 1
    last = np.where(before >= 0, other[np.maximum(before, 0)], -1)
    real = quotes[(quotes - 1 - last) % 2 == 0]
    flips = np.zeros(len(data), np.int8)
    flips[real] = 1
    return np.cumsum(flips, dtype=np.int64) % 2, len(real) % 2


def _json_step(effect: list[int], pieces: pa.Array) -> list[int]:
    """State of strings and change of depth, for a split that begins outside and inside a string, and the bytes."""
    inside0, depth0, inside1, depth1, size = effect
    for data in _byte_windows(pieces):
        within, flips = _strings_open(data)
        steps = _STEPS[data]
        change = [int(steps[within == 0].sum()), int(steps[within == 1].sum())]
        depth0 += change[inside0]
        depth1 += change[inside1]
        inside0, inside1, size = inside0 ^ flips, inside1 ^ flips, size + len(data)
    return [inside0, depth0, inside1, depth1, size]


class _JsonCutter:
    """Cuts the objects of the outermost array out of a split."""

    def __init__(self, state: tuple[int, ...]):
        self.inside, self.depth, self.unended = state
        self.held: list[bytes] = []
        self.open = self.crosses = self.depth > 1
        self.last: pa.Array | None = None

    def take(self, pieces: pa.Array, out: _Out, key: Key) -> Iterator[pa.RecordBatch]:
        if self.unended:  # the last piece of the file had no brace behind it and ends nothing
            pieces = pieces if self.last is None else pa.concat_arrays([self.last, pieces])
            pieces, self.last = pieces[:-1], pieces[-1:]
        for data in _byte_windows(pieces):
            within, flips = _strings_open(data)
            real = within == self.inside
            depth = self.depth + np.cumsum(np.where(real, _STEPS[data], 0))
            begins = np.flatnonzero(real & (data == _OPENING) & (depth == 2))
            ends = np.flatnonzero(real & (data == _CLOSING) & (depth == 1))
            line = np.where((data == 10) | (data == 13), np.uint8(32), data).tobytes()  # breaks between tokens
            at = 0
            if self.open:
                at = int(ends[0]) + 1 if len(ends) else len(line)
                self.held.append(line[:at])
                if len(ends):
                    out.rows.append((key, _CLOSED if self.crosses else _WHOLE, False, b"".join(self.held)))
                    self.held, self.open, self.crosses = [], False, False
                    ends = ends[1:]
            out.rows += [(key, _WHOLE, False, line[a : b + 1]) for a, b in zip(begins.tolist(), ends.tolist(), strict=False)]
            if len(begins) > len(ends):
                self.held, self.open = [line[int(begins[-1]) :]], True
            self.inside ^= flips
            self.depth = int(depth[-1]) if len(depth) else self.depth
            if len(out.rows) >= 1000:
                yield out.batch()

    def finish(self, out: _Out, key: Key) -> None:
        if self.open and self.held:
            out.rows.append((key, _CONTINUED if self.crosses else _OPENED, False, b"".join(self.held)))


def array_to_lines(spark: SparkSession, path: str, split_bytes: int) -> str:
    """Write the objects of JSON arrays as JSON lines to the shared folder, every split of a file a task; the folder's path.

    Pieces end at closing braces, so a file without a line break splits as well. Elements that are no objects are left out, and so
    is an object the file breaks off in.
    """
    own = split_session(spark, split_bytes)
    pieces = _pieces(own, path, "}")
    effects = _effects(pieces, [0, 0, 1, 0, 0], _json_step)
    sizes = {r.path: r.length for r in own.read.format("binaryFile").load(path).select("path", "length").toLocalIterator()}
    states = {}
    for file, rows in effects.items():
        inside = depth = 0
        # every piece was given a brace; a byte order mark was skipped
        ended = sum(effect[4] for _, effect in rows) in (sizes[file], sizes[file] - _MARK)
        for start, effect in rows:
            states[file, start] = (inside, depth, int(not ended and start == rows[-1][0]))
            depth += effect[2 * inside + 1]
            inside = effect[2 * inside]
    stored = _cut(pieces, states, _JsonCutter, new_path(spark, "json-parts"), spark)
    lines = new_path(spark, "json-lines")
    _records(stored, b"", ended=True).write.text(lines)
    return lines
