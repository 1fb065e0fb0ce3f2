"""Ordered windows whose groups may be too large for one task.

Small groups use a plain ``Window``. A group with more rows than ``group_rows`` is sorted
with a range shuffle over keys *and* order columns, so that it spreads over many tasks,
and is written once to freeze the slice limits. Row positions follow from the slice
sizes. Windows with a bounded frame then run per block of consecutive positions; rows
near a block edge are copied into the neighbour block so that each frame is whole there.
Cumulative functions add a prefix over the per-block totals.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelark.plans.joins import null_safe_join
from sievelark.plans.shared import is_scan, with_source, write_shared

GROUP_ROWS = 4_000_000
"""Most rows of one group that a single task sorts."""

BROADCAST_ROWS = 500_000
"""Most slices whose summary is sent to all tasks; more are joined by a shuffle."""

_NARROW = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
POSITION = "__position"
BLOCK = "__block"
HOME = "__home"
PLACE = "__place"
_SERIAL = "__serial"
_SLICE = "__slice"
_SLICE_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


@dataclass(frozen=True)
class Ordered:
    """Rows prepared for windows over ``keys`` in order."""

    df: DataFrame
    window: WindowSpec
    keys: list[str]
    split: bool
    blocks: float = 0

    def row_number(self) -> Column:
        """Position in the whole group, from 1. Not to be mixed with edge copies dropped."""
        local = F.row_number().over(self.window).cast("long")
        return F.coalesce(F.col(POSITION) + 1, local) if self.split else local

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop edge copies and helper columns after the windows were evaluated."""
        if not self.split:
            return df
        return df.filter(F.col(BLOCK) == F.col(HOME)).drop(POSITION, BLOCK, HOME)


def _sort_columns(keys: list[str], order: list[str], descending: bool) -> list[Column]:
    return [F.col(k) for k in keys] + [F.col(c).desc() if descending else F.col(c) for c in order]


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def located(df: DataFrame) -> DataFrame:
    """``df``, written once unless it is a scan, each row with its place: a hash of the file and the position in it.

    The place tells equal rows apart and stays the same when a task runs again. No column but the place is added on the way,
    so the frame's own columns may have any name.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(PLACE)
    placed = with_source(df, place) if is_scan(df) else None
    return placed if placed is not None else write_shared(df, "rows").select("*", place)


def slices_in_order(df: DataFrame, keys: list[str], order: list[str], descending: bool, rows: int,
                    slice_rows: int) -> DataFrame:
    """``df`` written in slices that follow one another, with slice number and serial number.

    Keys, order columns and, if the frame has it, the place of the row decide the order, so
    a group of equal rows is spread over slices like any other.
    """
    place = [F.col(f"{PLACE}.file"), F.col(f"{PLACE}.at")] if PLACE in df.columns else []
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = _sort_columns(keys, order, descending) + place
    sliced = (
        df.repartitionByRange(max(usual, ceil(rows / slice_rows)), *by)
        .sortWithinPartitions(*by)
        .withColumn(_SERIAL, F.monotonically_increasing_id())
        .drop(PLACE)
    )
    return write_shared(sliced, "slices").withColumn(
        _SLICE, F.shiftright(F.col(_SERIAL), _SLICE_BITS).cast("int")
    )


def add_positions(df: DataFrame, keys: list[str], order: list[str], descending: bool, rows: int,
                  slice_rows: int = GROUP_ROWS // 2) -> DataFrame:
    """``__position`` (from 0) of each row in its group, by a range shuffle of all rows."""
    sliced = slices_in_order(df, keys, order, descending, rows, slice_rows)
    parts = sliced.groupBy(*keys, _SLICE).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_SERIAL).alias("__first")
    )
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    if rows / slice_rows <= BROADCAST_ROWS:  # a row per slice and per large key, of some 50 bytes
        parts = F.broadcast(parts)
    placed = null_safe_join(sliced, parts, [*keys, _SLICE], "inner")
    return placed.withColumn(
        POSITION, F.col("__before") + F.col(_SERIAL) - F.col("__first")
    ).drop(_SERIAL, _SLICE, "__rows", "__first", "__before")


def ordered(df: DataFrame, keys: list[str], order: list[str], descending: bool = False,
            before: int = 0, after: int = 0, unique: bool = False,
            group_rows: int = GROUP_ROWS) -> Ordered:
    """Prepare ``df`` for windows that look ``before`` rows back and ``after`` rows ahead.

    All order columns run in one direction. They should decide the order of any two rows
    that differ in the columns the result shows. The size check is one aggregate over the
    key columns; only keys above ``group_rows`` take the range shuffle. ``unique`` says that
    the order columns of a window without keys tell all rows apart.
    """
    keys, order = list(keys), list(order)
    plain = Window.partitionBy(*keys).orderBy(*_sort_columns([], order, descending))
    if not keys:
        total = df.count()
        if total <= group_rows:
            return Ordered(df, plain, keys, False)
        hot, cold = df if unique else located(df), None
    else:
        large = group_sizes(df, keys).filter(F.col("rows") > group_rows)
        found = large.agg(F.sum("rows")).first()[0]
        if found is None:
            return Ordered(df, plain, keys, False)
        total = found
        large = write_shared(large.select(*keys), "large-groups")
        if total / group_rows <= BROADCAST_ROWS:  # no more keys than this can be that large
            large = F.broadcast(large)
        stored = located(df)  # read twice from here on, instead of computing df twice
        hot = null_safe_join(stored, large, keys, "left_semi")
        cold = null_safe_join(stored, large, keys, "left_anti").drop(PLACE)

    block_rows = max(group_rows, before, after)
    placed = add_positions(hot, keys, order, descending, total)
    inside = F.col(POSITION) % block_rows
    home = F.floor(F.col(POSITION) / block_rows).cast("long")
    copies = [F.col(HOME)]
    if before:
        copies.append(F.when(inside >= block_rows - before, F.col(HOME) + 1))
    if after:
        copies.append(F.when((inside < after) & (F.col(HOME) > 0), F.col(HOME) - 1))
    placed = placed.withColumn(HOME, home)
    if len(copies) == 1:
        placed = placed.withColumn(BLOCK, F.col(HOME))
    else:
        placed = placed.withColumn(
            BLOCK, F.explode(F.filter(F.array(*copies), lambda b: b.isNotNull()))
        )
    if cold is not None:
        none = F.lit(None).cast("long")
        placed = cold.select(
            "*", none.alias(POSITION), F.lit(0).cast("long").alias(HOME), F.lit(0).cast("long").alias(BLOCK)
        ).unionByName(placed)
    # Positions alone order split rows, so the order columns need not be carried on; the rows of small groups have none.
    others = [] if cold is None else _sort_columns([], order, descending)
    window = Window.partitionBy(*keys, BLOCK).orderBy(F.col(POSITION), *others)
    return Ordered(placed, window, keys, True, total / block_rows)


def _with_prefix(rows: Ordered, df: DataFrame, summary: list[Column], prefix: list[Column]) -> DataFrame:
    """Join what the earlier blocks of the same key add up to.

    A first block has nothing before it, so the joined table has a row per further block of
    a large group: its size is the number of rows over ``group_rows``. It is broadcast if all its
    columns have values of a few bytes; texts may be of any length.
    """
    blocks = df.groupBy(*rows.keys, BLOCK).agg(*summary)
    blocks = blocks.select(*rows.keys, BLOCK, *prefix).filter(F.col(BLOCK) > 0)
    if rows.blocks <= BROADCAST_ROWS and all(isinstance(f.dataType, _NARROW) for f in blocks.schema):
        blocks = F.broadcast(blocks)
    return null_safe_join(df, blocks, [*rows.keys, BLOCK], "left")


def _earlier_blocks(rows: Ordered) -> WindowSpec:
    return Window.partitionBy(*rows.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, value: str, out: str, keys: list[str], order: list[str],
                unique: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sum of ``value`` from the first row of the group to the current row."""
    rows = ordered(df, keys, order, unique=unique, group_rows=group_rows)
    upto = rows.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.df.withColumn(out, F.sum(value).over(upto))
    if not rows.split:
        return local
    joined = _with_prefix(
        rows, local, [F.sum(value).alias("__total")],
        [F.sum("__total").over(_earlier_blocks(rows)).alias("__carry")],
    )
    total = F.when(
        F.col(out).isNotNull() | F.col("__carry").isNotNull(),
        F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col("__carry"), F.lit(0)),
    )
    return rows.finish(joined.withColumn(out, total).drop("__carry"))


def carry_last(df: DataFrame, columns: list[str], keys: list[str], order: list[str],
               descending: bool = False, unique: bool = False,
               group_rows: int = GROUP_ROWS) -> DataFrame:
    """Replace NULL by the nearest earlier value of the group (later, if ``descending``)."""
    rows = ordered(df, keys, order, descending, unique=unique, group_rows=group_rows)
    upto = rows.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not rows.split:
        return rows.df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    place = F.col(POSITION)
    summary = [
        F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__last_{c}") for c in columns
    ]
    prefix = [
        F.last(f"__last_{c}", ignorenulls=True).over(_earlier_blocks(rows)).alias(f"__carry_{c}")
        for c in columns
    ]
    local = _with_prefix(rows, rows.df, summary, prefix).withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"__carry_{c}")) for c in columns}
    )
    return rows.finish(local.drop(*[f"__carry_{c}" for c in columns]))
