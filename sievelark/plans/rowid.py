"""Row positions in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelark.plans.ordered import ordered
from sievelark.plans.shared import is_picked, is_scan, with_place, write_shared

BROADCAST_FILES = 500_000
"""Most files whose sizes are sent to all tasks; more are joined by a shuffle."""

_SOURCE = ["__source_file", "__source_at"]


def _numbered_files(placed: DataFrame) -> DataFrame:
    """Numbers in place of paths, so that a sorted row carries a few bytes: source files by name, written files by a hash."""
    source = _SOURCE[0]
    names = write_shared(placed.select(source).distinct().withColumn(
        "__number", F.row_number().over(Window.orderBy(source))), "files")  # one row per file
    if len(placed.inputFiles()) <= BROADCAST_FILES:
        names = F.broadcast(names)
    return placed.withColumn("__file", F.xxhash64("__file")).join(names, source).drop(source).withColumnRenamed("__number", source)


def in_file_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that put its rows in file order: files by name, rows as they lie in the file.

    Unlike positions they need no sort of all rows. Rows picked from a scan keep their place there; of any other frame
    the written rows have one, after the place they come from if there is any.
    """
    origin = with_place(df, *_SOURCE)
    if origin is not None and is_picked(df):
        return origin, list(_SOURCE)
    order = ["__file", "__at"] if origin is None else [*_SOURCE, "__file", "__at"]
    return with_place(write_shared(df if origin is None else origin, "file-order"), "__file", "__at"), order


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Contiguous position from 0: files by name, rows as they lie in the file.

    A Parquet scan knows each row's place in its file, so only the file sizes are summed. A frame
    that filters or multiplies the rows of a scan is written once with their places, and its rows are
    numbered in the order of place and written row. Any other frame is written once, which fixes the
    order of its rows.
    """
    placed = with_place(df, "__file", "__at") if is_scan(df) else None
    if placed is None:
        origin = with_place(df, *_SOURCE)
        stored = write_shared(df if origin is None else origin, "row-index")
        placed = with_place(stored, "__file", "__at")
        if origin is not None:
            rows = ordered(_numbered_files(placed), [], [*_SOURCE, "__file", "__at"], unique=True)
            numbered = rows.finish(rows.df.withColumn(name, rows.row_number() - 1))
            return numbered.drop(*_SOURCE, "__file", "__at")
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    if len(placed.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return placed.join(starts, "__file").withColumn(name, F.col("__start") + F.col("__at")).drop(
        "__file", "__at", "__start"
    )
