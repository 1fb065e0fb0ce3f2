"""Equal rows: groups, counts and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.plans.joins import null_safe_join
from sievelark.plans.longform import quoted
from sievelark.plans.shared import write_shared

HASHED_ROWS = 50_000_000
"""From this size on, rows are first compared by hash so that whole rows are not shuffled."""


def fingerprint(columns: list[str]) -> Column:
    """64-bit hash of a row; NULL is marked, because the hash function alone skips it."""
    marked = [part for c in columns for part in (quoted(c), quoted(c).isNull())]
    return F.xxhash64(*marked)


def copy_groups(df: DataFrame, columns: list[str] | None = None, rows: int | None = None,
                hashed_rows: int = HASHED_ROWS) -> DataFrame:
    """(columns..., copies) of every group of two or more equal rows; NULLs are equal.

    Grouping combines copies before the shuffle, so a group that holds a third of all rows
    leaves one row per task. On large input the whole-row shuffle is spared for most rows:
    a row whose hash occurs once has no copy. Only rows with a repeated hash are grouped by
    value, which also separates rows that merely share a hash.
    """
    columns = list(columns or df.columns)
    rest = df
    if rows is not None and rows > hashed_rows:
        hashed = df.withColumn("__hash", fingerprint(columns))
        repeated = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__hash")
        # Written first: its exact size lets the planner broadcast it only if it is small.
        rest = hashed.join(write_shared(repeated, "repeated-hashes"), "__hash", "left_semi").drop("__hash")
    return rest.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("copies")).filter(
        F.col("copies") > 1
    )


def count_copies(df: DataFrame, columns: list[str] | None = None, rows: int | None = None,
                 hashed_rows: int = HASHED_ROWS) -> DataFrame:
    """One row ``duplicate_rows``: rows that repeat an earlier one."""
    groups = copy_groups(df, columns, rows, hashed_rows)
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def copy_members(df: DataFrame, columns: list[str] | None = None, rows: int | None = None,
                 hashed_rows: int = HASHED_ROWS) -> DataFrame:
    """Every row that has an equal one, with the size of its group."""
    columns = list(columns or df.columns)
    return null_safe_join(df, copy_groups(df, columns, rows, hashed_rows), columns, "inner")
