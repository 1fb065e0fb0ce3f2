"""Cleaning steps and the rule chain.

A step returns a lazy frame. Where it needs a statistic of the data (means, modes, gaps),
that is one aggregate whose result is a value per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelark.functions import roles
from sievelark.functions.predicates import parse_date, strip
from sievelark.operators.quality import keep_valid
from sievelark.plans.longform import all_rows_distinct_counts, per_column, quoted, top_values, value_counts
from sievelark.plans.ordered import GROUP_ROWS, carry_last
from sievelark.plans.quantiles import QUANTILE_ROWS, collect_quantiles
from sievelark.plans.rowid import in_file_order, with_row_index
from sievelark.plans.shared import write_shared

CATEGORY_LIMIT = 100
"""A text column with fewer distinct values than this counts as categorical on its own; a given mapping always applies."""


# --- copies -------------------------------------------------------------------------


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
                      order_by: list[str] | None = None) -> DataFrame:
    """One row per group of equal rows (``first``, ``last``) or none of them (``False``).

    Copies of whole rows are interchangeable, so no order is needed. With ``subset`` the
    rows of a group differ: ``order_by`` says which is first, else the file order does.
    ``row_number() = 1`` is cut to one row per key and task before the shuffle.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    keys = list(subset or df.columns)
    if keep is False:
        return _without_repeats(df, keys)
    if subset is None:
        return df.dropDuplicates()
    placed, order = df, list(order_by or [])
    if not order:
        placed, order = in_file_order(df)
    by = [quoted(c).desc() if keep == "last" else quoted(c).asc() for c in order]
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*by)
    return placed.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") == 1).select(
        *[quoted(c) for c in df.columns]
    )


def _without_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once: grouped with partial counts, so large groups stay small."""
    rest = [c for c in df.columns if c not in keys]
    picked = [F.first(quoted(c)).alias(c) for c in rest]
    return (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("__n"), *picked)
        .filter(F.col("__n") == 1)
        .select(*[quoted(c) for c in df.columns])
    )


# --- gaps ---------------------------------------------------------------------------


def gap_counts(df: DataFrame) -> dict[str, int]:
    """NULLs per column, columns without any left out."""
    found = per_column(df, df.columns, {"n": lambda c: F.count_if(c.isNull())}).filter(F.col("n") > 0)
    counted = {r["column"]: r["n"] for r in found.collect()}
    return {c: counted[c] for c in df.columns if c in counted}


def _filled_numbers(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Integers become DOUBLE where a computed number goes in."""
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({
        c: F.coalesce(quoted(c).cast("double"), F.lit(float(v))) for c, v in known.items()
    }) if known else df


def fill_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Only columns that have gaps change; one aggregate finds the gaps and the means."""
    columns = roles.existing(df, columns, roles.numeric_columns(df))
    if not columns:
        return df
    wanted = [F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    wanted += [F.avg(quoted(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]
    got = df.agg(*wanted).first()
    return _filled_numbers(df, {c: got[f"m{i}"] for i, c in enumerate(columns) if got[f"n{i}"]})


def _with_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    return list(gap_counts(df.select(*[quoted(c) for c in columns]))) if columns else []


def fill_median(df: DataFrame, columns: list[str] | None = None, limit: int = QUANTILE_ROWS) -> DataFrame:
    columns = _with_gaps(df, roles.existing(df, columns, roles.numeric_columns(df)))
    if not columns:
        return df
    found = collect_quantiles(df, columns, [0.5], limit=limit)
    return _filled_numbers(df, {c: q[0] for c, q in found.items()})


def modes(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Most frequent value per column, the smallest on a tie.

    Columns of one type share a scan and a shuffle. Counting by value keeps one row per
    distinct value and task, where an aggregate ``mode`` would hold all values in one task.
    """
    by_type: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        by_type.setdefault(kind.simpleString(), []).append(c)
    found: dict[str, Any] = {}
    for kind, group in by_type.items():
        best = top_values(value_counts(df, group, as_type=kind), 1)
        found.update({r["column"]: r["value"] for r in best.collect()})
    return found


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Only columns with gaps are counted by value."""
    wanted = _with_gaps(df, [c for c in (columns or df.columns) if c in df.columns])
    found = modes(df, wanted)
    return df.withColumns({
        c: F.coalesce(quoted(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in found.items()
    }) if found else df


def fill_forward(df: DataFrame, order_by: list[str], columns: list[str] | None = None,
                 partition_by: list[str] | None = None, unique: bool = False,
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each gap takes the nearest earlier value."""
    return _carried(df, order_by, columns, partition_by, False, unique, group_rows)


def fill_backward(df: DataFrame, order_by: list[str], columns: list[str] | None = None,
                  partition_by: list[str] | None = None, unique: bool = False,
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """Each gap takes the nearest later value."""
    return _carried(df, order_by, columns, partition_by, True, unique, group_rows)


def _carried(df: DataFrame, order_by: list[str], columns: list[str] | None, partition_by: list[str] | None,
             backward: bool, unique: bool, group_rows: int) -> DataFrame:
    keys = list(partition_by or [])
    wanted = [c for c in (columns or df.columns) if c not in keys and c not in order_by]
    filled = carry_last(df, wanted, keys, order_by, descending=backward, unique=unique, group_rows=group_rows)
    return filled.select(*[quoted(c) for c in df.columns])


def _fits(value: Any, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def fill_value(df: DataFrame, value: Any, columns: list[str] | None = None) -> DataFrame:
    """A constant (or a dict of constants per column) into columns of a matching type."""
    if isinstance(value, dict):
        wanted = {c: v for c, v in value.items() if c in df.columns}
    else:
        wanted = {c: value for c in (columns or df.columns) if _fits(value, df.schema[c].dataType)}
    changes: dict[str, Column] = {}
    for c, v in wanted.items():
        kind = df.schema[c].dataType
        if isinstance(v, float) and isinstance(kind, T.IntegralType):
            kind = T.DoubleType()
        changes[c] = F.coalesce(quoted(c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(changes) if changes else df


STRATEGIES = ("mean", "median", "mode", "forward_fill", "backward_fill", "value")


def fill_missing(df: DataFrame, strategy: str = "mean", value: Any = None,
                 order_by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Fill by strategy name. The carrying strategies use file order without ``order_by``."""
    if strategy == "mean":
        return fill_mean(df, columns)
    if strategy == "median":
        return fill_median(df, columns)
    if strategy == "mode":
        return fill_mode(df, columns)
    if strategy in ("forward_fill", "backward_fill"):
        carry = fill_forward if strategy == "forward_fill" else fill_backward
        if order_by:
            return carry(df, order_by, columns)
        placed = with_row_index(df, "__index")
        return carry(placed, ["__index"], columns or df.columns, unique=True).drop("__index")
    if strategy == "value":
        return df if value is None else fill_value(df, value, columns)
    raise ValueError(f"strategy must be one of {STRATEGIES}")


# --- text, dates, categories --------------------------------------------------------


def normalize_text(df: DataFrame, lowercase: list[str] | None = None) -> DataFrame:
    """Strip all text columns; lower-case those with a name for it."""
    texts = roles.string_columns(df)
    lowered = set(roles.existing(df, lowercase, roles.lowercase_columns(df)))
    return df.withColumns({
        c: F.lower(strip(quoted(c))) if c in lowered else strip(quoted(c)) for c in texts
    }) if texts else df


def date_candidates(df: DataFrame) -> list[str]:
    """Text columns with a date-like name; numbers are never read as dates."""
    texts = set(roles.string_columns(df))
    return [c for c in roles.date_text_columns(df, roles.DATE_CLEAN_PARTS) if c in texts]


def standardize_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Timestamps from text; what fits no format becomes NULL."""
    wanted = roles.existing(df, columns, date_candidates(df))
    return df.withColumns({c: parse_date(quoted(c)) for c in wanted}) if wanted else df


def categorical_columns(df: DataFrame, limit: int = CATEGORY_LIMIT) -> list[str]:
    texts = roles.string_columns(df)
    if not texts:
        return []
    counted = {r["column"]: r["unique_values"] for r in all_rows_distinct_counts(df, texts).collect()}
    return [c for c in texts if counted.get(c, 0) < limit]


def map_categories(df: DataFrame, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """Replace values by the column's mapping, however many the column has; other values and columns stay."""
    texts = set(roles.string_columns(df))
    for c, pairs in mapping.items():
        if c in texts and pairs:
            df = df.replace(pairs, subset=[c])
    return df


def category_inventory(df: DataFrame, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """(column, value, count) of the text columns with few distinct values."""
    columns = categorical_columns(df, limit)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    return value_counts(df, columns)


# --- rule chain ---------------------------------------------------------------------


@dataclass
class Rules:
    """Which steps run; they always run in this order."""

    remove_duplicates: bool = True
    fill_missing: bool = True
    fill_strategy: str = "mean"
    normalize_text: bool = True
    standardize_dates: bool = True
    standardize_categorical: bool = False
    remove_invalid: bool = False
    fill_value: Any = None
    order_by: list[str] | None = None
    categorical_mapping: dict[str, dict[str, str]] | None = None
    category_limit: int = CATEGORY_LIMIT
    validation_rules: dict | None = None


@dataclass
class Summary:
    initial_rows: int = 0
    final_rows: int = 0
    removed_duplicates: int = 0
    had_nulls: dict[str, int] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    normalized_text_columns: int = 0
    standardized_dates: int = 0
    removed_invalid_records: int = 0
    categorical_columns: list[str] = field(default_factory=list)


def apply_rules(df: DataFrame, rules: Rules | None = None) -> tuple[DataFrame, Summary]:
    """Copies, gaps, text, dates, categories, invalid rows: in this order.

    Copies go before text is trimmed, so rows that differ in padding both stay. The frame
    without copies is written once in the shared folder: the statistics of the later steps
    and the result then read that table instead of grouping all rows again.
    """
    rules = rules or Rules()
    done = Summary(initial_rows=df.count())
    shown, order = df.columns, rules.order_by
    if rules.fill_missing and rules.fill_strategy in ("forward_fill", "backward_fill") and not order:
        df, order = with_row_index(df, "__index"), ["__index"]  # file order, kept through the next step
    if rules.remove_duplicates:
        single = remove_duplicates(df) if df.columns == shown else remove_duplicates(df, shown, "first", order)
        df = write_shared(single, "without-copies")
        done.removed_duplicates = done.initial_rows - df.count()
    if rules.fill_missing:
        done.had_nulls = gap_counts(df.select(*[quoted(c) for c in shown]))
        gaps = list(done.had_nulls)
        if gaps:
            fillable = [c for c in gaps if rules.fill_strategy not in ("mean", "median")
                        or c in roles.numeric_columns(df)]
            if fillable:
                df = fill_missing(df, rules.fill_strategy, rules.fill_value, order, fillable)
                left = gap_counts(df.select(*[quoted(c) for c in fillable]))
                done.filled = {c: done.had_nulls[c] - left.get(c, 0) for c in fillable
                               if done.had_nulls[c] > left.get(c, 0)}
    df = df.select(*[quoted(c) for c in shown])
    if rules.normalize_text:
        done.normalized_text_columns = len(roles.lowercase_columns(df))
        df = normalize_text(df)
    if rules.standardize_dates:
        done.standardized_dates = len(date_candidates(df))
        df = standardize_dates(df)
    if rules.standardize_categorical:
        done.categorical_columns = categorical_columns(df, rules.category_limit)
        if rules.categorical_mapping:
            df = map_categories(df, rules.categorical_mapping)
    before_filter = done.initial_rows - done.removed_duplicates
    done.final_rows = before_filter
    if rules.remove_invalid and rules.validation_rules:
        df = keep_valid(df, rules.validation_rules)
        done.final_rows = df.count()
        done.removed_invalid_records = before_filter - done.final_rows
    return df, done
