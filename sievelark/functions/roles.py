"""Column roles read from names and types.

Every operator that relies on a role also takes the columns explicitly; these rules are
the defaults. They are substring rules, so ``count`` also matches ``discount``, ``time``
matches ``lifetime`` and ``tel`` matches ``hotel``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name parts that give a column its role.
PHONE_PARTS = ("phone", "tel")
DATE_CHECK_PARTS = ("date", "time", "created", "updated")
DATE_CLEAN_PARTS = ("date", "time", "created", "updated", "timestamp")
DATE_TREND_PARTS = ("date", "time")
DATE_KPI_PARTS = ("date",)
AMOUNT_KPI_PARTS = ("amount", "revenue", "total")
QUANTITY_KPI_PARTS = ("quantity", "qty")
NON_NEGATIVE_PARTS = ("quantity", "amount", "count", "price")
LOWERCASE_PARTS = ("email", "name", "category", "type")

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def has_part(name: str, parts: tuple[str, ...]) -> bool:
    lowered = name.lower()
    return any(part in lowered for part in parts)


def named_like(df: DataFrame, parts: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if has_part(c, parts)]


def first_named_like(df: DataFrame, parts: tuple[str, ...]) -> str | None:
    return next(iter(named_like(df, parts)), None)


def first_date_like(df: DataFrame, parts: tuple[str, ...]) -> str | None:
    """The first date column with such a name, else the first text column; numbers are no dates."""
    named = named_like(df, parts)
    typed, texts = set(date_columns(df)), set(string_columns(df))
    return next((c for c in named if c in typed), None) or next((c for c in named if c in texts), None)


def first_number_like(df: DataFrame, parts: tuple[str, ...]) -> str | None:
    """The first numeric column with such a name, else the first text column, which is read as numbers."""
    named = named_like(df, parts)
    numbers, texts = set(numeric_columns(df)), set(string_columns(df))
    return next((c for c in named if c in numbers), None) or next((c for c in named if c in texts), None)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans are not numbers here."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _DATE_TYPES)]


def existing(df: DataFrame, columns: list[str] | None, default: list[str]) -> list[str]:
    """``columns`` that exist in ``default``, in the caller's order; all when None or empty."""
    return [c for c in columns if c in default] if columns else default


def phone_columns(df: DataFrame) -> list[str]:
    return named_like(df, PHONE_PARTS)


def date_text_columns(df: DataFrame, parts: tuple[str, ...] = DATE_CHECK_PARTS) -> list[str]:
    typed = set(date_columns(df))
    return [c for c in named_like(df, parts) if c not in typed]


def non_negative_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if has_part(c, NON_NEGATIVE_PARTS)]


def lowercase_columns(df: DataFrame) -> list[str]:
    return [c for c in string_columns(df) if has_part(c, LOWERCASE_PARTS)]
