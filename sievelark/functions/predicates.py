"""Value checks and normalisers as Columns (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and formats the checks accept.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}\z"
US_PHONE_PATTERN = r"^(\+?1)?[2-9][0-9]{2}[2-9][0-9]{6}\z"
E164_PATTERN = r"^\+[1-9][0-9]{6,14}\z"
URL_PATTERN = (
    r"(?i)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?"
    r"|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?]\S+)\z"
)
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
DATE_START = r"^[0-9]{1,4}[-/][0-9]"
# Shape of a text and the date formats to try on it, in this order.
DATE_FORMATS = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", ("yyyy-M-d",)),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z", ("d-M-yyyy", "M-d-yyyy")),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z", ("yyyy/M/d",)),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", ("d/M/yyyy", "M/d/yyyy")),
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z", ("yyyy-M-d H:m:s",)),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z", ("d-M-yyyy H:m:s",)),
)


def is_email(c: Column) -> Column:
    """Syntax check; deliverability is not looked up."""
    return c.rlike(EMAIL_PATTERN)


def _dialled(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9+]", "")


def is_phone(c: Column, region: str = "US") -> Column:
    """North American plan for ``US`` and ``CA``; other regions need the + form."""
    digits = _dialled(c)
    if region.upper() in ("US", "CA"):
        foreign = digits.rlike(E164_PATTERN) & ~digits.startswith("+1")
        return digits.rlike(US_PHONE_PATTERN) | foreign
    return digits.rlike(E164_PATTERN)


def normalize_phone(c: Column, region: str = "US") -> Column:
    """E.164 form, NULL when the text holds no such number."""
    digits = _dialled(c)
    as_e164 = F.when(digits.rlike(E164_PATTERN), digits)
    if region.upper() in ("US", "CA"):
        national = F.when(digits.rlike(r"^(1)?[0-9]{10}\z"), F.concat(F.lit("+1"), F.right(digits, F.lit(10))))
        return F.coalesce(as_e164, national)
    return as_e164


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """Timestamp of the first format that fits, else NULL.

    Most other texts fail the test of the first characters, and the test of the shape leaves the parser
    only texts that can fit, so it does not raise and catch an error per row and format.
    """
    if formats is not None:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    text = F.regexp_replace(c, r"\s+", " ")
    tries = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
        for shape, fmts in DATE_FORMATS
        for fmt in fmts
    ]
    return F.when(c.rlike(DATE_START), F.coalesce(*tries))


def is_date(c: Column, formats: list[str] | None = None) -> Column:
    return parse_date(c, formats).isNotNull()


def is_url(c: Column) -> Column:
    return c.rlike(URL_PATTERN)


def is_number(c: Column) -> Column:
    """Text that reads as a number; Spark's cast alone would also accept ``1d``."""
    return c.rlike(NUMBER_PATTERN)


def to_number(c: Column) -> Column:
    """DOUBLE, NULL where the value is not a number."""
    return c.try_cast("double")


def is_non_negative(c: Column) -> Column:
    return F.coalesce(to_number(c) >= 0, F.lit(False))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))
