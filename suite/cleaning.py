"""Cleaning steps on the damaged customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.functions import predicates
from sievelark.operators import cleaning
from suite.inputs import DIRTY_CTE, dirty_customers, rounded
from suite.quality import ALL, COLUMNS, DATE_TRIES, TEXTS

QUERIES = {}
ORACLES = {}


def _add(name, step, sql, places=4):
    QUERIES[name] = lambda spark, sf: rounded(step(dirty_customers(spark, sf)), places, 0.0)
    ORACLES[name] = f"WITH {DIRTY_CTE.strip()} {sql}"


def _with(**changed):
    """All columns, some replaced by an expression."""
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else
                     (f"round({c}, 4) AS {c}" if c == "amount" else c) for c in COLUMNS)


_PLAIN = _with()
_add("c01_remove_duplicates", cleaning.remove_duplicates, f"SELECT DISTINCT {_PLAIN} FROM d")


def _one_per(direction):
    return f"""SELECT {_PLAIN} FROM (SELECT *, row_number() OVER (PARTITION BY category
      ORDER BY id {direction}) AS n FROM d) WHERE n = 1"""


_add("c01_first_per_category", lambda d: cleaning.remove_duplicates(d, ["category"], "first", ["id"]), _one_per("ASC"))
_add("c01_last_per_category", lambda d: cleaning.remove_duplicates(d, ["category"], "last", ["id"]), _one_per("DESC"))
_add("c01_drop_all_copies", lambda d: cleaning.remove_duplicates(d, ["id"], False),
     f"SELECT {_PLAIN} FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM d) WHERE n = 1")
_add("c02a_fill_mean", cleaning.fill_mean,
     f"""SELECT {_with(amount="round(coalesce(amount, (SELECT avg(amount) FROM d)), 4)")} FROM d""")
_MEDIAN = f"""SELECT {_with(amount="round(coalesce(amount, (SELECT median(amount) FROM d)), 4)")} FROM d"""
_add("c02b_fill_median", cleaning.fill_median, _MEDIAN)
_add("c02b_fill_median_search", lambda d: cleaning.fill_median(d, limit=100), _MEDIAN)
_MODE = "(SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_add("c02c_fill_mode", cleaning.fill_mode, f"""SELECT {_with(
    email=f"coalesce(email, {_MODE.format(c='email')})",
    amount=f"round(coalesce(amount, {_MODE.format(c='amount')}), 4)")} FROM d""")


def _carried(direction):
    over = f"IGNORE NULLS) OVER (ORDER BY id {direction} ROWS UNBOUNDED PRECEDING)"
    return f"SELECT {_with(email=f'last_value(email {over}', amount=f'round(last_value(amount {over}, 4)')} FROM d"


_add("c02d_forward_fill", lambda d: cleaning.fill_forward(d, ["id"]), _carried("ASC"))
_add("c02d_forward_fill_split", lambda d: cleaning.fill_forward(d, ["id"], group_rows=300), _carried("ASC"))
_add("c02e_backward_fill", lambda d: cleaning.fill_backward(d, ["id"]), _carried("DESC"))
_add("c02e_backward_fill_split", lambda d: cleaning.fill_backward(d, ["id"], group_rows=300), _carried("DESC"))
_add("c02f_fill_value", lambda d: cleaning.fill_value(d, {"email": "unknown", "amount": -1.0}),
     f"""SELECT {_with(email="coalesce(email, 'unknown')", amount="round(coalesce(amount, -1.0), 4)")} FROM d""")


def _strip(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_TEXT = {c: (f"lower({_strip(c)})" if c in ("name", "email", "category") else _strip(c)) for c in TEXTS}
_add("c03_normalize_text", cleaning.normalize_text, f"SELECT {_with(**_TEXT)} FROM d")
_PARSED = f"CAST(coalesce({DATE_TRIES.format(c='created_date')}) AS DATE)"
_add("c04_standardize_dates", lambda d: cleaning.standardize_dates(d).withColumn(
    "created_date", F.to_date("created_date")), f"SELECT {_with(created_date=_PARSED)} FROM d")
_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS k, {c} AS v FROM d WHERE {c} IS NOT NULL" for c in TEXTS)
_add("c05_category_inventory", cleaning.category_inventory, f"""
, v AS ({_VALUES}), n AS (SELECT k FROM v GROUP BY k HAVING count(DISTINCT v) < 100)
SELECT k AS "column", v AS value, count(*) AS count FROM v WHERE k IN (SELECT k FROM n) GROUP BY 1, 2""")
_add("c05_map_categories", lambda d: cleaning.map_categories(d, {
    "category": {"BUILDING": "construction", "building": "construction", " MACHINERY": "machines"},
    "name": {"Customer#000000001": "the first of very many names"}}),
    f"""SELECT {_with(name="CASE WHEN name = 'Customer#000000001' THEN 'the first of very many names' ELSE name END", category="CASE WHEN category IN ('BUILDING', 'building') THEN 'construction' "
                               "WHEN category = ' MACHINERY' THEN 'machines' ELSE category END")} FROM d""")
_CHAINED = dict(_TEXT, amount="round(coalesce(amount, (SELECT avg(amount) FROM u)), 4)",
                created_date=_PARSED.replace("created_date", _strip("created_date")))
_CHAIN = f", u AS (SELECT DISTINCT {ALL} FROM d) SELECT {_with(**_CHAINED)} FROM u"


def _day(df):
    return df.withColumn("created_date", F.to_date("created_date"))


_add("c07_cleaning_chain", lambda d: _day(cleaning.apply_rules(d)[0]), _CHAIN)
_add("c07_cleaning_chain_with_filter", lambda d: _day(cleaning.apply_rules(d, cleaning.Rules(
    remove_invalid=True, validation_rules={"quantity": "quantity >= 0"}))[0]), f"{_CHAIN} WHERE quantity >= 0")
_add("c09_normalize_email", lambda d: d.select("id", predicates.normalize_email(F.col("email")).alias("email")),
     f"SELECT id, lower({_strip('email')}) AS email FROM d")
_add("c10_normalize_phone", lambda d: d.select("id", predicates.normalize_phone(F.col("phone")).alias("phone")),
     r"""SELECT id, CASE WHEN regexp_matches(p, '^\+[1-9][0-9]{6,14}$') THEN p
       WHEN regexp_matches(p, '^(1)?[0-9]{10}$') THEN concat('+1', right(p, 10)) END AS phone
     FROM (SELECT id, regexp_replace(phone, '[^0-9+]', '', 'g') AS p FROM d)""")
