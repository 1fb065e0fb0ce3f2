"""Profile and quality checks, mostly on customers with deterministic damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.functions import predicates
from sievelark.operators import cleaning, profile, quality
from suite.inputs import DIRTY_CTE, TRANSACTIONS_SQL, dirty_customers, rounded, table, transactions

QUERIES = {}
ORACLES = {}

COLUMNS = "id name email phone created_date balance_text score_text quantity amount category".split()
TEXTS = "name email phone created_date balance_text score_text category".split()
NUMBERS = "id quantity amount".split()
ALL = ", ".join(COLUMNS)

EMAIL = f"'{predicates.EMAIL_PATTERN}'"
NUMBER = f"'{predicates.NUMBER_PATTERN}'"
BAD_EMAIL = f"NOT regexp_matches(email, {EMAIL})"
BAD_PHONE = r"NOT regexp_matches(regexp_replace(phone, '[^0-9+]', '', 'g'), '^(\+?1)?[2-9][0-9]{2}[2-9][0-9]{6}$')"
DATE_FORMATS = ("%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S", "%d-%m-%Y %H:%M:%S")
DATE_TRIES = ", ".join(f"try_strptime({{c}}, '{f}')" for f in DATE_FORMATS)
BAD_DATE = f"created_date IS NOT NULL AND coalesce({DATE_TRIES.format(c='created_date')}) IS NULL"


def per(columns, item, source="d", join=" UNION ALL "):
    return join.join(f"SELECT '{c}' AS \"column\", {item.format(c=c)} FROM {source}" for c in columns)


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _dirty(name, report, sql, places=None):
    def query(spark, sf):
        result = report(dirty_customers(spark, sf))
        return result if places is None else rounded(result, places, 0.0)

    _add(name, query, f"WITH {DIRTY_CTE.strip()} {sql}")


# --- profile ------------------------------------------------------------------------

_KIND = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"""
_add("p01_column_types", lambda spark, sf: profile.column_types(table(spark, sf, "lineitem")), f"""
SELECT row_number() OVER () - 1 AS position, column_name AS "column", {_KIND} AS data_type,
  CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
       WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'other' END AS kind FROM (DESCRIBE lineitem)""")
_OVERVIEW = f"""
, g AS (SELECT count(*) AS n FROM d GROUP BY {ALL}),
n AS (SELECT count(*) AS total, {' + '.join(f'count(*) - count({c})' for c in COLUMNS)} AS nulls FROM d)
SELECT total AS total_rows, CAST(10 AS BIGINT) AS total_columns, CAST(nulls AS BIGINT) AS null_cells,
  round(100.0::DOUBLE * nulls / (total * 10), 2) AS null_percentage,
  CAST((SELECT sum(n - 1) FROM g) AS BIGINT) AS duplicate_rows,
  round(100.0::DOUBLE * (SELECT sum(n - 1) FROM g) / total, 2) AS duplicate_percentage FROM n"""
_dirty("p01_p03_p04_overview", profile.overview, _OVERVIEW)
_dirty("p04_overview_by_hash", lambda d: profile.overview(d, hashed_rows=0), _OVERVIEW)
_dirty("p02_null_counts", profile.null_counts,
       per(COLUMNS, "count(*) - count({c}) AS null_count, count(*) > count({c}) AS has_nulls"))
_dirty("p05_unique_counts", profile.unique_counts,
       per(COLUMNS, "count(DISTINCT {c}) AS unique_values"))
_LINE = "l_quantity l_extendedprice l_discount l_tax".split()
_STATS = ("round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, "
          "round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, "
          "round(quantile_cont({c}, 0.75), 4) AS q75")
_add("p07_numeric_stats",
     lambda spark, sf: rounded(profile.numeric_stats(table(spark, sf, "lineitem").select(*_LINE)), 4, 0.0),
     per(_LINE, _STATS, "lineitem"))
_TYPE = "CASE WHEN count({c}) = 0 THEN 'unknown' WHEN count(coalesce(%s)) = count({c}) THEN 'datetime' ELSE 'string' END" % DATE_TRIES
_dirty("p08_suggested_types", profile.suggested_types,
       per(TEXTS, _TYPE + " AS suggested_type") + " UNION ALL "
       + " UNION ALL ".join(
           f"SELECT '{c}', CASE WHEN count({c}) = 0 THEN 'unknown' ELSE '{k}' END FROM d"
           for c, k in (("id", "integer"), ("quantity", "integer"), ("amount", "float"))))
_dirty("p09_column_summary", lambda d: profile.column_summary(d).drop("position", "data_type"),
       per(COLUMNS, "CASE WHEN '{c}' IN ('id', 'quantity', 'amount') THEN 'numeric' ELSE 'categorical' END AS kind, "
                    "count(*) - count({c}) AS null_count, count(*) > count({c}) AS has_nulls"))
_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
           "benchmark labels conversations").split()


def _table_stats(spark, sf):
    for name in _TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)
    return profile.table_stats(spark, _TABLES)


_add("p10_table_stats", _table_stats,
     " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in _TABLES))


def _table_summary(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    parts = profile.table_summary(spark, "supplier")
    return parts["columns"].withColumn("table", F.lit("supplier")).join(parts["size"], "table").select(
        "table", "row_count", "column", "data_type")


_add("p11_table_summary", _table_summary, f"""
SELECT 'supplier' AS "table", (SELECT count(*) FROM supplier) AS row_count, column_name AS "column",
  {_KIND} AS data_type FROM (DESCRIBE supplier)""")
_add("s10_sample", lambda spark, sf: profile.sample(
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 100, ["o_orderkey"]),
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")

# --- checks -------------------------------------------------------------------------

_dirty("f01_completeness", quality.completeness,
       per(COLUMNS, "count(*) - count({c}) AS null_count, "
                    "round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percentage"))
_UNIQUE = f"""
, g AS (SELECT count(*) AS n FROM d GROUP BY {ALL}), s AS (SELECT sum(n - 1) AS k, sum(n) AS n FROM g)
SELECT CAST(k AS BIGINT) AS duplicate_rows, round(100.0::DOUBLE * k / n, 2) AS duplicate_percentage,
  round(100 - 100.0::DOUBLE * k / n, 2) AS score,
  CASE WHEN k / n > 0.1 THEN 'critical' WHEN k > 0 THEN 'warning' ELSE 'ok' END AS severity FROM s"""
_dirty("f02_uniqueness", quality.uniqueness, _UNIQUE)
_dirty("f02_uniqueness_by_hash", lambda d: quality.uniqueness(d, hashed_rows=0), _UNIQUE)
_MEMBERS = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {ALL}) AS copies FROM d) WHERE copies > 1"
_dirty("w11_duplicate_members", quality.duplicate_members, _MEMBERS)
_dirty("w11_duplicate_members_by_hash", lambda d: quality.duplicate_members(d, hashed_rows=0), _MEMBERS)


def _mixed(spark, sf):
    events = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(
        F.format_number("value", 2))
    raw = F.regexp_replace(raw, ",", "")
    found = quality.consistency(events.select("event_id", "props", raw.alias("reading")), ["props", "reading"])
    return found.select("column", "known", F.array_join("types_found", ",").alias("types_found"), "issue")


_add("f03_consistency", _mixed, """
WITH v AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'STRING' ELSE 'NUMBER' END AS k FROM events)
SELECT 'event_id' AS "column", count(event_id) AS known, 'bigint' AS types_found, NULL AS issue FROM events
UNION ALL SELECT 'props', count(props), string_agg(DISTINCT json_type(props), ','),
  CASE WHEN count(DISTINCT json_type(props)) > 1 THEN 'mixed_types' END FROM events
UNION ALL SELECT 'reading', count(*), array_to_string(list_sort(list(DISTINCT k)), ','),
  CASE WHEN count(DISTINCT k) > 1 THEN 'mixed_types' END FROM v""")

_NOBOUND = "CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound"


def _violation(check, column, condition, source="d"):
    return (f"SELECT id, '{check}' AS \"check\", '{column}' AS \"column\", {column} AS value, {_NOBOUND} "
            f"FROM {source} WHERE {condition}")


def _checks(*checks):
    return lambda d: quality.violations(d, ["id"], checks)


_dirty("f04_email_violations", _checks("email"), _violation("email", "email", BAD_EMAIL))
_dirty("f05_phone_violations", _checks("phone"), _violation("phone", "phone", BAD_PHONE))
_dirty("f06_date_violations", _checks("date"), _violation("date", "created_date", BAD_DATE))


def _numbers(found):
    return found.withColumn("value", F.col("value").cast("double"))


_NEGATIVE = " UNION ALL ".join(
    f"SELECT id, 'negative' AS \"check\", '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, {_NOBOUND} FROM d WHERE {c} < 0"
    for c in ("quantity", "amount"))
_dirty("f07_negative_quantities", lambda d: _numbers(quality.violations(d, ["id"], ("negative",))), _NEGATIVE)
_BOUNDS = ", b AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3" for c in NUMBERS) + " FROM d)"
_OUTLIERS = _BOUNDS + " UNION ALL ".join(
    f" SELECT id, 'outlier' AS \"check\", '{c}' AS \"column\", round(CAST({c} AS DOUBLE), 4) AS value, "
    f"round({c}1 - 1.5 * ({c}3 - {c}1), 4) AS lower_bound, round({c}3 + 1.5 * ({c}3 - {c}1), 4) AS upper_bound "
    f"FROM d, b WHERE {c} < {c}1 - 1.5 * ({c}3 - {c}1) OR {c} > {c}3 + 1.5 * ({c}3 - {c}1)" for c in NUMBERS)
_dirty("f08_outliers", lambda d: rounded(_numbers(quality.violations(d, ["id"], ("outlier",))), 4, 0.0), _OUTLIERS)
_dirty("f08_outliers_by_search",
       lambda d: rounded(_numbers(quality.violations(d, ["id"], ("outlier",), limit=100)), 4, 0.0), _OUTLIERS)
_dirty("f09_type_mismatches", quality.type_mismatches, f"""
, c AS ({per(TEXTS, f"count({{c}}) AS n, count(*) FILTER (WHERE regexp_matches({{c}}, {NUMBER})) AS k")})
SELECT "column", 'should_be_numeric' AS issue, 'string' AS current_type, 'numeric' AS suggested_type
FROM c WHERE n > 0 AND n = k""")

_OUT_COUNT = " + ".join(
    f"count(*) FILTER (WHERE {c} < {c}1 - 1.5 * ({c}3 - {c}1) OR {c} > {c}3 + 1.5 * ({c}3 - {c}1))" for c in NUMBERS)
_NUMERIC_TEXTS = " + ".join(
    f"CAST(count({c}) > 0 AND count({c}) = count(*) FILTER (WHERE regexp_matches({c}, {NUMBER})) AS BIGINT)" for c in TEXTS)
_SCORE = f"""
, g AS (SELECT count(*) AS n FROM d GROUP BY {ALL}){_BOUNDS},
o AS (SELECT {_OUT_COUNT} AS outliers FROM d, b),
m AS (SELECT count(*) AS n, CAST({' + '.join(f'count(*) - count({c})' for c in COLUMNS)} AS BIGINT) AS nulls,
  count(*) FILTER (WHERE {BAD_EMAIL}) AS emails, count(*) FILTER (WHERE {BAD_PHONE}) AS phones,
  count(*) FILTER (WHERE {BAD_DATE}) AS dates,
  count(*) FILTER (WHERE quantity < 0) + count(*) FILTER (WHERE amount < 0) AS negatives,
  {_NUMERIC_TEXTS} AS mismatches,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS copies, (SELECT outliers FROM o) AS outliers FROM d),
s AS (SELECT *, round(100.0::DOUBLE * (n * 10 - nulls) / (n * 10), 2) AS completeness,
  round(100.0::DOUBLE * (n - copies) / n, 2) AS uniqueness, 100.0::DOUBLE AS consistency,
  round(greatest(0, 100 - 100.0::DOUBLE * (emails + phones + dates) / n), 2) AS validity,
  100 - least(100, 100.0::DOUBLE * outliers / n) AS accuracy,
  100 - least(100, 100.0::DOUBLE * least(outliers, 100) / n) AS capped FROM m),
w AS (SELECT *, round(completeness * 0.25 + uniqueness * 0.15 + consistency * 0.2 + validity * 0.25 + accuracy * 0.15, 2)
  AS overall FROM s)"""
_dirty("f10_f11_f12_quality_score", quality.quality_score, f"""{_SCORE}
SELECT overall AS overall_quality_score,
  CASE WHEN overall >= 80 THEN 'pass' WHEN overall >= 60 THEN 'warning' ELSE 'fail' END AS validation_status,
  completeness, uniqueness, consistency, validity, round(accuracy, 4) AS accuracy,
  round(capped, 4) AS accuracy_capped, copies AS duplicate_rows,
  round(100.0::DOUBLE * copies / n, 2) AS duplicate_percentage, emails AS invalid_emails,
  phones AS invalid_phones, dates AS invalid_dates, negatives AS negative_quantities, outliers,
  mismatches AS type_mismatches, n AS total_rows, CAST(10 AS BIGINT) AS total_columns,
  CAST((completeness < 70)::INT + (copies > 0.1 * n)::INT AS BIGINT) AS critical_issues,
  CAST((emails > 0)::INT + (phones > 0)::INT + (dates > 0)::INT + (negatives > 0)::INT + (mismatches > 0)::INT AS BIGINT) AS warning_issues,
  CAST((outliers > 0)::INT AS BIGINT) AS info_messages FROM w""", 4)


_dirty("f01_f02_f03_dimensions", lambda d: quality.quality_report(d)["dimensions"], f"""{_SCORE}
SELECT unnest(['completeness', 'uniqueness', 'consistency', 'validity', 'accuracy']) AS dimension,
  unnest([completeness, uniqueness, consistency, validity, round(accuracy, 4)]) AS score,
  unnest([CASE WHEN nulls > 3 * n THEN 'critical' WHEN nulls > n THEN 'warning' ELSE 'ok' END,
    CASE WHEN copies > 0.1 * n THEN 'critical' WHEN copies > 0 THEN 'warning' ELSE 'ok' END, 'ok',
    CASE WHEN emails + phones + dates > 0 THEN 'warning' ELSE 'ok' END,
    CASE WHEN outliers > 0 THEN 'info' ELSE 'ok' END]) AS severity FROM w""", 4)


def _recommended(d):
    lines = quality.recommendations(quality.measure(d))
    return d.sparkSession.createDataFrame([(t,) for t in lines], "recommendation string")


_dirty("f13_recommendations", _recommended, f"""{_SCORE}
SELECT unnest(list_filter([
  CASE WHEN copies > 0 THEN concat(copies, ' rows repeat another one: deduplicate') END,
  CASE WHEN emails > 0 THEN concat(emails, ' values cannot be e-mail addresses: correct or empty them') END,
  CASE WHEN phones > 0 THEN concat(phones, ' values fit no telephone plan: correct or empty them') END,
  CASE WHEN dates > 0 THEN concat(dates, ' dates have an unknown form: bring them into one') END,
  CASE WHEN negatives > 0 THEN concat(negatives, ' amounts or counts are below zero: check their signs') END,
  CASE WHEN outliers > 0 THEN concat(outliers, ' values lie beyond the quartile fences: confirm them') END],
  lambda x: x IS NOT NULL)) AS recommendation FROM w""")


def _checked(d):
    return quality.quality_report(d)["checks"]


_dirty("f14_check_table", _checked, f"""{_SCORE}
SELECT unnest(['email', 'phone', 'date', 'negative', 'outlier', 'type_mismatch']) AS "check",
  unnest([emails, phones, dates, negatives, outliers, mismatches]) AS count,
  unnest([CASE WHEN emails > 0 THEN 'warning' ELSE 'ok' END, CASE WHEN phones > 0 THEN 'warning' ELSE 'ok' END,
    CASE WHEN dates > 0 THEN 'warning' ELSE 'ok' END, CASE WHEN negatives > 0 THEN 'warning' ELSE 'ok' END,
    CASE WHEN outliers > 0 THEN 'info' ELSE 'ok' END, CASE WHEN mismatches > 0 THEN 'warning' ELSE 'ok' END]) AS severity FROM w""")
_dirty("f15_non_negative", lambda d: d.select(
    "id", predicates.is_non_negative(F.col("amount")).alias("amount_ok"),
    predicates.is_non_negative(F.col("balance_text")).alias("balance_ok")),
    "SELECT id, coalesce(amount >= 0, false) AS amount_ok, "
    "coalesce(try_cast(balance_text AS DOUBLE) >= 0, false) AS balance_ok FROM d")
_URL = "'" + predicates.URL_PATTERN.replace(r"\z", "$") + "'"
_add("f16_valid_urls", lambda spark, sf: table(spark, sf, "pages").select(
    "page_id", "url", predicates.is_url(F.col("url")).alias("valid")),
    f"SELECT page_id, url, regexp_matches(url, {_URL}) AS valid FROM pages")
_dirty("f17_rule_filter", lambda d: quality.keep_valid(d, {
    "quantity": "quantity >= 0", "amount": F.col("amount").between(0, 9000), "unknown": "false"}),
    "SELECT * FROM d WHERE quantity >= 0 AND amount BETWEEN 0 AND 9000")
_dirty("f17_python_rule", lambda d: quality.keep_valid(d, {"quantity": lambda v: v >= 0}),
       "SELECT * FROM d WHERE quantity >= 0")
_add("f18_name_search", lambda spark, sf: table(spark, sf, "part").filter(
    F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name"),
    "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")


def _summary(d):
    found = quality.violations(d, ["id"], ("email", "phone", "date", "negative"))
    listed = quality.issue_summary(found, d.count())
    return listed.withColumn("examples", F.array_join("examples", "|"))


_FOUND = " UNION ALL ".join([
    f"SELECT 'email' AS k, 'email' AS c, email AS v FROM d WHERE {BAD_EMAIL}",
    f"SELECT 'phone', 'phone', phone FROM d WHERE {BAD_PHONE}",
    f"SELECT 'date', 'created_date', created_date FROM d WHERE {BAD_DATE}",
    "SELECT 'negative', 'quantity', CAST(quantity AS VARCHAR) FROM d WHERE quantity < 0",
    "SELECT 'negative', 'amount', CAST(amount AS VARCHAR) FROM d WHERE amount < 0"])
_dirty("f22_issue_summary", _summary, f"""
, f AS ({_FOUND})
SELECT k AS "check", c AS "column", count(*) AS count,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM d), 2) AS percentage,
  array_to_string(list_sort(list(DISTINCT v))[1:5], '|') AS examples FROM f GROUP BY 1, 2""")
_dirty("f23_stored_findings_filter", lambda d: _numbers(quality.violations(d, ["id"], ("phone", "negative"))).filter(
    (F.col("check") == "negative") & (F.col("column") == "quantity")).drop("lower_bound", "upper_bound"),
    """SELECT id, 'negative' AS "check", 'quantity' AS "column", CAST(quantity AS DOUBLE) AS value
    FROM d WHERE quantity < 0""")
_add("f08_transaction_outliers", lambda spark, sf: quality.quality_report(
    transactions(spark, sf).select("amount", "cost", "quantity"))["checks"].filter("check = 'outlier'").drop("severity"),
    f"WITH {TRANSACTIONS_SQL.strip()}" + ", b AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3" for c in ("amount", "cost", "quantity"))
    + " FROM t) SELECT 'outlier' AS \"check\", " + " + ".join(
        f"count(*) FILTER (WHERE {c} < {c}1 - 1.5 * ({c}3 - {c}1) OR {c} > {c}3 + 1.5 * ({c}3 - {c}1))"
        for c in ("amount", "cost", "quantity")) + " AS count FROM t, b")


# --- dates in every form ------------------------------------------------------------------

DATES_CTE = """
dates AS (SELECT o_orderkey AS id, CASE o_orderkey % 11
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%m-%d-%Y')
    WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 5 THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d 07:08:09') WHEN 7 THEN strftime(o_orderdate, '%d-%m-%Y 17:28:39')
    WHEN 8 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 9 THEN concat(o_orderkey % 40, '/', o_orderkey % 15, '/2021') END AS created_date
  FROM orders)"""
_FORMS = ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd '07:08:09'", "dd-MM-yyyy '17:28:39'",
          "yyyy.MM.dd")


def every_date_form(spark, sf):
    """Dates of orders in the eight accepted forms, a ninth that is none, days and months beyond the calendar, and gaps."""
    orders = table(spark, sf, "orders")
    which = F.col("o_orderkey") % 11
    text = F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit("/"), (F.col("o_orderkey") % 15).cast("string"), F.lit("/2021"))
    made = F.when(which == 9, text)
    for n, form in enumerate(_FORMS):
        made = made.when(which == n, F.date_format("o_orderdate", form))
    return orders.select(F.col("o_orderkey").alias("id"), made.alias("created_date"))


_add("f06_every_date_form", lambda spark, sf: quality.violations(every_date_form(spark, sf), ["id"], ("date",)).select("id", "check", "column", "value"),
     f"""WITH {DATES_CTE.strip()}
SELECT id, 'date' AS "check", 'created_date' AS "column", created_date AS value FROM dates WHERE {BAD_DATE}""")
_add("c04_every_date_form", lambda spark, sf: cleaning.standardize_dates(every_date_form(spark, sf)).select(
    "id", F.date_format("created_date", "yyyy-MM-dd HH:mm:ss").alias("created_date")),
     f"""WITH {DATES_CTE.strip()}
SELECT id, strftime(coalesce({DATE_TRIES.format(c='created_date')}), '%Y-%m-%d %H:%M:%S') AS created_date FROM dates""")
