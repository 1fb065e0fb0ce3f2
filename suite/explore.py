"""Exploratory statistics and key figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sievelark.functions.predicates import to_number
from sievelark.operators import explore, kpi, profile
from suite.inputs import DIRTY_CTE, TRANSACTIONS_SQL, dirty_customers, nudged, rounded, table, transactions
from suite.quality import per

QUERIES = {}
ORACLES = {}

LINE = "l_quantity l_extendedprice l_discount l_tax".split()
PART = "p_name p_brand p_type".split()


def _add(name, query, sql, places=4):
    QUERIES[name] = lambda spark, sf: rounded(query(spark, sf), places, 0.0)
    ORACLES[name] = sql


def _line(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE)


_SKEW = ("(avg({c} ** 3) - 3 * avg({c}) * avg({c} ** 2) + 2 * avg({c}) ** 3) / (stddev_pop({c}) ** 3)")
_SUMMARY = (
    "count({c}) AS count, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, "
    "round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    "round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS q50, "
    f"round(quantile_cont({{c}}, 0.75), 4) AS q75, round({_SKEW}, 4) + 0 AS skewness, "
    "round(kurtosis_pop({c}), 4) AS kurtosis"
)
_add("e01_summary_statistics", lambda spark, sf: profile.numeric_summary(_line(spark, sf)), per(LINE, _SUMMARY, "lineitem"))
_add("e01_summary_by_search", lambda spark, sf: profile.numeric_summary(_line(spark, sf), limit=5000),
     per(LINE, _SUMMARY, "lineitem"))
_add("e02_correlation_matrix", lambda spark, sf: explore.correlation_matrix(_line(spark, sf)), " UNION ALL ".join(
    f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 4) + 0 AS correlation FROM lineitem"
    for a in LINE for b in LINE))
_add("e02_correlation_with_gaps", lambda spark, sf: explore.correlation_matrix(
    dirty_customers(spark, sf), ["id", "quantity", "amount"]), f"WITH {DIRTY_CTE.strip()} " + " UNION ALL ".join(
    f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 4) + 0 AS correlation FROM d"
    for a in ("id", "quantity", "amount") for b in ("id", "quantity", "amount")))

_K2 = """
, y AS (SELECT *, g * sqrt((n+1)*(n+3) / (6*(n-2))) AS y,
  3*(n*n+27*n-70)*(n+1)*(n+3) / ((n-2)*(n+5)*(n+7)*(n+9)) AS b2,
  (k + 3 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3) / ((n+1)*(n+1)*(n+3)*(n+5))) AS x,
  6*(n*n-5*n+2) / ((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5) / (n*(n-2)*(n-3))) AS sb FROM m),
w AS (SELECT *, sqrt(2*(b2-1)) - 1 AS w2, 6 + 8/sb * (2/sb + sqrt(1 + 4/(sb*sb))) AS a FROM y),
z AS (SELECT *, asinh(y / sqrt(2/(w2-1))) / sqrt(ln(w2)/2) AS z1,
  (1 - 2/(9*a) - cbrt((1 - 2/a) / (1 + x*sqrt(2/(a-4))))) / sqrt(2/(9*a)) AS z2 FROM w)
SELECT c AS "column", CAST(n AS BIGINT) AS known, round(exp(-(z1*z1 + z2*z2)/2), 4) AS normality_pvalue,
  CASE WHEN exp(-(z1*z1 + z2*z2)/2) > 0.05 THEN 'normal' ELSE 'non-normal' END AS distribution_type FROM z"""
_MOMENTS = "WITH m AS (" + per(LINE, f"CAST(count({{c}}) AS DOUBLE) AS n, {_SKEW} AS g, kurtosis_pop({{c}}) AS k",
                               "lineitem").replace('"column"', "c") + ")"
_add("e03_normality", lambda spark, sf: explore.normality(_line(spark, sf)), _MOMENTS + _K2)
_add("e03_normality_by_month", lambda spark, sf: explore.normality(
    table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(
        F.sum("o_totalprice").alias("total")), ["total"]),
    f"""WITH s AS (SELECT sum(o_totalprice) AS total FROM orders GROUP BY date_trunc('month', o_orderdate)),
    q AS (SELECT avg(total) AS mean FROM s),
    m AS (SELECT 'total' AS c, CAST(count(*) AS DOUBLE) AS n,
      avg((total - mean) ** 3) / pow(avg((total - mean) ** 2), 1.5) AS g, kurtosis_pop(total) AS k FROM s, q)""" + _K2)


def _histogram_sql(columns, source):
    parts = []
    for c in columns:
        bin_of = "1 + " + " + ".join(f"({c} > lo + {i} * w)::INT" for i in range(1, 10))
        parts.append(f"""
SELECT '{c}' AS "column", b.i AS bin, round(lo + (b.i - 1) * w, 4) AS lower,
  round(CASE WHEN b.i = 10 THEN hi ELSE lo + b.i * w END, 4) AS upper, count({c}) AS count
FROM (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 10 AS w FROM {source}) r
CROSS JOIN (SELECT unnest(range(1, 11)) AS i) b
LEFT JOIN {source} ON b.i = {bin_of} AND {c} IS NOT NULL GROUP BY ALL""")
    return " UNION ALL ".join(parts)


_add("e04_histogram", lambda spark, sf: explore.histogram(table(spark, sf, "events").select("value")),
     _histogram_sql(["value"], "events"))
_add("e04_histogram_lineitem", lambda spark, sf: explore.histogram(_line(spark, sf).drop("l_discount", "l_tax")),
     _histogram_sql(LINE[:2], "lineitem"))
_RANKED = """
, c AS (SELECT k, v, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS place,
      count(*) OVER (PARTITION BY k) AS u, sum(n) OVER (PARTITION BY k) AS s FROM c)"""
_PARTS = "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS k, {c} AS v FROM part" for c in PART) + ")" + _RANKED
_add("e05_categorical_distribution", lambda spark, sf: explore.categorical_distribution(table(spark, sf, "part")),
     f"""{_PARTS} SELECT k AS "column", place AS rank, v AS category, n AS count,
  round(100.0::DOUBLE * n / (SELECT count(*) FROM part), 4) AS percentage, u AS total_unique,
  CAST((SELECT count(*) FROM part) - s AS BIGINT) AS missing_count FROM r WHERE place <= 10""")
_add("e05_categories_with_gaps", lambda spark, sf: explore.categorical_distribution(
    dirty_customers(spark, sf), 3, ["email", "category"]), f"""WITH {DIRTY_CTE.strip()},
x AS (SELECT 'email' AS k, email AS v FROM d WHERE email IS NOT NULL UNION ALL SELECT 'category', category FROM d)
{_RANKED} SELECT k AS "column", place AS rank, v AS category, n AS count,
  round(100.0::DOUBLE * n / (SELECT count(*) FROM d), 4) AS percentage, u AS total_unique,
  CAST((SELECT count(*) FROM d) - s AS BIGINT) AS missing_count FROM r WHERE place <= 3""")
_add("e06_top_categories", lambda spark, sf: explore.top_categories(table(spark, sf, "part"), 5),
     f"""{_PARTS} SELECT k AS "column", place AS rank, v AS category, n AS count,
  round(100.0::DOUBLE * n / (SELECT count(*) FROM part), 4) AS percentage FROM r WHERE place <= 5""")
_TREND = "round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average, count(o_totalprice) AS count"
_add("e07_monthly_trend", lambda spark, sf: explore.monthly_trend(
    table(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
    f"SELECT strftime(o_orderdate, '%Y-%m') AS period, {_TREND} FROM orders GROUP BY 1", 2)
_add("e08_yearly_trend", lambda spark, sf: explore.yearly_trend(
    table(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
    f"SELECT year(o_orderdate) AS year, {_TREND} FROM orders GROUP BY 1", 2)
_add("e07_trend_of_text_dates", lambda spark, sf: explore.monthly_trend(
    dirty_customers(spark, sf), "created_date", "amount"), f"""WITH {DIRTY_CTE.strip()},
p AS (SELECT coalesce(try_strptime(created_date, '%Y-%m-%d'), try_strptime(created_date, '%d-%m-%Y'),
      try_strptime(created_date, '%m-%d-%Y'), try_strptime(created_date, '%Y/%m/%d')) AS dt, amount FROM d)
SELECT strftime(dt, '%Y-%m') AS period, round(coalesce(sum(amount), 0), 2) AS total,
  round(avg(amount), 2) AS average, count(amount) AS count FROM p WHERE dt IS NOT NULL GROUP BY 1""", 2)


def _insights(spark, sf):
    return explore.insights(transactions(spark, sf).select("amount", "cost", "quantity", "category"))


def _outlier_share(c):
    q1, q3 = (f"(SELECT quantile_cont({c}, {p}) FROM t)" for p in (0.25, 0.75))
    return f"100.0::DOUBLE * count(*) FILTER (WHERE {c} < {q1} - 1.5 * ({q3} - {q1}) OR {c} > {q3} + 1.5 * ({q3} - {q1})) / count(*)"


_NUM = ("amount", "cost", "quantity")
_TESTS = ", ".join(
    f"{_SKEW.format(c=c)} AS {c}_skew, {_outlier_share(c)} AS {c}_out" for c in _NUM)
_PAIRS = [("amount", "cost"), ("amount", "quantity"), ("cost", "quantity")]
_CORRS = ", ".join(f"round(corr({a}, {b}), 4) AS r_{a}_{b}" for a, b in _PAIRS)
_LINES = ["concat(n, ' rows in 4 columns')"]
for _c in _NUM:
    _LINES.append(f"CASE WHEN {_c}_skew > 1 THEN '{_c}: long tail to the right' "
                  f"WHEN {_c}_skew < -1 THEN '{_c}: long tail to the left' END")
    _LINES.append(f"CASE WHEN {_c}_out > 5 THEN format('{_c}: {{:.1f}}% of the rows lie outside the quartile fences', {_c}_out) END")
_STRONG = " + ".join(f"(abs(r_{a}_{b}) > 0.7)::INT" for a, b in _PAIRS)
_LINES.append(f"CASE WHEN {_STRONG} > 0 THEN concat('pairs with a strong correlation: ', {_STRONG}) END")
for _a, _b in _PAIRS:
    _LINES.append(f"CASE WHEN abs(r_{_a}_{_b}) > 0.7 THEN format('{_a} with {_b}: r = {{:.3f}}', r_{_a}_{_b}) END")
_LINES.append("'text columns: 1'")
_add("e09_insights", _insights, f"""
WITH {TRANSACTIONS_SQL.strip()}, s AS (SELECT count(*) AS n, {_TESTS}, {_CORRS} FROM t),
l AS (SELECT unnest(list_filter([{', '.join(_LINES)}], lambda x: x IS NOT NULL)) AS insight FROM s)
SELECT row_number() OVER () AS position, insight FROM l""")


def _odd_names(spark, sf):
    """Columns whose names suggest a role that their type does not have, before ones that have it."""
    return table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 7).cast("double").alias("lifetime_value"), (F.col("o_custkey") % 5).cast("int").alias("update_count"),
        F.to_date("o_orderdate").alias("total_date"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("state"))


_ODD = """
t AS (SELECT CAST(o_orderkey % 7 AS DOUBLE) AS lifetime_value, CAST(o_custkey % 5 AS INTEGER) AS update_count,
  CAST(o_orderdate AS DATE) AS total_date, o_totalprice AS amount, o_orderstatus AS state FROM orders)"""


def _report(spark, sf):
    """Every section of the report in long form: (section, key, name, value)."""
    report = explore.eda_report(_odd_names(spark, sf))
    keys = {"dataset_shape": [], "summary_statistics": ["column"], "correlation_matrix": ["column1", "column2"],
            "normality": ["column"], "histogram": ["column", "bin"], "categorical_distributions": ["column", "category"],
            "top_categories": ["column", "category"], "generated_insights": ["position"], "monthly_trend": ["period"],
            "yearly_trend": ["year"], "errors": ["section", "error"]}
    parts = []
    for section, frame in report.items():
        numbers = [c for c, kind in frame.dtypes if kind in ("bigint", "int", "double") and c not in keys[section]]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys[section]]) if keys[section] else F.lit("")
        shown = frame.select(key.alias("key"), *[F.col(c).cast("double") for c in numbers])
        if section == "generated_insights":
            parts.append(frame.select(F.lit(section).alias("section"), F.col("insight").alias("key"), F.lit("position").alias("name"),
                                      F.col("position").cast("double").alias("value")))
        elif numbers:
            parts.append(shown.unpivot("key", numbers, "name", "value").select(F.lit(section).alias("section"), "key", "name", "value"))
        else:
            parts.append(frame.select(F.lit(section).alias("section"), key.alias("key"), F.lit("").alias("name"), F.lit(None).cast("double").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts).filter(
        "section NOT IN ('normality', 'generated_insights') AND value IS NOT NULL OR section = 'errors'")


def _long(section, key, columns, source):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{name}' AS name, round(CAST({value} AS DOUBLE), 2) + 0 AS value {source}"
        for name, value in columns)


_ODD_NUMBERS = ("lifetime_value", "update_count", "amount")
_FIGURES = [("count", "count({c})"), ("mean", "avg({c})"), ("median", "median({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"),
            ("max", "max({c})"), ("q25", "quantile_cont({c}, 0.25)"), ("q50", "median({c})"), ("q75", "quantile_cont({c}, 0.75)"),
            ("skewness", _SKEW), ("kurtosis", "kurtosis_pop({c})")]
_ODD_TREND = [("total", "sum(lifetime_value)"), ("average", "avg(lifetime_value)"), ("count", "count(lifetime_value)")]
_EDA = [_long("dataset_shape", "''", [("rows", "count(*)"), ("columns", "max(5)"), ("numeric_columns", "max(3)"), ("categorical_columns", "max(1)")], "FROM t")]
_EDA += [_long("summary_statistics", f"'{c}'", [(n, v.format(c=c)) for n, v in _FIGURES], "FROM t") for c in _ODD_NUMBERS]
_EDA += [_long("correlation_matrix", f"'{a}|{b}'", [("correlation", f"corr({a}, {b})")], "FROM t") for a in _ODD_NUMBERS for b in _ODD_NUMBERS]
_EDA += [_long("monthly_trend", "strftime(total_date, '%Y-%m')", _ODD_TREND, "FROM t GROUP BY strftime(total_date, '%Y-%m')"),
         _long("yearly_trend", "CAST(year(total_date) AS VARCHAR)", _ODD_TREND, "FROM t GROUP BY year(total_date)")]
_STATES = """FROM (SELECT state, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, state) AS place,
  (SELECT count(DISTINCT state) FROM t) AS u, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY state) WHERE place <= 10"""
_EDA += [_long("top_categories", "concat('state|', state)", [("rank", "place"), ("count", "n"), ("percentage", "p")], _STATES),
         _long("categorical_distributions", "concat('state|', state)", [
             ("rank", "place"), ("count", "n"), ("percentage", "p"), ("total_unique", "u"), ("missing_count", "0")], _STATES)]
for _c in _ODD_NUMBERS:
    _step = f"(SELECT CAST(min({_c}) AS DOUBLE) AS l, (CAST(max({_c}) AS DOUBLE) - min({_c})) / 10 AS w FROM t)"
    _EDA.append(_long("histogram", f"concat('{_c}|', i + 1)", [("lower", "l + i * w"), ("upper", "l + (i + 1) * w"), ("count", "k")],
                      f"FROM (SELECT i, any_value(l) AS l, any_value(w) AS w, count({_c}) FILTER (WHERE i = greatest(0, ceil(({_c} - l) / w) - 1)) AS k "
                      f"FROM t, {_step}, (SELECT unnest(range(10)) AS i) GROUP BY i)"))
QUERIES["e10_report_all_sections"] = lambda spark, sf: rounded(_report(spark, sf), 2, 0.0)
ORACLES["e10_report_all_sections"] = f"WITH {_ODD.strip()} " + " UNION ALL ".join(_EDA)
_add("k01_kpis_of_odd_names", lambda spark, sf: kpi.kpis(_odd_names(spark, sf)), f"""WITH {_ODD.strip()},
m AS (SELECT sum(amount) AS s FROM t GROUP BY date_trunc('month', total_date))
SELECT count(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns, round(sum(amount), 2) AS total_revenue,
  round(avg(amount), 2) AS average_transaction_value, round(max(amount), 2) AS max_transaction, round(min(amount), 2) AS min_transaction,
  min(total_date) AS date_range_start, max(total_date) AS date_range_end,
  date_diff('day', min(total_date), max(total_date)) AS days_covered, round((SELECT avg(s) FROM m), 2) AS monthly_average_revenue FROM t""", 2)
_add("e11_column_insight", lambda spark, sf: explore.column_insight(dirty_customers(spark, sf), "amount"), f"""
WITH {DIRTY_CTE.strip()} SELECT 'amount' AS "column", 'double' AS data_type, count(amount) AS non_null_count,
  count(*) - count(amount) AS null_count, count(DISTINCT amount) AS unique_values, round(avg(amount), 4) AS mean,
  round(median(amount), 4) AS median, round(stddev_samp(amount), 4) AS std, round(min(amount), 4) AS min,
  round(max(amount), 4) AS max, round(quantile_cont(amount, 0.25), 4) AS q25,
  round(quantile_cont(amount, 0.75), 4) AS q75 FROM d""")
_add("e11_t07_top_values", lambda spark, sf: explore.column_top_values(table(spark, sf, "customer"), "c_mktsegment"), """
SELECT 'c_mktsegment' AS "column", row_number() OVER (ORDER BY n DESC, v) AS rank, v AS value, n AS count
FROM (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, v LIMIT 5""")
_add("e12_compare_columns", lambda spark, sf: explore.compare_columns(
    table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), """
SELECT 'l_quantity' AS column1, 'l_extendedprice' AS column2, round(corr(l_quantity, l_extendedprice), 4) AS correlation,
  count(DISTINCT l_quantity) AS column1_unique_values, count(DISTINCT l_extendedprice) AS column2_unique_values,
  count(*) - count(l_quantity) AS column1_null_count, count(*) - count(l_extendedprice) AS column2_null_count
FROM lineitem""")
_add("j04_numeric_coercion", lambda spark, sf: dirty_customers(spark, sf).select(
    "id", to_number(F.col("balance_text")).alias("balance"), to_number(F.col("score_text")).alias("score")),
    f"WITH {DIRTY_CTE.strip()} SELECT id, try_cast(balance_text AS DOUBLE) AS balance, "
    "try_cast(score_text AS DOUBLE) AS score FROM d")

# --- key figures --------------------------------------------------------------------

_add("k01_k02_k03_k04_kpis", lambda spark, sf: kpi.kpis(transactions(spark, sf), "transaction_date"), f"""
WITH {TRANSACTIONS_SQL.strip()},
m AS (SELECT sum(amount) AS s FROM t GROUP BY date_trunc('month', transaction_date))
SELECT count(*) AS total_rows, CAST(10 AS BIGINT) AS total_columns, round(sum(amount), 2) AS total_revenue,
  round(avg(amount), 2) AS average_transaction_value, round(max(amount), 2) AS max_transaction,
  round(min(amount), 2) AS min_transaction, CAST(min(transaction_date) AS DATE) AS date_range_start,
  CAST(max(transaction_date) AS DATE) AS date_range_end,
  date_diff('day', min(transaction_date), max(transaction_date)) AS days_covered,
  round((SELECT avg(s) FROM m), 2) AS monthly_average_revenue, round(sum(quantity), 2) AS total_quantity,
  round(avg(quantity), 2) AS average_quantity FROM t""", 2)


def _record(spark, sf):
    row = kpi.kpi_record(transactions(spark, sf), store=True)
    return rounded(row.withColumns({
        "regions": F.size("sales_by_region").cast("long"),
        "categories": F.size("sales_by_category").cast("long"),
        "asia_sales": F.element_at("sales_by_region", "ASIA"),
    }).drop("sales_by_region", "sales_by_category"))


QUERIES["k06_kpi_record"] = _record
ORACLES["k06_kpi_record"] = nudged(f"""
WITH {TRANSACTIONS_SQL.strip()},
p AS (SELECT DISTINCT CAST(date_trunc('month', transaction_date) AS DATE) AS m, customer_id FROM t),
a AS (SELECT m, count(*) AS n FROM p GROUP BY 1),
f AS (SELECT customer_id, min(m) AS m FROM p GROUP BY 1),
c AS (SELECT customer_id, count(*) AS n, sum(amount) AS s FROM t GROUP BY 1),
r AS (SELECT b.m, count(*) AS n FROM p b JOIN p n ON n.customer_id = b.customer_id
      AND n.m = CAST(b.m + INTERVAL 1 MONTH AS DATE) GROUP BY 1),
s AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS m, sum(amount) AS s FROM t GROUP BY 1),
g AS (SELECT x.m, round((x.s - y.s) / y.s * 100, 2) AS mom FROM s x JOIN s y ON x.m = CAST(y.m + INTERVAL 1 MONTH AS DATE)),
h AS (SELECT x.m, round((x.s - y.s) / y.s * 100, 2) AS yoy FROM s x JOIN s y ON x.m = CAST(y.m + INTERVAL 1 YEAR AS DATE)),
k AS (SELECT near(sum(amount), 2) AS total_revenue, CAST(count(*) AS DOUBLE) AS total_sales,
  near(avg(amount), 2) AS average_order_value, near(sum(amount - cost), 2) AS total_profit,
  near(100.0 * sum(amount - cost) / sum(amount), 2) AS profit_margin,
  near(sum(quantity) / count(DISTINCT product_id), 2) AS inventory_turnover FROM t)
SELECT k.*, (SELECT round(100.0::DOUBLE * r.n / a.n, 2) FROM r JOIN a ON r.m = a.m ORDER BY r.m DESC LIMIT 1) AS customer_retention_rate,
  (SELECT CAST(count(*) AS DOUBLE) FROM c WHERE n > 1) AS repeat_customers,
  (SELECT CAST(count(*) AS DOUBLE) FROM f WHERE m = (SELECT max(m) FROM p)) AS new_customers,
  (SELECT near(avg(s), 2) FROM c) AS customer_lifetime_value,
  (SELECT mom FROM g ORDER BY m DESC LIMIT 1) AS month_over_month_growth,
  (SELECT yoy FROM h ORDER BY m DESC LIMIT 1) AS year_over_year_growth,
  (SELECT mom FROM g ORDER BY m DESC LIMIT 1) AS growth_rate,
  (SELECT count(DISTINCT region) FROM t) AS regions, (SELECT count(DISTINCT category) FROM t) AS categories,
  (SELECT near(sum(amount), 2) FROM t WHERE region = 'ASIA') AS asia_sales FROM k""")
