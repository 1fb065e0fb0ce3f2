"""Anomalies, spikes and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.operators import anomaly, forecast
from sievelark.operators.isolation import isolation_forest
from sievelark.plans.rowid import with_row_index
from suite.inputs import DAILY_CTE, daily_orders, rounded, table

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None, places=4):
    QUERIES[name] = lambda spark, sf: rounded(query(spark, sf), places, 0.0)
    if sql is not None:
        ORACLES[name] = sql


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value")


_Z = """round(abs(value - m) / p, 4) AS score, round(m, 4) AS mean, round(s, 4) AS std"""
_STATS = "avg(value) AS m, stddev_pop(value) AS p, stddev_samp(value) AS s"
_add("a02_z_score", lambda spark, sf: anomaly.z_scores(_events(spark, sf), ["event_id"], 2.5), f"""
SELECT event_id, 'z_score' AS method, 'value' AS "column", round(value, 4) AS value, 2.5::DOUBLE AS threshold, {_Z}
FROM events, (SELECT {_STATS} FROM events) WHERE abs(value - m) / p > 2.5""")
_add("a02_z_score_by_type", lambda spark, sf: anomaly.z_scores(
    _events(spark, sf), ["event_id"], 2.5, by=["event_type"]), f"""
SELECT e.event_type, event_id, 'z_score' AS method, 'value' AS "column", round(value, 4) AS value,
  2.5::DOUBLE AS threshold, {_Z}
FROM events e JOIN (SELECT event_type, {_STATS} FROM events GROUP BY 1) g ON e.event_type = g.event_type
WHERE abs(value - m) / p > 2.5""")
_FENCES = "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3"
_IQR = """round(value, 6) AS value, 1.5::DOUBLE AS threshold,
  round(least(abs(value - (q1 - 1.5 * (q3 - q1))), abs(value - (q3 + 1.5 * (q3 - q1)))), 6) AS score,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound"""
_OUT = "value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"
_add("a03_iqr", lambda spark, sf: anomaly.iqr(_events(spark, sf), ["event_id"]), f"""
SELECT event_id, 'iqr' AS method, 'value' AS "column", {_IQR}
FROM events, (SELECT {_FENCES} FROM events) WHERE {_OUT}""", 6)
_GROUPED = f"""
SELECT e.event_type, event_id, 'iqr' AS method, 'value' AS "column", {_IQR}
FROM events e JOIN (SELECT event_type, {_FENCES} FROM events GROUP BY 1) g ON e.event_type = g.event_type
WHERE {_OUT}"""
_add("a03_iqr_by_type", lambda spark, sf: anomaly.iqr(_events(spark, sf), ["event_id"], by=["event_type"]), _GROUPED, 6)
_add("a03_iqr_by_type_search", lambda spark, sf: anomaly.iqr(
    _events(spark, sf), ["event_id"], by=["event_type"], limit=500), _GROUPED, 6)
_add("u01_united_findings", lambda spark, sf: anomaly.unite([
    anomaly.z_scores(_events(spark, sf), ["event_id"], 2.5), anomaly.iqr(_events(spark, sf), ["event_id"])],
    ["event_id"]).select("event_id", "method_count"), f"""
SELECT event_id, count(*) AS method_count FROM (
  SELECT event_id, 1 AS k FROM events, (SELECT {_STATS} FROM events) WHERE abs(value - m) / p > 2.5
  UNION SELECT event_id, 2 FROM events, (SELECT {_FENCES} FROM events) WHERE {_OUT}) GROUP BY 1""")
_add("t06_most_extreme", lambda spark, sf: anomaly.top(
    anomaly.iqr(_events(spark, sf), ["event_id"]), 100).agg(
        F.count(F.lit(1)).alias("findings"), F.min("score").alias("least_score"), F.max("score").alias("best_score")), f"""
SELECT count(*) AS findings, round(min(d), 4) AS least_score, round(max(d), 4) AS best_score FROM (
  SELECT least(abs(value - (q1 - 1.5 * (q3 - q1))), abs(value - (q3 + 1.5 * (q3 - q1)))) AS d
  FROM events, (SELECT {_FENCES} FROM events) WHERE {_OUT} ORDER BY d DESC LIMIT 100)""")


def _line_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _forest_facts(spark, sf):
    """What holds for any isolation forest: planted far rows come first, ids are distinct, at most the share asked for is found."""
    rows = with_row_index(table(spark, sf, "lineitem")).select(
        "l_orderkey", "row_index", *[F.when(F.col("l_orderkey") % 1000 == 1, F.col(c) * 50 + 1000).otherwise(F.col(c)).alias(c)
                                        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    ids = ["l_orderkey", "row_index"]
    found = isolation_forest(rows, ids, contamination=0.05)
    planted = found.filter("l_orderkey % 1000 = 1").select(*ids, "anomaly_score")
    least = found.filter("l_orderkey % 1000 <> 1").agg(F.min("anomaly_score")).scalar()
    marked = planted.withColumn("first", F.col("anomaly_score") < least)
    return marked.agg(F.count(F.lit(1)).alias("planted_found"), F.count_if("first").alias("before_all_others")).withColumns({
        "ids_distinct": (found.select(*ids).distinct().agg(F.count(F.lit(1))).scalar() == found.agg(F.count(F.lit(1))).scalar()),
        "within_share": found.agg(F.count(F.lit(1))).scalar() <= F.ceil(0.05 * rows.agg(F.count(F.lit(1))).scalar())})


_add("a01_isolation_forest", _forest_facts, """
SELECT count(*) AS planted_found, count(*) AS before_all_others, true AS ids_distinct, true AS within_share
FROM lineitem WHERE l_orderkey % 1000 = 1""")
_add("a01_isolation_forest_rows", lambda spark, sf: isolation_forest(_line_rows(spark, sf)))
_add("a04_combined_by_row", lambda spark, sf: anomaly.combined(_events(spark, sf), ["event_id"], columns=["value"]).select(
    "event_id", F.array_contains("methods", "z_score").alias("far"), F.array_contains("methods", "iqr").alias("outside")).filter(
        F.col("far") | F.col("outside")), f"""
SELECT event_id, coalesce(abs(value - m) / p > 3, false) AS far, coalesce({_OUT}, false) AS outside
FROM events, (SELECT {_STATS} FROM events), (SELECT {_FENCES} FROM events)
WHERE abs(value - m) / p > 3 OR {_OUT}""")
_add("a04_combined_detection", lambda spark, sf: anomaly.combined(_events(spark, sf), ["event_id"], columns=["value"])
     .groupBy("method_count").agg(F.count(F.lit(1)).alias("rows")))
_add("a06_anomaly_records", lambda spark, sf: anomaly.records(
    anomaly.z_scores(_events(spark, sf), ["event_id"], 2.5), ["event_id"]), f"""
SELECT event_id, 'value' AS "column", 'outlier' AS anomaly_type, 'z_score' AS method, round(value, 4) AS value,
  2.5::DOUBLE AS threshold, round(abs(value - m) / p, 4) AS score
FROM events, (SELECT {_STATS} FROM events) WHERE abs(value - m) / p > 2.5""")


def _spikes(part):
    key = "event_type, " if part else ""
    over = f"({'PARTITION BY event_type ' if part else ''}ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    return f"""
WITH w AS (SELECT {key}event_id, ts, value, avg(value) OVER {over} AS ma, stddev_samp(value) OVER {over} AS sd FROM events)
SELECT {key}event_id, CAST(ts AS DATE) AS date, round(value, 4) AS amount, round(ma, 4) AS moving_average,
  round((value - ma) / sd, 4) AS z_score, CASE WHEN value > ma THEN 'spike' ELSE 'dip' END AS spike_type
FROM w WHERE sd > 0 AND abs((value - ma) / sd) > 2"""


def _event_spikes(by=None, **options):
    return lambda spark, sf: anomaly.spikes(
        table(spark, sf, "events"), "ts", "value", by=by, ties=["event_id"], **options
    ).withColumn("date", F.to_date("date"))


_add("a05_w08_spikes", _event_spikes(), _spikes(False))
_add("a05_w08_spikes_split", _event_spikes(group_rows=1500), _spikes(False))
_add("a05_spikes_by_type", _event_spikes(["event_type"]), _spikes(True))
_add("a05_daily_spikes", lambda spark, sf: anomaly.spikes(daily_orders(spark, sf), "day", "total"), f"""
WITH {DAILY_CTE.strip()}, w AS (SELECT day, total, avg(total) OVER o AS ma, stddev_samp(total) OVER o AS sd FROM daily
  WINDOW o AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT day AS date, round(total, 4) AS amount, round(ma, 4) AS moving_average, round((total - ma) / sd, 4) AS z_score,
  CASE WHEN total > ma THEN 'spike' ELSE 'dip' END AS spike_type FROM w WHERE sd > 0 AND abs((total - ma) / sd) > 2""")

# --- forecasts ----------------------------------------------------------------------

_INDEXED = f"""
WITH {DAILY_CTE.strip()}, s AS (SELECT day, total AS y, row_number() OVER (ORDER BY day) - 1 AS i FROM daily),
n AS (SELECT count(*) AS n, max(day) AS last FROM s),
f AS (SELECT regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM s, n WHERE i < floor(n * 0.8)),
steps AS (SELECT unnest(range(1, 13)) AS step)"""
_DAY = "CAST(last + CAST(step AS INTEGER) AS DATE) AS date"


def _daily(spark, sf, lags=0, group_rows=forecast.GROUP_ROWS):
    return forecast.prepare(daily_orders(spark, sf), "day", "total", lags=lags, group_rows=group_rows)


_LINEAR = f"""{_INDEXED} SELECT 'linear_regression' AS method, step, {_DAY}, round(a + b * (n - 1 + step), 2) AS value
FROM f, n, steps"""
_add("m01_linear_forecast", lambda spark, sf: forecast.linear_forecast(_daily(spark, sf)), _LINEAR, 2)
_add("m01_linear_forecast_split", lambda spark, sf: forecast.linear_forecast(_daily(spark, sf, group_rows=500)), _LINEAR, 2)
_add("m05_linear_metrics", lambda spark, sf: forecast.linear_metrics(_daily(spark, sf)), f"""{_INDEXED},
t AS (SELECT y, a + b * i AS p, b FROM s, f, n WHERE i >= floor(n * 0.8))
SELECT 'linear_regression' AS method, round(any_value(b), 4) AS trend, count(*) AS test_rows,
  round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r_squared, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
  round(avg(abs((y - p) / y)), 4) AS mape FROM t""")
_add("m03_smoothing_forecast", lambda spark, sf: forecast.smoothing_forecast(_daily(spark, sf)), f"""{_INDEXED},
l AS (SELECT sum(y * CASE WHEN i = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - i) END) AS level FROM s, n)
SELECT 'exponential_smoothing' AS method, step, {_DAY}, round(level, 2) AS value FROM l, n, steps""", 2)
_add("m01_trend_by_type", lambda spark, sf: forecast.linear_forecast(forecast.prepare(
    table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("total")), "day", "total", by=["event_type"])), """
WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS y FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i,
      count(*) OVER (PARTITION BY event_type) AS n, max(day) OVER (PARTITION BY event_type) AS last FROM g),
f AS (SELECT event_type, any_value(n) AS n, any_value(last) AS last, regr_slope(y, i) AS b, regr_intercept(y, i) AS a
      FROM s WHERE i < floor(n * 0.8) GROUP BY 1)
SELECT event_type, 'linear_regression' AS method, step, CAST(last + CAST(step AS INTEGER) AS DATE) AS date,
  round(a + b * (n - 1 + step), 2) AS value FROM f, (SELECT unnest(range(1, 13)) AS step)""", 2)
_add("w09_w10_lags", lambda spark, sf: _daily(spark, sf, 7).df.select(
    F.to_date("at").alias("day"), "y", "index", *[f"lag_{i}" for i in range(1, 8)]), f"""{_INDEXED}
SELECT day, round(y, 2) AS y, i AS index, {', '.join(f'round(lag(y, {k}) OVER (ORDER BY day), 2) AS lag_{k}' for k in range(1, 8))}
FROM s""", 2)
_add("m02_forest_forecast", lambda spark, sf: forecast.forest_forecast(_daily(spark, sf, 7)).forecast)
_add("m04_combined_forecast", lambda spark, sf: forecast.forecast(daily_orders(spark, sf), "day", "total"))


def _waves(spark, sf):
    """A series over the days of the orders that repeats every eight days."""
    days = daily_orders(spark, sf).select("day")
    placed = forecast.prepare(days.withColumn("one", F.lit(1.0)), "day", "one").df
    return placed.select(F.to_date("at").alias("day"), (100 + 10.0 * (F.col("index") * 5 % 8)).alias("total"))


def _forest_steps(rows):
    def steps(spark, sf):
        found = forecast.forest_forecast(forecast.prepare(_waves(spark, sf), "day", "total", lags=7), trees=20, rows=rows)
        good = found.metrics.select(F.col("r_squared") > 0.9, F.col("rmse") < 5).first()
        return found.forecast.select("method", "step", "date", F.round(F.col("value") / 10).cast("long").alias("tens"),
                                     F.lit(good[0]).alias("explains"), F.lit(good[1]).alias("is_near"))
    return steps


_STEPS = f"""{_INDEXED} SELECT 'random_forest' AS method, step, {_DAY}, CAST(10 + (n - 1 + step) * 5 % 8 AS BIGINT) AS tens,
  true AS explains, true AS is_near FROM n, steps"""
_add("m02_forest_steps", _forest_steps(forecast.FOREST_ROWS), _STEPS)
_add("m02_forest_steps_spread", _forest_steps(0), _STEPS)
_add("m06_linear_intervals", lambda spark, sf: forecast.linear_intervals(_daily(spark, sf)), f"""{_INDEXED},
t AS (SELECT abs(y - a - b * i) AS miss, row_number() OVER (ORDER BY abs(y - a - b * i)) AS place, count(*) OVER () AS tested FROM s, f, n
      WHERE i >= floor(n * 0.8)),
q AS (SELECT miss FROM t WHERE place = ceil((tested + 1) * 0.9))
SELECT 'linear_regression' AS method, step, {_DAY}, round(a + b * (n - 1 + step), 2) AS value,
  round(a + b * (n - 1 + step) - miss, 2) AS lower, round(a + b * (n - 1 + step) + miss, 2) AS upper, 0.9::DOUBLE AS level
FROM f, n, steps, q""", 2)
_add("m06_intervals_by_type", lambda spark, sf: forecast.linear_intervals(forecast.prepare(
    _by_type(spark, sf), "day", "total", by=["event_type"]), level=0.7), """
WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS y FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i,
      count(*) OVER (PARTITION BY event_type) AS n, max(day) OVER (PARTITION BY event_type) AS last FROM g),
f AS (SELECT event_type, any_value(n) AS n, any_value(last) AS last, regr_slope(y, i) AS b, regr_intercept(y, i) AS a
      FROM s WHERE i < floor(n * 0.8) GROUP BY 1),
t AS (SELECT s.event_type, abs(y - a - b * i) AS miss, row_number() OVER (PARTITION BY s.event_type ORDER BY abs(y - a - b * i)) AS place,
        count(*) OVER (PARTITION BY s.event_type) AS tested FROM s JOIN f USING (event_type) WHERE i >= floor(s.n * 0.8)),
q AS (SELECT event_type, miss FROM t WHERE place = ceil((tested + 1) * 0.7))
SELECT event_type, 'linear_regression' AS method, step, CAST(last + CAST(step AS INTEGER) AS DATE) AS date,
  round(a + b * (n - 1 + step), 2) AS value, round(a + b * (n - 1 + step) - miss, 2) AS lower,
  round(a + b * (n - 1 + step) + miss, 2) AS upper, 0.7::DOUBLE AS level
FROM f LEFT JOIN q USING (event_type), (SELECT unnest(range(1, 13)) AS step)""", 2)


def _ensemble_facts(frame, keys):
    """The parts SQL can give as they are; the ensemble as difference from the mean of the other methods."""
    wide = frame.groupBy(*keys, "step", "date").pivot("method", [
        "linear_regression", "exponential_smoothing", "random_forest", "ensemble"]).agg(F.first("value"))
    mean = (F.col("linear_regression") + F.col("exponential_smoothing") + F.col("random_forest")) / 3
    return wide.select(*keys, "step", "date", "linear_regression", "exponential_smoothing",
                       (F.abs(F.col("ensemble") - mean) < 1e-6).alias("is_mean"))


_add("m04_ensemble_parts", lambda spark, sf: _ensemble_facts(forecast.forecast(daily_orders(spark, sf), "day", "total"), []),
     f"""{_INDEXED}, l AS (SELECT sum(y * CASE WHEN i = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - i) END) AS level FROM s, n)
SELECT step, {_DAY}, round(a + b * (n - 1 + step), 2) AS linear_regression, round(level, 2) AS exponential_smoothing, true AS is_mean
FROM f, n, l, steps""", 2)


def _by_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("total"))


_add("m04_ensemble_by_type", lambda spark, sf: _ensemble_facts(
    forecast.forecast(_by_type(spark, sf), "day", "total", by=["event_type"]), ["event_type"]), """
WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS y FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i,
      count(*) OVER (PARTITION BY event_type) AS n, max(day) OVER (PARTITION BY event_type) AS last FROM g),
f AS (SELECT event_type, any_value(n) AS n, any_value(last) AS last, regr_slope(y, i) AS b, regr_intercept(y, i) AS a
      FROM s WHERE i < floor(n * 0.8) GROUP BY 1),
l AS (SELECT event_type, sum(y * CASE WHEN i = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - i) END) AS level FROM s GROUP BY 1)
SELECT event_type, step, CAST(last + CAST(step AS INTEGER) AS DATE) AS date, round(a + b * (n - 1 + step), 2) AS linear_regression,
  round(level, 2) AS exponential_smoothing, true AS is_mean
FROM f JOIN l USING (event_type), (SELECT unnest(range(1, 13)) AS step)""", 2)
