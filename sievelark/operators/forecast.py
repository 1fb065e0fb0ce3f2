"""Forecasts of a series: linear trend, smoothing, random forest on lags, ensemble.

A series is prepared once: rows with a known date and value, in order, with their position,
the length of the series and, if needed, the values before. That table is written to the
shared folder, and every method is one or two aggregates over it. Forecast rows are
(by..., method, step, date, value); dates go on by one day per step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.operators import forest
from sievelark.operators.explore import as_time
from sievelark.plans.joins import null_safe_join
from sievelark.plans.longform import quoted
from sievelark.plans.ordered import GROUP_ROWS, ordered
from sievelark.plans.quantiles import quantiles
from sievelark.plans.shared import write_shared

PERIODS, LAGS, ALPHA, TRAIN_SHARE, LEVEL = 12, 7, 0.3, 0.8, 0.9
TREES, DEPTH, SEED, LEAST_ROWS = 100, 30, 42, 10
BINS = 128
"""Split points tried for a lag; 30 levels let trees grow out on series of usual length."""

FOREST_ROWS = 50_000
"""Most rows of a series whose forest is grown in the task that holds it; longer ones are grown by all tasks, with the same result."""


class TooShort(ValueError):
    """The series has too few rows for the method."""


@dataclass(frozen=True)
class Series:
    """``df`` holds (keys, at, y, index, length, lag_1...); ``by`` are the caller's keys."""

    df: DataFrame
    by: list[str]
    keys: list[str]
    lags: int


def prepare(df: DataFrame, date: str, value: str, by: list[str] | None = None, ties: list[str] | None = None,
            lags: int = 0, group_rows: int = GROUP_ROWS) -> Series:
    """Order the series and number its rows; ``ties`` decide between rows of one date."""
    by, ties = list(by or []), list(ties or [])
    keys = by or ["__series"]
    base = df.select(
        *([quoted(b) for b in by] or [F.lit(0).alias("__series")]), as_time(df, date).alias("at"),
        quoted(value).cast("double").alias("y"), *[quoted(t).alias(f"__t{i}") for i, t in enumerate(ties)],
    ).filter(F.col("at").isNotNull() & F.col("y").isNotNull())
    rows = ordered(base, keys, ["at", *[f"__t{i}" for i in range(len(ties))], "y"], before=lags, group_rows=group_rows)
    numbered = rows.df.withColumns({
        "index": rows.row_number() - 1,
        **{f"lag_{i}": F.lag("y", i).over(rows.window) for i in range(1, lags + 1)},
    })
    numbered = rows.finish(numbered).select(*keys, "at", "y", "index", *[f"lag_{i}" for i in range(1, lags + 1)])
    stored = write_shared(numbered, "series")
    lengths = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.max("at").alias("last"))
    return Series(null_safe_join(stored, lengths, keys, "inner"), by, keys, lags)


def _steps(series: Series, models: DataFrame, periods: int, method: str, value: Column) -> DataFrame:
    """Forecast rows from one row per series with ``last`` and what ``value`` needs."""
    steps = F.sequence(F.lit(1), F.lit(periods))
    return models.withColumn("step", F.explode(steps)).select(
        *series.by, F.lit(method).alias("method"), F.col("step").cast("long").alias("step"),
        F.date_add(F.to_date("last"), F.col("step")).alias("date"), value.alias("value"),
    )


def _quality(tested: DataFrame, keys: list[str], guess: Column) -> DataFrame:
    """r_squared, rmse and mape of a guess on the test rows."""
    y, miss = F.col("y"), F.col("y") - guess
    relative = F.when(y == 0, F.lit(float("inf"))).otherwise(F.abs(F.try_divide(miss, y)))
    sums = tested.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_rows"), F.sum(miss * miss).alias("__res"),
        F.var_pop("y").alias("__var"), F.avg(relative).alias("__rel"), F.count_if(y != 0).alias("__nonzero"),
    )
    total = F.col("__var") * F.col("test_rows")
    r2 = F.when(F.col("test_rows") < 2, F.lit(None)).when(
        total == 0, F.when(F.col("__res") == 0, 1.0).otherwise(0.0)
    ).otherwise(1 - F.try_divide(F.col("__res"), total))
    return sums.select(
        *keys, "test_rows", r2.alias("r_squared"), F.sqrt(F.try_divide("__res", "test_rows")).alias("rmse"),
        F.when(F.col("__nonzero") > 0, F.col("__rel")).alias("mape"),
    )


# --- linear trend -------------------------------------------------------------------


def _trend_models(series: Series) -> DataFrame:
    """Slope and intercept over the first 80 % of each series, by row position."""
    train = F.floor(F.col("length") * TRAIN_SHARE)
    inside = series.df.filter(F.col("index") < train)
    return inside.groupBy(*series.keys).agg(
        F.first("length").alias("length"), F.first("last").alias("last"),
        F.coalesce(F.regr_slope("y", "index"), F.lit(0.0)).alias("trend"),
        F.coalesce(F.regr_intercept("y", "index"), F.avg("y")).alias("intercept"),
    )


def linear_forecast(series: Series, periods: int = PERIODS) -> DataFrame:
    at = F.col("length") - 1 + F.col("step")
    return _steps(series, _trend_models(series), periods, "linear_regression",
                  F.col("intercept") + F.col("trend") * at)


def linear_metrics(series: Series) -> DataFrame:
    """(by..., method, trend, test_rows, r_squared, rmse, mape) on the last 20 %."""
    models = _trend_models(series).select(*series.keys, "trend", "intercept")
    tested = null_safe_join(series.df, models, series.keys, "inner").filter(
        F.col("index") >= F.floor(F.col("length") * TRAIN_SHARE))
    quality = _quality(tested, series.keys, F.col("intercept") + F.col("trend") * F.col("index"))
    return null_safe_join(models, quality, series.keys, "left").select(
        *series.by, F.lit("linear_regression").alias("method"), "trend", "test_rows", "r_squared", "rmse", "mape")


# --- intervals ----------------------------------------------------------------------


def with_intervals(steps: DataFrame, tested: DataFrame, by: list[str], level: float = LEVEL, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Forecast rows with ``lower``, ``upper`` and ``level``: split-conformal intervals from the misses on rows the model has not learned.

    ``tested`` holds (by..., y, guess). With n of them the half width is the k-th smallest absolute miss, k = ceil((n + 1) * level):
    a new miss of the same kind exceeds it in at most 1 - ``level`` of cases, whatever its distribution. Series with too few
    rows for the level (k > n) have NULL limits. The rank is exact; large series are ranked in slices.
    """
    if not 0 < level < 1:
        raise ValueError("the level lies between 0 and 1")
    keys = by or ["__series"]
    misses = tested.select(*([quoted(b) for b in by] or [F.lit(0).alias("__series")]), F.abs(F.col("y") - F.col("guess")).alias("miss"))
    rows = ordered(misses, keys, ["miss"], group_rows=group_rows)
    ranked = rows.finish(rows.df.withColumn("place", rows.row_number())).select(*keys, "miss", "place")
    counts = misses.groupBy(*keys).agg(F.ceil(F.round((F.count(F.lit(1)) + 1) * F.lit(float(level)), 9)).alias("wanted"))
    width = null_safe_join(ranked, counts, keys, "inner").filter(F.col("place") == F.col("wanted")).select(*keys, "miss")
    whole = steps if by else steps.withColumn("__series", F.lit(0))
    found = null_safe_join(whole, width, keys, "left")
    return found.select(*steps.columns, (F.col("value") - F.col("miss")).alias("lower"), (F.col("value") + F.col("miss")).alias("upper"),
                        F.lit(float(level)).alias("level"))


def linear_intervals(series: Series, periods: int = PERIODS, level: float = LEVEL) -> DataFrame:
    """The linear forecast with intervals from its misses on the last 20 % of each series."""
    models = _trend_models(series).select(*series.keys, "trend", "intercept")
    tested = null_safe_join(series.df, models, series.keys, "inner").filter(F.col("index") >= F.floor(F.col("length") * TRAIN_SHARE))
    tested = tested.select(*series.by, "y", (F.col("intercept") + F.col("trend") * F.col("index")).alias("guess"))
    return with_intervals(linear_forecast(series, periods), tested, series.by, level)


def forest_intervals(series: Series, periods: int = PERIODS, level: float = LEVEL, **options) -> DataFrame:
    """The forest's forecast with intervals from its misses one step ahead on the last 20 % of each series."""
    found = forest_forecast(series, periods, **options)
    return with_intervals(found.forecast, found.tested, series.by, level)


# --- exponential smoothing ----------------------------------------------------------


def smoothing_forecast(series: Series, periods: int = PERIODS, alpha: float = ALPHA) -> DataFrame:
    """Flat forecast at the last level.

    The recursion is a weighted sum: weight alpha(1-alpha)^k for the row k places from the
    end and (1-alpha)^(n-1) for the first row. So the level is one aggregate, in any order.
    """
    back = F.col("length") - 1 - F.col("index")
    decay = F.pow(F.lit(1.0 - alpha), back)
    weight = F.when(F.col("index") == 0, decay).otherwise(F.lit(float(alpha)) * decay)
    levels = series.df.groupBy(*series.keys).agg(
        F.sum(F.col("y") * weight).alias("level"), F.first("last").alias("last"))
    return _steps(series, levels, periods, "exponential_smoothing", F.col("level"))


# --- random forest on lags ----------------------------------------------------------


@dataclass(frozen=True)
class ForestForecast:
    forecast: DataFrame
    metrics: DataFrame
    importance: DataFrame
    tested: DataFrame
    """(by..., y, guess) of the rows the forest was tested with."""


def _limits(known: DataFrame, keys: list[str], lags: int, bins: int) -> DataFrame:
    """Per series the limits of its bins (quantiles of the values it learns from), the largest of these values and their number."""
    learned = known.filter(F.col("index") < _learned(lags))
    shares = [k / bins for k in range(1, bins)]
    edges = quantiles(learned, ["y"], shares, by=keys).select(*keys, F.array_sort(F.array_distinct("quantiles")).alias("edges"))
    sizes = learned.groupBy(*keys).agg(F.max(F.abs("y")).alias("largest"), F.count(F.lit(1)).alias("train"))
    return write_shared(null_safe_join(edges, sizes, keys, "inner"), "limits")


def _learned(lags: int) -> Column:
    """The position at which the rows to test with begin: after the first 80 % of those whose lags are known."""
    return lags + F.floor((F.col("length") - lags) * TRAIN_SHARE)


def forest_forecast(series: Series, periods: int = PERIODS, trees: int = TREES, depth: int = DEPTH,
                    seed: int = SEED, bins: int = BINS, rows: int = FOREST_ROWS, leaves: int = forest.LEAVES) -> ForestForecast:
    """A random forest for each series on the values before, trained on the first 80 % of its rows and tested on the others.

    The forecast goes step by step: each predicted value becomes the newest lag. A series of up to ``rows`` rows is
    learned in the task that holds it, a longer one by all tasks together; both ways give the same forest
    (:mod:`sievelark.operators.forest`). Series too short for a forest have no rows; a single series that is too short raises.
    """
    if series.lags < 1:
        raise ValueError("a random forest needs a series prepared with lags")
    lags, keys = [f"lag_{i}" for i in range(1, series.lags + 1)], list(series.keys)
    everything = series.df.filter((F.col("index") >= series.lags) & (F.col("length") - series.lags >= LEAST_ROWS))
    everything = everything.withColumn("last", F.to_date("last"))
    if not series.by and everything.isEmpty():
        raise TooShort(f"a forest needs {LEAST_ROWS} rows with all lags known")
    limits = _limits(everything, keys, series.lags, bins)
    known = everything.select(*keys, "index", "length", "last", "y", *lags)
    columns = [*keys, "kind", "step", "date", "value", "guess"]
    kinds = ", ".join(f"`{k}` {known.schema[k].dataType.simpleString()}" for k in keys)
    result = f"{kinds}, kind string, step long, date date, value double, guess double"

    def learn(group: pd.DataFrame, limit: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return group[keys].assign(kind="", step=0, date=None, value=0.0, guess=0.0)[columns]
        group = group.sort_values("index")
        x, y, cut = group[lags].to_numpy(float), group["y"].to_numpy(float), int(limit["train"].iloc[0])
        edges = [np.asarray(limit["edges"].iloc[0], float)] * len(lags)
        grown = forest.Grown(x[:cut], y[:cut], edges, group["index"].to_numpy()[:cut], trees, depth, seed,
                             float(limit["largest"].iloc[0]), leaves)
        values = grown.steps([y[-1], *x[-1][:-1]], periods)
        last, steps = pd.Timestamp(group["last"].iloc[0]), range(1, periods + 1)
        found = pd.concat([
            pd.DataFrame({"kind": "forecast", "step": steps, "value": values, "guess": 0.0,
                          "date": [(last + pd.Timedelta(days=k)).date() for k in steps]}),
            pd.DataFrame({"kind": "test", "step": 0, "value": y[cut:], "guess": grown.predict(x[cut:]), "date": None}),
            pd.DataFrame({"kind": "importance", "step": range(1, len(lags) + 1), "value": grown.importance, "guess": 0.0, "date": None}),
        ], ignore_index=True)
        for key in keys:
            found[key] = group[key].iloc[0]
        return found[columns]

    short = known.filter(F.col("length") <= rows).groupBy(*keys)
    bounds = limits.filter(F.col("train") <= rows).groupBy(*keys)
    found = write_shared(short.cogroup(bounds).applyInPandas(learn, result), "forests")
    long = everything.filter(F.col("length") > rows).groupBy(*keys).agg(F.max("last").alias("last"))
    for row in null_safe_join(long, limits, keys, "inner").toLocalIterator():
        own = known.filter(reduce(Column.__and__, [quoted(k).eqNullSafe(F.lit(row[k])) for k in keys]))
        found = found.unionByName(write_shared(_long_forest(own, row, known, keys, lags, periods, trees, depth, seed, leaves), "forests"))
    method = F.lit("random_forest").alias("method")
    quality = _quality(found.filter("kind = 'test'").withColumnRenamed("value", "y"), series.keys, F.col("guess"))
    return ForestForecast(
        found.filter("kind = 'forecast'").select(*series.by, method, "step", "date", "value"),
        quality.select(*series.by, method, "test_rows", "r_squared", "rmse", "mape"),
        found.filter("kind = 'importance'").select(
            *series.by, F.concat(F.lit("lag_"), F.col("step")).alias("feature"), F.col("value").alias("importance")),
        found.filter("kind = 'test'").select(*series.by, F.col("value").alias("y"), "guess"),
    )


def _long_forest(own: DataFrame, row, known: DataFrame, keys: list[str], lags: list[str], periods: int, trees: int, depth: int,
                 seed: int, leaves: int) -> DataFrame:
    """Forecast, test and importance rows of one series that is learned by all tasks; its forest is bounded by the leaves of a tree."""
    spark, first = own.sparkSession, len(lags)
    cut = first + row["train"]
    edges = [np.asarray(row["edges"], float)] * first
    grown = forest.grow_spread(own.filter(F.col("index") < cut), lags, "y", "index", edges, row["largest"], row["train"], trees, depth, seed, leaves)
    newest = [r["y"] for r in own.orderBy(F.desc("index")).limit(first).select("y").collect()]
    days = pd.Timestamp(row["last"])
    few = [("forecast", k, (days + pd.Timedelta(days=k)).date(), v, 0.0) for k, v in enumerate(grown.steps(newest, periods), 1)]
    few += [("importance", k, None, float(w), 0.0) for k, w in enumerate(grown.importance, 1)]
    named = [F.lit(row[k]).cast(known.schema[k].dataType).alias(k) for k in keys]
    figures = spark.createDataFrame(few, "kind string, step long, date date, value double, guess double")
    sent = spark.sparkContext.broadcast(grown)

    @F.pandas_udf("double")
    def guess(*columns: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    tested = own.filter(F.col("index") >= cut).select(
        *named, F.lit("test").alias("kind"), F.lit(0).cast("long").alias("step"), F.lit(None).cast("date").alias("date"),
        F.col("y").alias("value"), guess(*lags).alias("guess"))
    return figures.select(*named, *figures.columns).unionByName(tested)


class _Regressor(forest.Grown):
    """A forest over features of any kind, with bins between the quantiles of each."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, bins: int):
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        super().__init__(x, y, edges, np.arange(len(y)), trees, depth, seed)


# --- ensemble and dispatch ----------------------------------------------------------


def ensemble(parts: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Mean of the methods' forecasts per step."""
    by = list(by or [])
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*by, "step")
        .agg(F.max("date").alias("date"), F.avg("value").alias("value"))
        .select(*by, F.lit("ensemble").alias("method"), "step", "date", "value")
    )


def forecast_report(series: Series, periods: int = PERIODS) -> dict[str, DataFrame]:
    """``forecast`` of all methods and their ensemble, ``metrics`` and lag ``importance``.

    Series too short for the forest go without it.
    """
    parts = [linear_forecast(series, periods), smoothing_forecast(series, periods)]
    metrics = linear_metrics(series)
    report = {}
    if series.lags:
        try:
            found = forest_forecast(series, periods)
            parts.append(found.forecast)
            metrics = metrics.unionByName(found.metrics, allowMissingColumns=True)
            report["importance"] = found.importance
        except TooShort:
            pass
    together = reduce(DataFrame.unionByName, [*parts, ensemble(parts, series.by)])
    return {"forecast": together, "metrics": metrics, **report}


def combined_forecast(series: Series, periods: int = PERIODS) -> DataFrame:
    """Forecast rows of all methods and their ensemble."""
    return forecast_report(series, periods)["forecast"]


def forecast(df: DataFrame, date: str, value: str, method: str = "combined", periods: int = PERIODS,
             by: list[str] | None = None, ties: list[str] | None = None, **options) -> DataFrame:
    """Dispatch by method name; an unknown name means all methods combined."""
    lagged = method not in ("linear_regression", "exponential_smoothing")
    series = prepare(df, date, value, by, ties, LAGS if lagged else 0)
    if method == "linear_regression":
        return linear_forecast(series, periods)
    if method == "exponential_smoothing":
        return smoothing_forecast(series, periods, **options)
    if method == "random_forest":
        return forest_forecast(series, periods, **options).forecast
    return combined_forecast(series, periods)
