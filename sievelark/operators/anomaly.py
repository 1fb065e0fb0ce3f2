"""Anomalies by z-score, quartile fences, isolation forest and rolling statistics.

Results are long: (ids..., method, column, value, threshold, score, ...). All findings are
returned; ``top`` cuts to the most extreme ones with a top-k sort.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import roles
from sievelark.operators.explore import as_time
from sievelark.operators.isolation import CONTAMINATION, isolation_forest
from sievelark.plans.joins import null_safe_join
from sievelark.plans.longform import cells, quoted
from sievelark.plans.moments import moments
from sievelark.plans.ordered import GROUP_ROWS, ordered
from sievelark.plans.quantiles import QUANTILE_ROWS, collect_quantiles, quantiles

Z_THRESHOLD, IQR_MULTIPLIER, SPIKE_THRESHOLD, ROLLING_ROWS, SHOWN = 3.0, 1.5, 2.0, 7, 100


def _features(df: DataFrame, columns: list[str] | None, ids: list[str], by: list[str]) -> list[str]:
    return [c for c in roles.existing(df, columns, roles.numeric_columns(df)) if c not in ids and c not in by]


def _findings(df: DataFrame, keys: list[str], found: list[Column], outside: list[Column] | None = None) -> DataFrame:
    """``outside`` holds plain comparisons that any finding satisfies; they reach the scan."""
    present = F.filter(F.array(*found), lambda v: v.isNotNull())
    if outside:
        df = df.filter(reduce(or_, outside))
    return df.select(*[quoted(k) for k in keys], F.inline(present))


def z_scores(df: DataFrame, ids: list[str], threshold: float = Z_THRESHOLD, columns: list[str] | None = None,
             by: list[str] | None = None) -> DataFrame:
    """Values more than ``threshold`` population deviations from the mean.

    ``score`` is the absolute z, ``std`` the sample deviation. A constant column has none.
    With ``by`` the statistics are those of the row's own group.
    """
    by = list(by or [])
    columns = _features(df, columns, ids, by)
    if by:
        return _z_by_group(df, ids, by, columns, threshold)
    stats = moments(df, columns, powers=2) if columns else {}
    found, outside = [], []
    for c in columns:
        s = stats[c]
        if not s.varies:
            continue
        z = F.abs((quoted(c) - s.mean) / s.std_pop)
        reach = threshold * s.std_pop
        slack = 1e-9 * (abs(s.mean) + reach)  # the z-score itself decides at the limit
        outside.append((quoted(c) < s.mean - reach + slack) | (quoted(c) > s.mean + reach - slack))
        found.append(F.when(z > threshold, _z_record(c, quoted(c), z, F.lit(s.mean), F.lit(s.std), threshold)))
    if not found:
        return _z_by_group(df, ids, [], [], threshold)
    return _findings(df, ids, found, outside)


def _z_record(name: str, value: Column, z: Column, mean: Column, std: Column, threshold: float) -> Column:
    return F.struct(
        F.lit("z_score").alias("method"), F.lit(name).alias("column"), value.cast("double").alias("value"),
        F.lit(float(threshold)).alias("threshold"), z.alias("score"), mean.alias("mean"), std.alias("std"),
    )


def _z_by_group(df: DataFrame, ids: list[str], by: list[str], columns: list[str], threshold: float) -> DataFrame:
    if not columns:
        empty = F.array().cast("array<struct<method:string,column:string,value:double,threshold:double,"
                               "score:double,mean:double,std:double>>")
        return df.select(*[quoted(i) for i in [*by, *ids]], F.inline(empty))
    wanted = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        wanted += [F.avg(x).alias(f"__m{i}"), F.stddev_pop(x).alias(f"__p{i}"), F.stddev_samp(x).alias(f"__s{i}")]
    joined = null_safe_join(df, df.groupBy(*by).agg(*wanted), by, "left")
    found = []
    for i, c in enumerate(columns):
        z = F.abs(F.try_divide(quoted(c) - F.col(f"__m{i}"), F.col(f"__p{i}")))
        found.append(F.when(z > threshold, _z_record(c, quoted(c), z, F.col(f"__m{i}"), F.col(f"__s{i}"), threshold)))
    return _findings(joined, [*by, *ids], found)


def iqr(df: DataFrame, ids: list[str], multiplier: float = IQR_MULTIPLIER, columns: list[str] | None = None,
        by: list[str] | None = None, limit: int = QUANTILE_ROWS) -> DataFrame:
    """Values outside the quartile fences; ``score`` is the distance to the nearer fence."""
    by = list(by or [])
    columns = _features(df, columns, ids, by)
    if by:
        return _iqr_by_group(df, ids, by, columns, multiplier, limit)
    found, limits = [], []
    for c, (q1, q3) in collect_quantiles(df, columns, [0.25, 0.75], limit=limit).items():
        if q1 is not None:
            low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
            outside = (quoted(c) < low) | (quoted(c) > high)
            limits.append(outside)
            found.append(F.when(outside, _iqr_record(F.lit(c), quoted(c), F.lit(low), F.lit(high), multiplier)))
    if not found:
        found = [F.when(F.lit(False), _iqr_record(F.lit(""), F.lit(0.0), F.lit(0.0), F.lit(0.0), multiplier))]
    return _findings(df, ids, found, limits)


def _iqr_record(name: Column, value: Column, low: Column, high: Column, multiplier: float) -> Column:
    distance = F.least(F.abs(value - low), F.abs(value - high))
    return F.struct(
        F.lit("iqr").alias("method"), name.alias("column"), value.cast("double").alias("value"),
        F.lit(float(multiplier)).alias("threshold"), distance.cast("double").alias("score"),
        low.alias("lower_bound"), high.alias("upper_bound"),
    )


def _iqr_by_group(df: DataFrame, ids: list[str], by: list[str], columns: list[str], multiplier: float,
                  limit: int) -> DataFrame:
    quartiles = quantiles(df, columns, [0.25, 0.75], by, limit=limit)
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    fences = quartiles.select(*by, "column", (q1 - multiplier * (q3 - q1)).alias("low"),
                              (q3 + multiplier * (q3 - q1)).alias("high"))
    long = cells(df, columns, [*by, *ids], "double")
    joined = null_safe_join(long, fences, [*by, "column"], "inner")
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    outside = joined.filter((value < low) | (value > high))
    record = _iqr_record(F.col("column"), value, low, high, multiplier)
    return outside.select(*by, *ids, F.inline(F.array(record)))


def top(found: DataFrame, n: int = SHOWN, by: str = "score", ascending: bool = False) -> DataFrame:
    """The ``n`` most extreme findings."""
    return found.orderBy(F.col(by).asc() if ascending else F.col(by).desc()).limit(n)


def combined(df: DataFrame, ids: list[str], z_threshold: float = Z_THRESHOLD,
             contamination: float = CONTAMINATION, multiplier: float = IQR_MULTIPLIER,
             columns: list[str] | None = None, shown: int | None = None) -> DataFrame:
    """(ids..., methods, method_count): rows that any of the three methods reports.

    All findings count. ``shown=100`` unites the cut lists of each method instead.
    """
    parts = [
        z_scores(df, ids, z_threshold, columns),
        isolation_forest(df, ids, columns, contamination).withColumns(
            {"method": F.lit("isolation_forest"), "score": F.col("anomaly_score")}),
        iqr(df, ids, multiplier, columns),
    ]
    if shown is not None:
        parts = [top(p, shown, ascending=i == 1) for i, p in enumerate(parts)]
    return unite(parts, ids)


def unite(parts: list[DataFrame], ids: list[str]) -> DataFrame:
    """Union of findings, one row per id with the methods that found it."""
    keys = [quoted(i) for i in ids]
    marked = [p.select(*keys, "method").distinct() for p in parts]
    return (
        reduce(DataFrame.unionByName, marked)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("method")).alias("methods"))
        .withColumn("method_count", F.size("methods").cast("long"))
    )


def spikes(df: DataFrame, date: str, value: str, threshold: float = SPIKE_THRESHOLD,
           by: list[str] | None = None, ties: list[str] | None = None,
           rows: int = ROLLING_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Values far from the mean of the last seven rows, the row itself included.

    With the row in its own window, |z| cannot exceed (7-1)/sqrt(7) = 2.27. Rows without a
    date come last. ``ties`` decide between rows of one date.
    """
    by, ties = list(by or []), list(ties or [])
    x = F.col("__x")
    shown = {c.lower() for c in [*by, *ties]}  # a large series is written, so all other columns are left behind
    base = df.select(*[quoted(c) for c in df.columns if c.lower() in shown], quoted(value).cast("double").alias("__x"),
                     as_time(df, date).isNull().alias("__undated"), as_time(df, date).alias("__at"))
    order = ["__undated", "__at", *ties]
    series = ordered(base, by, order, before=rows - 1, group_rows=group_rows)
    frame = series.window.rowsBetween(-(rows - 1), 0)
    z = F.try_divide(x - F.col("moving_average"), F.col("__std"))
    seen = series.finish(series.df.withColumns({
        "moving_average": F.avg("__x").over(frame), "__std": F.stddev_samp("__x").over(frame),
    }))
    return seen.withColumn("z_score", z).filter(F.abs("z_score") > threshold).select(
        *[quoted(b) for b in by], *[quoted(t) for t in ties], F.col("__at").alias("date"), x.alias("amount"),
        "moving_average", "z_score", F.when(F.col("z_score") > 0, "spike").otherwise("dip").alias("spike_type"),
    )


def detect(df: DataFrame, ids: list[str], method: str = "combined", **options) -> DataFrame:
    """Dispatch by method name."""
    ways = {"z_score": z_scores, "zscore": z_scores, "iqr": iqr, "combined": combined}
    if method == "isolation_forest":
        return isolation_forest(df, ids, **options)
    if method in ("spikes", "sales_spikes"):
        if not options.get("date") or not options.get("value"):
            raise ValueError("spikes need a date and a value column")
        return spikes(df, ties=ids, **options)
    if method not in ways:
        raise ValueError(f"unknown method {method!r}")
    return ways[method](df, ids, **options)


def records(found: DataFrame, ids: list[str]) -> DataFrame:
    """The common record of all methods: (ids..., column, anomaly_type, method, value, threshold, score)."""
    def column(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in found.columns else F.lit(None).cast(kind)

    if "spike_type" in found.columns:
        kind, method, value, score = "spike_type", F.lit("rolling"), "amount", "z_score"
    elif "anomaly_score" in found.columns:
        kind, method, value, score = "", F.lit("isolation_forest"), "value", "anomaly_score"
    else:
        kind, method, value, score = "", F.col("method"), "value", "score"
    return found.select(
        *[quoted(i) for i in ids], column("column", "string").alias("column"),
        F.coalesce(column(kind, "string"), F.lit("outlier")).alias("anomaly_type"), method.alias("method"),
        column(value, "double").alias("value"), column("threshold", "double").alias("threshold"),
        column(score, "double").alias("score"),
    )
