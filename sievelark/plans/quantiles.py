"""Exact quantiles without holding a whole column in one task.

Small frames use the built-in ``percentile``. It keeps every distinct value in one task,
so beyond ``QUANTILE_ROWS`` the wanted ranks are searched: each pass counts the values of
the current bracket in bins and goes on with the bin that holds the rank. Bins are counted
exactly and combined before the shuffle, so a pass moves a few thousand rows per task and
the result is exact. Values that come from joins or groups are written once for all passes. When few values are left in the bracket they are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelark.plans.joins import null_safe_join
from sievelark.plans.longform import cells, quoted
from sievelark.plans.shared import stored, write_shared

QUANTILE_ROWS = 1_000_000
"""Most rows per group for the built-in aggregate."""

RANKED_ROWS = 200_000
"""Most values left in a bracket when they are ranked one by one."""

_BINS = 4096
_ACCURACY = 10_000


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
              by: list[str] | None = None, approx: bool = False,
              limit: int = QUANTILE_ROWS, rows: int | None = None) -> DataFrame:
    """(by..., column, quantiles): one array per column and group, linear interpolation.

    ``rows`` is the largest group size if the caller knows it; else it is counted.
    """
    by = list(by or [])
    if not approx and rows is None:
        rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if approx or rows <= limit:
        pick = _approximate if approx else _built_in
        wide = df.groupBy(*by).agg(*[pick(c, probabilities).alias(c) for c in columns])
        return wide.unpivot(
            [F.col(b) for b in by], [quoted(c) for c in columns], "column", "quantiles"
        ).filter(F.col("quantiles").isNotNull())
    wanted = df.select(*[F.col(b) for b in by], *[quoted(c).cast("double").alias(c) for c in columns if c not in by])
    return _searched(cells(stored(wanted, "quantile-values"), columns, by, "double"), [*by, "column"], probabilities, limit)


def collect_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                      **options) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as a dict; its size is the number of columns."""
    found = {r["column"]: list(r["quantiles"]) for r in quantiles(df, columns, probabilities, **options).collect()}
    return {c: found.get(c, [None] * len(probabilities)) for c in columns}


def _built_in(column: str, probabilities: list[float]) -> Column:
    return F.percentile(quoted(column).cast("double"), F.array(*[F.lit(p) for p in probabilities]))


def _approximate(column: str, probabilities: list[float]) -> Column:
    return F.percentile_approx(quoted(column).cast("double"), probabilities, _ACCURACY)


def _searched(long: DataFrame, keys: list[str], probabilities: list[float], limit: int) -> DataFrame:
    """Rank search for all groups and probabilities at once.

    ``targets`` has one row per group and wanted 0-based rank: the bracket [``least``,
    ``most``] that holds it, the number of values ``below`` and ``inside`` the bracket.
    """
    few = min(limit, RANKED_ROWS)
    spread = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    position = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in position])))
    targets = write_shared(
        spread.withColumn("rank", F.explode(ranks)).withColumns({
            "below": F.lit(0).cast("long"), "inside": F.col("n"), "curved": F.lit(False),
        }), "quantile-targets")
    is_open = (F.col("inside") > few) & (F.col("least") < F.col("most"))
    while not targets.filter(is_open).isEmpty():  # a pass puts the ends of a bracket into different bins, so it ends
        targets = write_shared(_narrowed(long, targets, keys, is_open), "quantile-targets")

    found = _ranked(long, targets, keys)
    at = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    sizes = targets.groupBy(*keys).agg(F.first("n").alias("n"))
    values = null_safe_join(found.groupBy(*keys).agg(at.alias("at")), sizes, keys, "inner")
    picked = []
    for p in probabilities:
        x = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        x0, x1 = F.element_at("at", low), F.element_at("at", high)
        picked.append(x0 + (x1 - x0) * (x - low))
    return values.select(*keys, F.array(*picked).alias("quantiles"))


def _in_brackets(long: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    return null_safe_join(long, brackets, keys, "inner").filter(
        F.col("value").between(F.col("least"), F.col("most")))


def _narrowed(long: DataFrame, targets: DataFrame, keys: list[str], is_open: Column) -> DataFrame:
    """One pass: count the open brackets in bins, keep the bin of each rank.

    A bin is known by its own smallest and largest value, and bins grow with the value, so
    what lies between these two is what was counted. When equal widths did not halve the
    bracket (a few huge values), the next pass spaces the bins by logarithm.
    """
    value = F.col("value")
    bracket = [*keys, "least", "most", "curved"]
    brackets = targets.filter(is_open).select(*bracket).distinct()

    def curve(c: Column) -> Column:
        return F.signum(c) * F.log1p(F.abs(c))

    def share(c: Column, low: Column, high: Column) -> Column:
        return F.coalesce(F.try_divide(c / 4 - low / 4, high / 4 - low / 4), F.lit(0.0))  # no overflow

    least, most = F.col("least"), F.col("most")
    part = F.when(F.col("curved"), share(curve(value), curve(least), curve(most))).otherwise(
        share(value, least, most))
    bins = (
        _in_brackets(long, brackets, keys)
        .groupBy(*bracket, F.floor(part * _BINS).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("now_inside"), F.min("value").alias("now_least"), F.max("value").alias("now_most"))
    )
    upto = Window.partitionBy(*bracket).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("end", F.sum("now_inside").over(upto)).drop("bin")
    wanted = F.col("rank") - F.col("below")
    joined = null_safe_join(targets.filter(is_open), bins, bracket, "inner").filter(
        (wanted < F.col("end")) & (wanted >= F.col("end") - F.col("now_inside")))
    found = joined.select(
        *keys, "n", F.col("now_least").alias("least"), F.col("now_most").alias("most"), "rank",
        (F.col("below") + F.col("end") - F.col("now_inside")).alias("below"), F.col("now_inside").alias("inside"),
        (~F.col("curved") & (F.col("now_inside") * 2 > F.col("inside"))).alias("curved"),
    )
    return targets.filter(~is_open).unionByName(found)


def _ranked(long: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rank, value): equal values are counted first, then numbered in order."""
    bracket = [*keys, "least", "most"]
    known = targets.filter(F.col("least") == F.col("most")).select(*keys, "rank", F.col("least").alias("value"))
    left = targets.filter(F.col("least") < F.col("most"))
    counted = _in_brackets(long, left.select(*bracket).distinct(), keys).groupBy(*bracket, "value").agg(
        F.count(F.lit(1)).alias("copies"))
    upto = Window.partitionBy(*bracket).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.withColumn("end", F.sum("copies").over(upto))
    wanted = F.col("rank") - F.col("below")
    found = null_safe_join(left, numbered, bracket, "inner").filter(
        (wanted < F.col("end")) & (wanted >= F.col("end") - F.col("copies")))
    return known.unionByName(found.select(*keys, "rank", "value"))
