"""Key figures of a dataset and the assembled KPI record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelark.functions import roles
from sievelark.functions.predicates import to_number
from sievelark.functions.statistics import percent
from sievelark.operators import sales
from sievelark.operators.explore import as_time
from sievelark.plans.longform import quoted
from sievelark.plans.shared import write_shared


def kpis(df: DataFrame, date: str | None = None, amount: str | None = None,
         quantity: str | None = None) -> DataFrame:
    """One row: totals, averages, date range, whole days covered, mean of the monthly sums.

    Columns not given are found by name. Everything comes from one aggregate per month and
    one over the months; rows without a date count in the totals, not in the monthly mean.
    """
    date = date or roles.first_date_like(df, roles.DATE_KPI_PARTS)
    amount = amount or roles.first_number_like(df, roles.AMOUNT_KPI_PARTS)
    quantity = quantity or roles.first_number_like(df, roles.QUANTITY_KPI_PARTS)
    when = as_time(df, date).cast("timestamp_ntz") if date else F.lit(None).cast("timestamp_ntz")

    def number(name: str | None) -> Column:
        if name is None or name not in [*roles.numeric_columns(df), *roles.string_columns(df)]:
            return F.lit(None).cast("double")
        return to_number(quoted(name))

    base = df.select(when.alias("at"), number(amount).alias("x"), number(quantity).alias("q"))
    months = base.groupBy(F.trunc("at", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum"), F.count("x").alias("x_n"),
        F.max("x").alias("x_max"), F.min("x").alias("x_min"), F.sum("q").alias("q_sum"),
        F.count("q").alias("q_n"), F.min("at").alias("first"), F.max("at").alias("last"),
    )
    figures = [
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
    ]
    if amount:
        figures += [
            F.coalesce(F.sum("x_sum"), F.lit(0.0)).alias("total_revenue"),
            F.try_divide(F.sum("x_sum"), F.sum("x_n")).alias("average_transaction_value"),
            F.max("x_max").alias("max_transaction"), F.min("x_min").alias("min_transaction"),
        ]
    if date:
        figures += [
            F.to_date(F.min("first")).alias("date_range_start"), F.to_date(F.max("last")).alias("date_range_end"),
            F.timestamp_diff("DAY", F.min("first"), F.max("last")).cast("long").alias("days_covered"),
        ]
        if amount:
            monthly = F.when(F.col("month").isNotNull(), F.coalesce(F.col("x_sum"), F.lit(0.0)))
            figures.append(F.avg(monthly).alias("monthly_average_revenue"))
    if quantity:
        figures += [
            F.coalesce(F.sum("q_sum"), F.lit(0.0)).alias("total_quantity"),
            F.try_divide(F.sum("q_sum"), F.sum("q_n")).alias("average_quantity"),
        ]
    return months.agg(*figures)


_READ = ["customer_id", "product_id", "category", "region", "amount", "cost", "quantity", "transaction_date"]


def kpi_record(t: DataFrame, store: bool = False) -> DataFrame:
    """One row with the figures of the KPI table, over a ``transactions`` frame.

    Retention, new customers and growth are those of the newest month that has them. Each
    figure is a small aggregate; they are stacked as (name, value) and turned into one row,
    so nothing is joined without a key. Region and category sales are maps. ``store=True``
    writes the columns it reads to the shared folder first: worth it when ``t`` is a join,
    because the figures scan their input some nine times.
    """
    if store:
        t = write_shared(t.select(*_READ), "kpi-input")
    amount, cost = sales.amount(), sales.cost()

    def newest(frame: DataFrame, order: str, value: str, name: str) -> DataFrame:
        return frame.filter(F.col(value).isNotNull()).agg(F.max_by(value, order).cast("double").alias(name))

    known = t.filter(F.col("amount").isNotNull())
    yearly = sales.year_over_year_growth(t).withColumn("at", F.col("current_year") * 100 + F.col("month"))
    parts = [
        known.agg(
            F.sum(amount).alias("total_revenue"), F.count(F.lit(1)).cast("double").alias("total_sales"),
            F.avg(amount).alias("average_order_value"),
            F.sum(F.when(cost.isNotNull(), amount - cost)).alias("total_profit"),
            percent(F.sum(F.when(cost.isNotNull(), amount - cost)),
                    F.sum(F.when(cost.isNotNull(), amount))).alias("profit_margin"),
            F.try_divide(F.sum(sales.quantity()), F.count_distinct("product_id")).alias("inventory_turnover"),
        ),
        newest(sales.customer_retention(t), "current_month", "retention_rate", "customer_retention_rate"),
        sales.repeat_customers(t).agg(F.count(F.lit(1)).cast("double").alias("repeat_customers")),
        newest(sales.customer_churn_analysis(t), "current_month", "new_customers", "new_customers"),
        sales.customer_lifetime_value(t).agg(F.avg("lifetime_value").alias("customer_lifetime_value")),
        newest(sales.month_over_month_growth(t), "month", "growth_rate_pct", "month_over_month_growth"),
        newest(yearly, "at", "yoy_growth_rate", "year_over_year_growth"),
    ]
    figures = [
        p.unpivot([], p.columns, "name", "value").withColumn("key", F.lit(None).cast("string")) for p in parts
    ]
    listed = [
        report(t).select(F.lit(f"sales_by_{by}").alias("name"), F.col("total_sales").alias("value"),
                         F.col(by).alias("key"))
        for report, by in ((sales.sales_by_region, "region"), (sales.sales_by_category, "category"))
    ]
    stacked = reduce(DataFrame.unionByName, [*figures, *listed])

    def called(name: str, value: Column) -> Column:
        return F.when(F.col("name") == name, value)

    def as_map(name: str) -> Column:
        entries = F.collect_list(called(name, F.struct("key", "value")))  # one per region or category
        return F.map_from_entries(entries).alias(name)

    names = [c for p in parts for c in p.columns]
    return stacked.agg(
        *[F.max(called(n, F.col("value"))).alias(n) for n in names],
        F.max(called("month_over_month_growth", F.col("value"))).alias("growth_rate"),
        as_map("sales_by_region"), as_map("sales_by_category"),
    )


def portfolio(datasets: DataFrame) -> DataFrame:
    """One row over the dataset registry; datasets without a score count as 0 in the mean."""
    scored = F.col("quality_score")
    return datasets.agg(
        F.count(F.lit(1)).alias("datasets"), F.count(scored).alias("validated"),
        F.avg(F.coalesce(scored, F.lit(0.0))).alias("average_quality"),
    )
