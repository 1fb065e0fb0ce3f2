"""Reports by name, and read-only SQL over the registered views."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelark.operators import sales

@dataclass(frozen=True)
class Report:
    name: str
    topic: str
    about: str
    build: Callable[[DataFrame], DataFrame]

    def sorted(self, result: DataFrame) -> DataFrame:
        """In the order the report is read in; small reports come sorted already."""
        order = _ORDER.get(self.name, "").split()
        return result.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]) if order else result


# Order of the reports with a row per customer, product or sale; a minus is descending.
_ORDER = {
    "customer_segmentation": "-total_spent",
    "repeat_customers": "-purchase_count",
    "customer_lifetime_value": "-lifetime_value",
    "sales_rank_by_customer": "customer_id -transaction_date",
    "lag_lead_analysis": "customer_id transaction_date",
    "inventory_turnover": "-total_quantity_sold",
    "customer_product_affinity": "customer_id category_rank",
}


def _reports() -> dict[str, Report]:
    listed = [
        ("totals", "sum of amount over all transactions", sales.total_revenue),
        ("totals", "mean amount", sales.average_transaction_value),
        ("totals", "number of transactions and distinct customers", sales.transaction_count),
        ("customers", "spend per customer with its segment", sales.customer_segmentation),
        ("customers", "customers with more than one purchase", sales.repeat_customers),
        ("customers", "customers kept from month to month", sales.customer_retention),
        ("customers", "lifetime value and value per day", sales.customer_lifetime_value),
        ("sales", "sales by region", sales.sales_by_region),
        ("sales", "sales by category with share of all sales", sales.sales_by_category),
        ("sales", "products with most revenue", sales.top_products),
        ("sales", "customers with most spend", sales.top_customers),
        ("time", "sales per month", sales.monthly_sales_trend),
        ("time", "growth against the month before", sales.month_over_month_growth),
        ("time", "growth against the same month a year before", sales.year_over_year_growth),
        ("time", "sales per day", sales.daily_sales_summary),
        ("window", "running total and rolling sum, newest rows", sales.running_total_sales),
        ("window", "purchase order, amount rank and quartile per customer", sales.sales_rank_by_customer),
        ("window", "percentiles of amount by category", sales.percentile_sales),
        ("window", "previous and next purchase per customer (lag, lead)", sales.lag_lead_analysis),
        ("distribution", "transactions by size of amount", sales.revenue_distribution),
        ("distribution", "customers by number of transactions", sales.transaction_frequency),
        ("cohort", "customers by first month and months since", sales.cohort_analysis),
        ("cohort", "new and returning customers per month (churn)", sales.customer_churn_analysis),
        ("profit", "revenue, cost, profit and margin by category", sales.profit_analysis),
        ("profit", "revenue, cost, profit and margin by region", sales.profit_by_region),
        ("stock", "quantity sold and price per unit by product", sales.inventory_turnover),
        ("customers", "categories a customer buys most", sales.customer_product_affinity),
        ("view", "view v_customer_summary: one row per customer", sales.create_view_customer_summary),
        ("view", "view v_monthly_kpis: one row per month", sales.create_view_monthly_kpis),
    ]
    return {f.__name__: Report(f.__name__, topic, about, f) for topic, about, f in listed}


REPORTS = _reports()


def names() -> list[str]:
    return list(REPORTS)


def describe(name: str) -> str:
    """What a report computes, or an empty string for an unknown name."""
    return REPORTS[name].about if name in REPORTS else ""


def text(name: str) -> str:
    """The definition of a report as it is written, or an empty string for an unknown name."""
    return inspect.getsource(REPORTS[name].build) if name in REPORTS else ""


def search(wanted: str, in_text: bool = False) -> dict[str, str]:
    """Reports whose name, topic, description or (``in_text``) definition contains ``wanted``, ignoring case."""
    return {
        r.name: r.about for r in REPORTS.values()
        if wanted.lower() in f"{r.name} {r.topic} {r.about} {text(r.name) if in_text else ''}".lower()
    }


def listing(spark: SparkSession) -> DataFrame:
    """(name, topic, about, text) of all reports."""
    rows = [(r.name, r.topic, r.about, text(r.name)) for r in REPORTS.values()]
    return spark.createDataFrame(rows, "name string, topic string, about string, text string")


def run(spark: SparkSession, name: str, limit: int | None = None, table: str = "transactions",
        in_order: bool = True) -> DataFrame:
    """A report over the view ``table``; ``limit`` cuts what is shown, not what is read.

    With a limit the order is a top-k sort. Without one, ``in_order=False`` spares the total
    sort of the reports that have a row per customer or sale.
    """
    if name not in REPORTS:
        raise KeyError(f"no report named {name!r}")
    result = REPORTS[name].build(spark.table(table))
    if in_order:
        result = REPORTS[name].sorted(result)
    return result if limit is None else result.limit(limit)


def _as_query(spark: SparkSession, query: str, args: dict | None) -> DataFrame:
    """Only a query can stand in FROM (...); commands fail to parse there."""
    body = query.strip().rstrip(";")
    return spark.sql(f"SELECT * FROM (\n{body}\n)", args=args or None)


def run_sql(spark: SparkSession, query: str, args: dict | None = None,
            limit: int | None = None) -> DataFrame:
    """A read-only query over the registered views with named parameters; all rows unless ``limit`` cuts them."""
    result = _as_query(spark, query, args)
    return result if limit is None else result.limit(limit)


def sql_total(spark: SparkSession, query: str, args: dict | None = None) -> DataFrame:
    """Number of rows of the whole result, to show next to a cut one."""
    return _as_query(spark, query, args).agg(F.count(F.lit(1)).alias("total_rows"))
