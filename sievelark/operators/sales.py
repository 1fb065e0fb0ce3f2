"""The library of named reports over a ``transactions`` frame.

Columns read: customer_id, customer_name, product_id, product_name, category, region,
amount, cost, quantity, transaction_date. Numbers may be stored as text; they are read
with a cast that gives NULL on failure. Each report is a function of the frame, so that
Catalyst prunes the columns it does not need. Results come sorted as a report would show
them where the result is small; per-customer results are left unsorted unless asked,
because a total sort of them is one more shuffle of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelark.functions.predicates import to_number
from sievelark.functions.statistics import percent
from sievelark.plans.ordered import BLOCK, BROADCAST_ROWS, GROUP_ROWS, POSITION, ordered, running_sum
from sievelark.plans.quantiles import QUANTILE_ROWS, quantiles
from sievelark.plans.shared import stored, write_shared

# Limits of the customer, revenue and frequency classes.
SEGMENTS = ((5000, "Premium"), (1000, "Gold"), (100, "Silver"))
LOWEST_SEGMENT = "Bronze"
REVENUE_BUCKETS = ((50, "Under $50"), (100, "$50-$100"), (500, "$100-$500"), (1000, "$500-$1000"))
TOP_BUCKET = "Over $1000"
FREQUENCIES = ((1, "One-Time"), (5, "Occasional"), (20, "Regular"))
TOP_FREQUENCY = "Frequent"
TOP_ROWS = 20
NEWEST_ROWS = 1000
ROLLING_ROWS = 30


def amount() -> Column:
    return to_number(F.col("amount"))


def cost() -> Column:
    return to_number(F.col("cost"))


def quantity() -> Column:
    return to_number(F.col("quantity"))


def sold_at() -> Column:
    return F.col("transaction_date")


def month_of(c: Column) -> Column:
    return F.trunc(c, "month")


def calendar_days(start: Column, end: Column) -> Column:
    """Calendar-day boundaries between two instants (23:00 to 01:00 is one day)."""
    return F.date_diff(F.to_date(end), F.to_date(start)).cast("long")


def _known(t: DataFrame, *columns: str) -> DataFrame:
    return t.dropna(subset=list(columns))


def _count() -> Column:
    return F.count(F.lit(1))


# --- totals -------------------------------------------------------------------------


def total_revenue(t: DataFrame) -> DataFrame:
    return _known(t, "amount").agg(F.sum(amount()).alias("total_revenue"))


def average_transaction_value(t: DataFrame) -> DataFrame:
    return _known(t, "amount").agg(F.avg(amount()).alias("avg_value"))


def transaction_count(t: DataFrame) -> DataFrame:
    return t.agg(
        _count().alias("total_transactions"), F.count_distinct("customer_id").alias("unique_customers")
    )


# --- customers ----------------------------------------------------------------------


def customer_segmentation(t: DataFrame) -> DataFrame:
    spent = F.col("total_spent")
    segment = F.when(spent >= SEGMENTS[0][0], SEGMENTS[0][1])
    for least, name in SEGMENTS[1:]:
        segment = segment.when(spent >= least, name)
    return (
        _known(t, "customer_id", "amount")
        .groupBy("customer_id")
        .agg(_count().alias("transaction_count"), F.sum(amount()).alias("total_spent"),
             F.avg(amount()).alias("avg_transaction"),
             calendar_days(F.min(sold_at()), F.max(sold_at())).alias("days_as_customer"))
        .withColumn("segment", segment.otherwise(LOWEST_SEGMENT))
    )


def repeat_customers(t: DataFrame) -> DataFrame:
    """Two steps: first per customer and day, which the distinct day count needs anyway."""
    per_day = _known(t, "customer_id").groupBy("customer_id", F.to_date(sold_at()).alias("day")).agg(
        _count().alias("n"), F.min(sold_at()).alias("first"), F.max(sold_at()).alias("last")
    )
    return (
        per_day.groupBy("customer_id")
        .agg(F.sum("n").alias("purchase_count"), F.count("day").alias("purchase_days"),
             F.min("first").alias("first_purchase"), F.max("last").alias("last_purchase"))
        .filter(F.col("purchase_count") > 1)
    )


def active_months(t: DataFrame) -> DataFrame:
    """Distinct (month, customer): at most one row per customer and month."""
    return t.select(month_of(sold_at()).alias("month"), "customer_id").distinct()


def customer_retention(t: DataFrame) -> DataFrame:
    """Customers of each month that also bought in the month before, and their share of it.

    Customers who did not buy in the month before are the rows with a NULL previous month.
    The join runs on the distinct pairs, so a busy customer costs one row per month.
    """
    pairs = active_months(t)
    active = pairs.groupBy("month").agg(F.count("customer_id").alias("active_customers"))
    current = pairs.select(F.col("month").alias("current_month"), "customer_id")
    before = pairs.select(F.col("month").alias("previous_month"), F.col("customer_id").alias("before_id"))
    joined = current.join(
        before,
        (F.col("customer_id") == F.col("before_id"))
        & (F.add_months("previous_month", 1) == F.col("current_month")),
        "left",
    )
    retained = joined.groupBy("current_month", "previous_month").agg(
        F.count("customer_id").alias("retained_customers")
    )
    return retained.join(active, F.col("previous_month") == F.col("month"), "left").select(
        "current_month", "previous_month", "retained_customers",
        F.round(percent(F.col("retained_customers"), F.col("active_customers")), 2).alias("retention_rate"),
    )


def customer_lifetime_value(t: DataFrame) -> DataFrame:
    days = F.col("customer_lifetime_days")
    return (
        _known(t, "customer_id", "amount")
        .groupBy("customer_id")
        .agg(F.sum(amount()).alias("lifetime_value"), _count().alias("total_purchases"),
             F.avg(amount()).alias("avg_purchase"),
             calendar_days(F.min(sold_at()), F.max(sold_at())).alias("customer_lifetime_days"))
        .withColumn("daily_value", F.round(F.try_divide("lifetime_value", days), 2))
    )


# --- sales --------------------------------------------------------------------------


def sales_by_region(t: DataFrame) -> DataFrame:
    return (
        _known(t, "region", "amount")
        .groupBy("region")
        .agg(_count().alias("transaction_count"), F.sum(amount()).alias("total_sales"),
             F.avg(amount()).alias("avg_sale"), F.min(amount()).alias("min_sale"),
             F.max(amount()).alias("max_sale"))
        .orderBy(F.desc("total_sales"))
    )


def sales_by_category(t: DataFrame) -> DataFrame:
    """The share is of all sales, also those without a category.

    All groups come from one aggregate, the NULL category included; the grand total is the
    sum over that small result.
    """
    groups = t.groupBy("category").agg(
        F.count("amount").alias("transaction_count"), F.sum(amount()).alias("total_sales"),
        F.avg(amount()).alias("avg_sale"),
    )
    return (
        groups.withColumn("all_sales", groups.agg(F.sum("total_sales")).scalar())
        .filter(F.col("category").isNotNull() & (F.col("transaction_count") > 0))
        .withColumn("percent_of_total", F.round(percent(F.col("total_sales"), F.col("all_sales")), 2))
        .drop("all_sales")
        .orderBy(F.desc("total_sales"))
    )


def _ranked_head(totals: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The top ``n`` by a top-k sort, then numbered: the window sees ``n`` rows only."""
    head = totals.orderBy(F.desc(by), F.asc(tie)).limit(n)
    order = Window.orderBy(F.desc(by), F.asc(tie))
    return head.withColumn("rank", F.row_number().over(order).cast("long"))


def top_products(t: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    totals = _known(t, "product_id", "amount").groupBy("product_id", "product_name").agg(
        _count().alias("times_sold"), F.sum(amount()).alias("total_revenue"), F.avg(amount()).alias("avg_price")
    )
    return _ranked_head(totals, "total_revenue", "product_id", n)


def top_customers(t: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    totals = _known(t, "customer_id", "amount").groupBy("customer_id", "customer_name").agg(
        _count().alias("purchase_count"), F.sum(amount()).alias("total_spent")
    )
    return _ranked_head(totals, "total_spent", "customer_id", n)


# --- time ---------------------------------------------------------------------------


def monthly_sales_trend(t: DataFrame) -> DataFrame:
    return (
        _known(t, "transaction_date", "amount")
        .groupBy(month_of(sold_at()).alias("month"))
        .agg(_count().alias("transaction_count"), F.sum(amount()).alias("total_sales"),
             F.avg(amount()).alias("avg_transaction"), F.min(amount()).alias("min_transaction"),
             F.max(amount()).alias("max_transaction"))
        .orderBy(F.desc("month"))
    )


def _growth(now: Column, before: Column) -> Column:
    return F.round(F.try_divide(now - before, before) * 100, 2)


def month_over_month_growth(t: DataFrame) -> DataFrame:
    """Growth against the calendar month before; NULL after a month without sales.

    The months are few, so the previous one comes from ``lag`` and a check that it is
    adjacent instead of a second aggregate and a join.
    """
    months = _known(t, "transaction_date", "amount").groupBy(month_of(sold_at()).alias("month")).agg(
        F.sum(amount()).alias("total_sales")
    )
    order = Window.orderBy("month")
    adjacent = F.add_months(F.lag("month").over(order), 1) == F.col("month")
    return (
        months.withColumn("previous_month_sales", F.when(adjacent, F.lag("total_sales").over(order)))
        .withColumn("growth_rate_pct", _growth(F.col("total_sales"), F.col("previous_month_sales")))
        .orderBy(F.desc("month"))
    )


def year_over_year_growth(t: DataFrame) -> DataFrame:
    months = _known(t, "transaction_date", "amount").groupBy(
        F.year(sold_at()).cast("long").alias("current_year"), F.month(sold_at()).cast("long").alias("month")
    ).agg(F.sum(amount()).alias("current_year_sales"))
    order = Window.partitionBy("month").orderBy("current_year")
    adjacent = F.lag("current_year").over(order) + 1 == F.col("current_year")
    return (
        months.withColumn("previous_year_sales", F.when(adjacent, F.lag("current_year_sales").over(order)))
        .withColumn("yoy_growth_rate", _growth(F.col("current_year_sales"), F.col("previous_year_sales")))
        .orderBy(F.desc("current_year"), "month")
    )


def daily_sales_summary(t: DataFrame) -> DataFrame:
    """First per day and customer, so that the distinct count needs no second shuffle."""
    per_customer = _known(t, "transaction_date", "amount").groupBy(
        F.to_date(sold_at()).alias("sale_date"), "customer_id"
    ).agg(_count().alias("n"), F.count(amount()).alias("numbers"), F.sum(amount()).alias("s"), F.max(amount()).alias("m"))
    return (
        per_customer.groupBy("sale_date")
        .agg(F.sum("n").alias("transaction_count"), F.count("customer_id").alias("unique_customers"),
             F.sum("s").alias("total_sales"),
             F.try_divide(F.sum("s"), F.sum("numbers")).alias("avg_transaction"),
             F.max("m").alias("max_transaction"))
        .orderBy(F.desc("sale_date"))
    )


# --- windows ------------------------------------------------------------------------

_TIES = ["transaction_date", "customer_id", "product_id", "amount", "quantity", "cost"]


def running_total_sales(t: DataFrame, limit: int | None = NEWEST_ROWS,
                        group_rows: int = GROUP_ROWS) -> DataFrame:
    """Running total per date (rows of one date share it) and the sum of the last 31 rows.

    The report shows the newest rows only. They come from a top-k sort; what lies before
    them is one sum. So neither the running total nor the rolling sum needs all rows in
    order. ``limit=None`` gives all rows over the split window.
    """
    known = stored(_known(t, "amount").select(*_TIES), "sales").withColumn("value", amount())  # read three times
    if limit is None:
        return _running_total_of_all(known, group_rows)
    order = [F.desc(c) for c in _TIES]
    newest = known.orderBy(*order).limit(limit + ROLLING_ROWS)
    oldest = newest.agg(F.min(sold_at()).alias("d")).first()
    # NULL dates sort first in the running order, so they are part of every later total.
    recent = F.lit(False) if oldest["d"] is None else sold_at() >= F.lit(oldest["d"])
    day = F.when(recent, sold_at())
    per_date = known.groupBy(day.alias("day")).agg(F.sum("value").alias("s"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # at most limit + 31 rows
    totals = per_date.select("day", F.sum("s").over(upto).alias("running_total"))
    position = Window.orderBy(*order)
    back = Window.orderBy(*[F.asc(c) for c in _TIES]).rowsBetween(-ROLLING_ROWS, 0)
    rows = newest.select(
        "transaction_date", "amount", F.sum("value").over(back).alias("rolling_30day_total"),
        F.row_number().over(position).alias("place"),
    ).filter(F.col("place") <= limit)
    return rows.join(totals, F.col("transaction_date").eqNullSafe(F.col("day")), "left").orderBy("place").select(
        "transaction_date", "amount", "running_total", "rolling_30day_total"
    )


def _running_total_of_all(known: DataFrame, group_rows: int) -> DataFrame:
    per_date = known.groupBy(sold_at().alias("day")).agg(F.sum("value").alias("s"))
    totals = running_sum(per_date, "s", "running_total", [], ["day"], unique=True, group_rows=group_rows)
    rows = ordered(known.drop("value"), [], _TIES, before=ROLLING_ROWS, group_rows=group_rows)
    rolling = rows.finish(rows.df.withColumn(
        "rolling_30day_total", F.sum(amount()).over(rows.window.rowsBetween(-ROLLING_ROWS, 0))
    ))
    totals = write_shared(totals, "totals")  # its exact size lets the planner broadcast it if it is small
    return rolling.join(totals, F.col("transaction_date").eqNullSafe(F.col("day")), "left").select(
        "transaction_date", "amount", "running_total", "rolling_30day_total"
    )


def sales_rank_by_customer(t: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per customer: order of purchase from the newest, rank by amount, quartile by amount.

    Both orders end in the other columns as tie-breaks. A customer too large for one task
    gets positions from a range shuffle; rank and quartile follow from the position, the
    number of rows and the best position among equal amounts.
    """
    known = stored(_known(t, "customer_id", "amount").select(*_TIES), "sales").select(*_TIES, amount().alias("value"))
    by_date = ["transaction_date", "value", "product_id", "quantity", "cost"]
    by_value = ["value", "transaction_date", "product_id", "quantity", "cost"]
    shown = ["customer_id", "transaction_date", "amount", "purchase_sequence", "amount_rank", "quartile"]
    first = ordered(known, ["customer_id"], by_date, descending=True, group_rows=group_rows)
    numbered = first.finish(first.df.withColumn("purchase_sequence", first.row_number()))
    customer = Window.partitionBy("customer_id")
    if not first.split:
        return numbered.withColumns({
            "amount_rank": F.rank().over(customer.orderBy(F.desc("value"))).cast("long"),
            "quartile": F.ntile(4).over(customer.orderBy(*by_value)).cast("long"),
        }).select(*shown)
    numbered = write_shared(numbered, "numbered")  # read by the size check and by the split
    second = ordered(numbered, ["customer_id"], by_value, group_rows=group_rows)
    if not second.split:
        return second.df.withColumns({
            "amount_rank": F.rank().over(customer.orderBy(F.desc("value"))).cast("long"),
            "quartile": F.ntile(4).over(customer.orderBy(*by_value)).cast("long"),
        }).select(*shown)
    block = Window.partitionBy("customer_id", BLOCK)
    placed = second.df.withColumns({"place": second.row_number(), "rows_here": _count().over(block)}).withColumn(
        "last_here", F.max("place").over(Window.partitionBy("customer_id", BLOCK, "value")))
    # Equal amounts go on in another block only at the edges of one, so a row a block tells where they end,
    # and the largest place is the size of a split customer.
    edges = placed.filter(F.col(POSITION).isNotNull()).groupBy("customer_id", BLOCK).agg(
        F.min(F.struct("value", "last_here")).alias("low"), F.max(F.struct("value", "last_here")).alias("high"))
    edges = write_shared(edges.select("customer_id", F.explode(F.array("low", "high")).alias("edge")).select("customer_id", "edge.*"), "edges")
    ends = edges.groupBy("customer_id", "value").agg(F.max("last_here").alias("last"))
    sizes = edges.groupBy("customer_id").agg(F.max("last_here").alias("size"))
    if second.blocks <= BROADCAST_ROWS:
        ends, sizes = F.broadcast(ends), F.broadcast(sizes)
    joined = placed.join(ends, ["customer_id", "value"], "left").join(sizes, "customer_id", "left")
    size = F.coalesce("size", "rows_here")
    return second.finish(joined).withColumns({
        "amount_rank": size - F.coalesce("last", "last_here") + 1,
        "quartile": _ntile(4, F.col("place"), size),
    }).select(*shown)


def _ntile(n: int, place: Column, size: Column) -> Column:
    """Tile of the 1-based ``place``: the first ``size % n`` tiles hold one row more."""
    small = F.floor(size / n).cast("long")
    larger = (size % n) * (small + 1)
    return F.when(place <= larger, F.floor((place - 1) / (small + 1)) + 1).otherwise(
        size % n + F.floor((place - larger - 1) / F.greatest(small, F.lit(1))) + 1
    ).cast("long")


def percentile_sales(t: DataFrame, approx: bool = False, limit: int = QUANTILE_ROWS) -> DataFrame:
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}
    known = stored(_known(t, "category", "amount").select("category", amount().alias("value")), "sales")
    found = quantiles(known, ["value"], list(names.values()), ["category"], approx, limit)
    return found.select("category", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(names)])


def lag_lead_analysis(t: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    known = stored(_known(t, "customer_id", "amount").select(*_TIES), "sales")
    rows = ordered(known, ["customer_id"], [c for c in _TIES if c != "customer_id"],
                   before=1, after=1, group_rows=group_rows)
    seen = rows.df.withColumns({
        "previous_amount": F.lag("amount").over(rows.window),
        "next_amount": F.lead("amount").over(rows.window),
        "next_date": F.lead("transaction_date").over(rows.window),
    })
    return (
        rows.finish(seen)
        .filter(F.col("previous_amount").isNotNull() | F.col("next_amount").isNotNull())
        .select("customer_id", "transaction_date", "amount", "previous_amount", "next_amount",
                calendar_days(sold_at(), F.col("next_date")).alias("days_to_next_purchase"),
                (amount() - to_number(F.col("previous_amount"))).alias("change_from_previous"))
    )


# --- distributions ------------------------------------------------------------------


def revenue_distribution(t: DataFrame) -> DataFrame:
    bucket = F.when(amount() < REVENUE_BUCKETS[0][0], REVENUE_BUCKETS[0][1])
    for below, name in REVENUE_BUCKETS[1:]:
        bucket = bucket.when(amount() < below, name)
    return (
        _known(t, "amount")
        .groupBy(bucket.otherwise(TOP_BUCKET).alias("revenue_bucket"))
        .agg(_count().alias("transaction_count"), F.count_distinct("customer_id").alias("unique_customers"),
             F.sum(amount()).alias("total_revenue"), F.avg(amount()).alias("avg_revenue"),
             F.min(amount()).alias("least"))
        .orderBy("least")
        .drop("least")
    )


def transaction_frequency(t: DataFrame) -> DataFrame:
    n = F.col("n")
    label = F.when(n <= FREQUENCIES[0][0], FREQUENCIES[0][1])
    for most, name in FREQUENCIES[1:]:
        label = label.when(n <= most, name)
    customers = _known(t, "customer_id").groupBy("customer_id").agg(
        _count().alias("n"), calendar_days(F.min(sold_at()), F.max(sold_at())).alias("days_active")
    )
    return customers.groupBy(label.otherwise(TOP_FREQUENCY).alias("frequency_category")).agg(
        _count().alias("customer_count"), F.round(F.avg("n"), 2).alias("avg_transactions"),
        F.round(F.avg("days_active"), 2).alias("avg_days_active"),
    )


# --- cohorts ------------------------------------------------------------------------


def cohort_analysis(t: DataFrame) -> DataFrame:
    """Customers by first month and months since; the window sees one row per month."""
    pairs = active_months(_known(t, "customer_id", "transaction_date"))
    cohort = F.min("month").over(Window.partitionBy("customer_id"))
    since = (F.year("month") - F.year("cohort_month")) * 12 + F.month("month") - F.month("cohort_month")
    return (
        pairs.withColumn("cohort_month", cohort)
        .groupBy("cohort_month", since.cast("long").alias("months_since_first"))
        .agg(_count().alias("customer_count"))
        .orderBy("cohort_month", "months_since_first")
    )


def customer_churn_analysis(t: DataFrame) -> DataFrame:
    """Active customers per month: in their first month (new) or active before (returning)."""
    pairs = active_months(_known(t, "customer_id"))
    earlier = F.lag("customer_id").over(Window.partitionBy("customer_id").orderBy("month"))
    return (
        pairs.withColumn("earlier", earlier)
        .groupBy(F.col("month").alias("current_month"))
        .agg(_count().alias("active_customers"), F.count_if(F.col("earlier").isNull()).alias("new_customers"),
             F.count("earlier").alias("returning_customers"))
        .orderBy(F.desc("current_month"))
    )


# --- profit and stock ---------------------------------------------------------------


def _profit(known: DataFrame, by: str) -> DataFrame:
    return known.groupBy(by).agg(
        _count().alias("transaction_count"), F.sum(amount()).alias("revenue"), F.sum(cost()).alias("cost"),
        F.avg(amount() - cost()).alias("avg_profit_per_transaction"),
    ).withColumn("profit", F.col("revenue") - F.col("cost")).withColumn(
        "profit_margin_pct", F.round(percent(F.col("profit"), F.col("revenue")), 2)
    )


def profit_analysis(t: DataFrame) -> DataFrame:
    return _profit(_known(t, "amount", "cost"), "category").withColumnsRenamed(
        {"revenue": "total_revenue", "cost": "total_cost", "profit": "total_profit"}
    ).orderBy(F.desc("total_profit"))


def profit_by_region(t: DataFrame) -> DataFrame:
    return _profit(_known(t, "region", "amount", "cost"), "region").drop(
        "avg_profit_per_transaction"
    ).orderBy(F.desc("profit"))


def inventory_turnover(t: DataFrame) -> DataFrame:
    sold = F.sum(quantity())
    return _known(t, "product_id", "quantity", "amount").groupBy("product_id", "product_name").agg(
        sold.alias("total_quantity_sold"), _count().alias("times_sold"),
        F.avg(quantity()).alias("avg_quantity_per_sale"),
        F.try_divide(F.sum(amount()), sold).alias("avg_price_per_unit"),
    )


def customer_product_affinity(t: DataFrame, n: int = 3) -> DataFrame:
    """Most bought categories per customer; ties by category."""
    counted = _known(t, "customer_id", "category").groupBy("customer_id", "category").agg(
        _count().alias("purchase_count"), F.sum(amount()).alias("total_spent")
    )
    order = Window.partitionBy("customer_id").orderBy(F.desc("purchase_count"), "category")
    return counted.withColumn("category_rank", F.row_number().over(order).cast("long")).filter(
        F.col("category_rank") <= n
    )


# --- views --------------------------------------------------------------------------


def create_view_customer_summary(t: DataFrame) -> DataFrame:
    """Registers ``v_customer_summary`` and returns it."""
    summary = _known(t, "customer_id", "amount").groupBy("customer_id").agg(
        _count().alias("total_purchases"), F.sum(amount()).alias("total_spent"),
        F.avg(amount()).alias("avg_purchase"), F.min(sold_at()).alias("first_purchase"),
        F.max(sold_at()).alias("last_purchase"),
        calendar_days(F.min(sold_at()), F.max(sold_at())).alias("customer_lifetime_days"),
    )
    summary.createOrReplaceTempView("v_customer_summary")
    return t.sparkSession.table("v_customer_summary")


def create_view_monthly_kpis(t: DataFrame) -> DataFrame:
    """Registers ``v_monthly_kpis`` and returns it."""
    kpis = _known(t, "transaction_date", "amount").groupBy(month_of(sold_at()).alias("month")).agg(
        _count().alias("transaction_count"), F.count_distinct("customer_id").alias("unique_customers"),
        F.sum(amount()).alias("total_revenue"), F.avg(amount()).alias("avg_transaction"),
        F.max(amount()).alias("max_transaction"),
    )
    kpis.createOrReplaceTempView("v_monthly_kpis")
    return t.sparkSession.table("v_monthly_kpis")
