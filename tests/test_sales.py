import random
from datetime import datetime, timedelta

import pytest

from sievelark.operators import catalog, sales

SCHEMA = ("customer_id int, customer_name string, product_id int, product_name string, category string, "
          "region string, amount string, cost double, quantity double, transaction_date timestamp_ntz")


@pytest.fixture(scope="module")
def t(spark):
    """Half of the rows belong to one customer, some are equal copies, some values are missing."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        c = 1 if i % 2 else rng.choice([2, 3, 4, None])
        day = datetime(2024, 1, 1) + timedelta(days=rng.randrange(400), hours=rng.randrange(24))
        amount = None if rng.random() < 0.05 else str(rng.choice([5, 60, 250, 700, 2000, 2000]) + rng.randrange(3))
        rows.append((c, f"c{c}", i % 7, f"p{i % 7}", rng.choice(["x", "y", None]), rng.choice(["N", "S"]),
                     amount, float(rng.randrange(100)), float(rng.randrange(1, 5)), day))
    rows += rows[:60] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def bag(df):
    return sorted(map(repr, df.collect()))


def test_every_report_runs(spark, t):
    t.createOrReplaceTempView("transactions")
    assert len(catalog.names()) == 29
    for name in catalog.names():
        assert catalog.run(spark, name).limit(5).collect(), name


def test_catalogue(spark, t):
    assert catalog.describe("no such report") == "" and "region" in catalog.describe("sales_by_region")
    assert set(catalog.search("COHORT")) == {"cohort_analysis", "customer_churn_analysis"}
    with pytest.raises(KeyError):
        catalog.run(spark, "no such report")


def test_reports_come_in_order(spark, t):
    t.createOrReplaceTempView("transactions")
    spent = [r.total_spent for r in catalog.run(spark, "customer_segmentation").collect()]
    assert spent == sorted(spent, reverse=True)
    assert [r.total_spent for r in catalog.run(spark, "customer_segmentation", limit=2).collect()] == spent[:2]
    keys = [(r.customer_id, r.category_rank) for r in catalog.run(spark, "customer_product_affinity").collect()]
    assert keys == sorted(keys)


def test_read_only_sql(spark, t):
    t.createOrReplaceTempView("transactions")
    query = "WITH x AS (SELECT region AS created_at FROM transactions) SELECT created_at, count(*) n FROM x GROUP BY 1 ORDER BY n;"
    assert len(catalog.run_sql(spark, query).collect()) == 2
    assert catalog.run_sql(spark, "SELECT * FROM transactions", limit=7).count() == 7
    assert catalog.sql_total(spark, "SELECT * FROM transactions WHERE region = :r", {"r": "N"}).first()[0] > 0
    for command in ("DROP VIEW transactions", "CREATE TABLE x AS SELECT 1", "TRUNCATE TABLE transactions"):
        with pytest.raises(Exception):
            catalog.run_sql(spark, command).collect()


@pytest.mark.parametrize("limit", [17, 80])
def test_large_customers_give_the_same(t, limit):
    for report in (sales.sales_rank_by_customer, sales.lag_lead_analysis):
        assert bag(report(t)) == bag(report(t, group_rows=limit)), report.__name__


def test_running_total_ways_agree(t):
    everything = bag(sales.running_total_sales(t, limit=None))
    assert everything == bag(sales.running_total_sales(t, limit=None, group_rows=100))
    newest = bag(sales.running_total_sales(t, limit=50))
    assert len(newest) == 50 and set(newest) <= set(everything)
    assert bag(sales.running_total_sales(t, limit=10_000)) == everything


def test_running_total_shares_a_date(spark):
    rows = [(1, "a", 1, "p", "x", "N", str(v), 1.0, 1.0, datetime(2024, 1, d)) for d, v in ((1, 10), (1, 20), (2, 5))]
    rows.append((1, "a", 1, "p", "x", "N", "100", 1.0, 1.0, None))
    got = sales.running_total_sales(spark.createDataFrame(rows, SCHEMA), limit=3).collect()
    # The row without a date sorts first, so it is part of every total and the last to be shown.
    assert [(r.amount, r.running_total) for r in got] == [("5", 135.0), ("20", 130.0), ("10", 130.0)]


def test_segments_and_days(spark):
    rows = [(c, "n", 1, "p", "x", "N", a, 1.0, 1.0, d) for c, a, d in (
        (1, "6000", datetime(2024, 1, 1, 23)), (1, "bad", datetime(2024, 1, 2, 1)), (2, "1000", datetime(2024, 1, 1)),
        (3, "100", datetime(2024, 1, 1)), (4, "99", datetime(2024, 1, 1)))]
    got = {r.customer_id: (r.segment, r.days_as_customer) for r in
           sales.customer_segmentation(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("Premium", 1), 2: ("Gold", 0), 3: ("Silver", 0), 4: ("Bronze", 0)}


def test_growth_skips_gaps(spark):
    rows = [(1, "n", 1, "p", "x", "N", a, 1.0, 1.0, d) for a, d in (
        ("100", datetime(2024, 1, 5)), ("150", datetime(2024, 2, 5)), ("50", datetime(2024, 4, 5)), ("200", datetime(2025, 1, 1)))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.growth_rate_pct for r in sales.month_over_month_growth(df).collect()] == [None, None, 50.0, None]
    yearly = {(r.current_year, r.month): r.yoy_growth_rate for r in sales.year_over_year_growth(df).collect()}
    assert yearly == {(2024, 1): None, (2024, 2): None, (2024, 4): None, (2025, 1): 100.0}


def test_retention(spark):
    rows = [(c, "n", 1, "p", "x", "N", "1", 1.0, 1.0, datetime(2024, m, 3)) for c, m in (
        (1, 1), (1, 1), (1, 2), (2, 1), (3, 2), (None, 1), (None, 2))]
    got = {(str(r.current_month)[:7], str(r.previous_month)[:7]): (r.retained_customers, r.retention_rate)
           for r in sales.customer_retention(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("2024-01", "None"): (2, None), ("2024-02", "2024-01"): (1, 50.0), ("2024-02", "None"): (1, None)}


def test_share_counts_sales_without_category(spark):
    rows = [(1, "n", 1, "p", c, "N", "50", 1.0, 1.0, datetime(2024, 1, 1)) for c in ("x", None)]
    got = sales.sales_by_category(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.category, r.percent_of_total) for r in got] == [("x", 50.0)]
