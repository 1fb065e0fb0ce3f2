"""Inputs of several passes are computed once; file order needs no sort of all rows in one task."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievelark.operators import cleaning, explore, quality, sales
from sievelark.plans import shared
from sievelark.plans.ordered import PLACE, located
from sievelark.plans.rowid import with_row_index

ROWS = 300


def counted(spark):
    """A frame of sales as it comes from joins, and how many of its rows were computed so far."""
    rows = [(n % 7, n % 11, float(n * 37 % 101) + n / 1000, float(n % 13), float(n % 5), "abc"[n % 3], datetime(2024, 1, 1 + n % 28))
            for n in range(ROWS)]
    made = spark.createDataFrame(rows, "customer_id long, product_id long, amount double, cost double, quantity double, "
                                       "category string, transaction_date timestamp")
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return made.mapInArrow(pass_on, made.schema), seen


@pytest.mark.parametrize("job", [
    lambda t: explore.insights(t.select("amount", "cost", "quantity", "category")),
    lambda t: quality.quality_report(t.select("amount", "cost", "quantity"), limit=100)["violations"],
    lambda t: sales.percentile_sales(t, limit=10),
    lambda t: sales.running_total_sales(t),
    lambda t: sales.running_total_sales(t, limit=None, group_rows=50),
    lambda t: sales.sales_rank_by_customer(t, group_rows=20),
    lambda t: sales.lag_lead_analysis(t, group_rows=20),
], ids=["e09", "f08", "q18", "q16", "w1", "q17", "q19"])
def test_joined_input_is_computed_once(spark, job):
    t, seen = counted(spark)
    job(t).collect()
    assert seen.value == ROWS


def filtered(spark, tmp_path):
    place = str(tmp_path / "rows")
    spark.range(0, 900, 1, 6).select("id", (F.col("id") * 7 % 40).alias("k")).write.parquet(place)
    return spark.read.parquet(place).filter("id % 3 = 0")


def test_first_in_file_order_sorts_by_key_alone(spark, tmp_path):
    df = filtered(spark, tmp_path)
    for keep, pick in (("first", min), ("last", max)):
        found = cleaning.remove_duplicates(df, ["k"], keep)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and plan.count("Exchange") == 1
        best = {}
        for r in with_row_index(df).collect():
            best[r.k] = pick(best.get(r.k, (r.row_index, r.id)), (r.row_index, r.id))
        assert {r.k: r.id for r in found.collect()} == {k: i for k, (_, i) in best.items()}


def test_places_are_numbers(spark, tmp_path):
    """Sorted rows carry no paths, and a scan is not written again for its places."""
    df = filtered(spark, tmp_path)
    plan = with_row_index(df)._jdf.queryExecution().optimizedPlan()
    node = plan
    while node.getClass().getSimpleName() != "Window":
        node = node.children().head()
    kinds = {a.name(): a.dataType().simpleString() for a in (node.output().apply(i) for i in range(node.output().size()))}
    assert kinds["__source_file"] in ("int", "bigint") and kinds["__file"] == "bigint"
    scan = spark.read.parquet(str(tmp_path / "rows"))
    placed = located(scan)
    assert placed.inputFiles() and sorted(placed.inputFiles()) == sorted(scan.inputFiles())
    assert placed.select(f"{PLACE}.*").distinct().count() == 900
    assert shared.is_scan(scan) and not shared.is_scan(df) and not shared.is_scan(scan.withColumn("r", F.rand()))
