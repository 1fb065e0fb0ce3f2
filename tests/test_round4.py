"""Helper columns of the way for large series never meet a column of the frame; only what the windows need is written."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievelark.operators import anomaly
from sievelark.plans.ordered import GROUP_ROWS, PLACE, located
from sievelark.plans.shared import remove_folder, work_folder

ROWS = 400


def events(spark, tmp_path, scan=True):
    """Events of two kinds, some without a date or a value, every ninth one far off; read from files, or computed."""
    rows = [(n, None if n % 31 == 0 else datetime(2024, 1, 1) + timedelta(hours=n * 7 % 100), "ab"[n % 3 == 0],
             None if n % 29 == 0 else 500.0 if n % 9 == 0 else float(n * 37 % 11), f"page {n}") for n in range(ROWS)]
    made = spark.createDataFrame(rows, "id long, ts timestamp, kind string, amount double, page string").repartition(5, "id")
    if not scan:
        return made.distinct()
    made.write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events"))


def bag(df):
    return sorted(repr((*r[:-3], round(r.moving_average, 9), round(r.z_score, 9), r.spike_type)) for r in df.collect())


@pytest.mark.parametrize("scan", [True, False], ids=["scan", "computed"])
@pytest.mark.parametrize("by", [None, ["kind"]], ids=["all", "by_kind"])
def test_spikes_of_a_large_series_are_those_of_a_plain_window(spark, tmp_path, scan, by):
    df = events(spark, tmp_path, scan)
    plain, split = (bag(anomaly.spikes(df, "ts", "amount", 2.0, by, ["id"], group_rows=limit)) for limit in (ROWS, 60))
    assert plain and split == plain


@pytest.mark.parametrize("scan", [True, False], ids=["scan", "computed"])
def test_a_place_clashes_with_no_column(spark, tmp_path, scan):
    df = events(spark, tmp_path, scan).withColumnsRenamed({"id": "__at", "kind": "__file", "page": "a.page"})
    placed = located(df)
    assert placed.columns == [*df.columns, PLACE]
    assert sorted(map(repr, placed.drop(PLACE).collect())) == sorted(map(repr, df.collect()))
    assert placed.select(f"{PLACE}.*").distinct().count() == ROWS


def test_spikes_beyond_the_usual_limit(spark):
    """The second far value lies just behind the edge of a block, its six earlier rows before it."""
    far = [1000, GROUP_ROWS + 2]
    df = spark.range(GROUP_ROWS + 50).select("id", F.timestamp_seconds("id").alias("ts"), F.when(
        F.col("id").isin(far), 900.0).otherwise(10.0 + F.col("id") % 2).alias("amount"))
    assert sorted((r.id, r.spike_type) for r in anomaly.spikes(df, "ts", "amount", ties=["id"]).collect()) == [(n, "spike") for n in far]


def test_large_series_leave_other_columns_behind(spark, tmp_path):
    df = events(spark, tmp_path)
    with work_folder(spark) as folder:
        anomaly.spikes(df, "ts", "amount", by=["kind"], ties=["id"], group_rows=60).collect()
    written = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/slices-*").columns
    remove_folder(spark, folder)
    assert set(written) - {"__serial"} == {"id", "kind", "__x", "__undated", "__at"}
