"""Row positions of any frame, lossless text through files and runs, odd column names, forests by key, work tables."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievelark.operators import catalog, cleaning, explore, forecast, kpi, quality
from sievelark.plans import shared
from sievelark.plans.rowid import with_row_index
from sievelark.sources import files
from sievelark.sources.registry import PROCESSING, Registry

ROOT = Path(__file__).resolve().parents[1]


def two_files(spark, tmp_path):
    path = str(tmp_path / "two")
    for low in (0, 10):
        spark.range(low, low + 10).coalesce(1).withColumn("k", F.col("id") % 3).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def positions(df):
    return [r.row_index for r in with_row_index(df).collect()]


def test_positions_of_a_filtered_scan(spark, tmp_path):
    df = two_files(spark, tmp_path)
    whole = {r.id: r.row_index for r in with_row_index(df).collect()}
    assert sorted(whole.values()) == list(range(20))
    some = with_row_index(df.filter("id >= 5 AND id < 15")).collect()
    assert sorted(r.row_index for r in some) == list(range(10))
    assert [r.id for r in sorted(some, key=lambda r: r.row_index)] == sorted(range(5, 15), key=whole.get)


def test_positions_of_other_frames(spark, tmp_path):
    df = two_files(spark, tmp_path)
    for frame, rows in ((df.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))), 40), (df.union(df), 40),
                        (df.join(df.withColumnRenamed("k", "j"), "id"), 20), (df.groupBy("k").count(), 3), (df.limit(4), 4),
                        (df.select("id"), 20), (df.withColumn("x", F.col("id") * 2).select("x"), 20)):
        assert sorted(positions(frame)) == list(range(rows))


def test_first_copy_and_fills_of_a_filtered_scan(spark, tmp_path):
    path = str(tmp_path / "gaps")
    rows = [(n, {5: "A", 10: "B"}.get(n)) for n in range(20)]
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, "id int, v string").coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    order = [r.id for r in sorted(with_row_index(df).collect(), key=lambda r: r.row_index)]
    kept = [n for n in order if n >= 5]
    filled = {r.id: r.v for r in cleaning.fill_missing(df.filter("id >= 5"), "forward_fill").collect()}
    last, want = None, {}
    for n in kept:
        last = {5: "A", 10: "B"}.get(n, last)
        want[n] = last
    assert filled == want
    first = cleaning.remove_duplicates(df.filter("id >= 5").withColumn("k", F.lit(1)), ["k"], "first").first()
    assert first.id == kept[0]


def test_texts_with_line_breaks(spark, tmp_path):
    rows = [(1, 'a\nb, "c"\r\nd', " padded "), (2, "plain", None), (3, "last\n", "x,y")]
    df = spark.createDataFrame(rows, "id long, text string, more string")
    path = files.write_dataset(df, str(tmp_path / "out"), "csv")
    assert sorted(tuple(r) for r in files.read_dataset(spark, path, "csv").collect()) == rows
    registry = Registry(spark, str(tmp_path / "registry"))
    dataset = registry.register("texts", path, "csv", null_tokens=["plain"])
    assert registry.load(dataset).filter("text IS NULL").count() == 1
    run = registry.clean(dataset, cleaning.Rules(fill_missing=False))
    assert run["status"] == "completed" and registry.cleaned(run["run_id"]).count() == 3
    out = registry.export_cleaned(run["run_id"], str(tmp_path / "export"), "csv")
    assert {r.text for r in files.read_dataset(spark, out, "csv").collect()} == {'a\nb, "c"\r\nd', None, "last"}


def test_a_started_run_leaves_a_trace(spark, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path / "registry"))
    path = files.write_dataset(spark.range(3), str(tmp_path / "data"), "parquet")
    dataset = registry.register("data", path, "parquet")
    done = registry.clean(dataset)
    assert [r.status for r in registry.history("cleaning", dataset).collect()] == ["completed"]

    def lost(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(cleaning, "apply_rules", lost)
    with pytest.raises(KeyboardInterrupt):
        registry.clean(dataset)
    states = {r.run_id: r.status for r in registry.history("cleaning", dataset).collect()}
    assert sorted(states.values()) == ["completed", PROCESSING] and states[done["run_id"]] == "completed"


def test_reports_of_odd_names(spark):
    df = spark.createDataFrame([(1.5, 3, "2024-01-05", 10.0)], "lifetime_value double, update_count int, when_time string, amount double")
    report = explore.eda_report(df)
    assert "errors" not in report and report["monthly_trend"].first().period == "2024-01"
    assert explore.eda_report(df.select("lifetime_value", "amount"))["dataset_shape"].first().rows == 1
    dated = df.select("update_count", F.to_date("when_time").alias("total_date"), "amount")
    assert kpi.kpis(dated).first().total_revenue == 10.0
    assert kpi.kpis(df.select(F.col("update_count").alias("date_count"))).first().total_rows == 1


def test_a_failing_section_is_named(spark, monkeypatch):
    def broken(df):
        raise ValueError("no")

    monkeypatch.setattr(explore, "normality", broken)
    report = explore.eda_report(spark.createDataFrame([(1, "a")], "x int, s string"))
    assert "normality" not in report and report["errors"].first().section == "normality" and "histogram" in report


def test_one_answer_for_numeric_texts(spark):
    df = spark.createDataFrame([("\t5",), ("6",)], "s string")
    assert [r.column for r in quality.type_mismatches(df).collect()] == quality.measure(df).numeric_texts == ["s"]


def test_report_without_ids_lists_violations(spark):
    df = spark.createDataFrame([("a@",), ("ok@example.com",)], "email string").coalesce(1)
    found = quality.quality_report(df)["violations"].filter("check = 'email'").collect()
    assert [r.row_index for r in found] == [0]


def test_whole_results_of_sql(spark):
    spark.range(5000).createOrReplaceTempView("many")
    assert catalog.run_sql(spark, "SELECT * FROM many").count() == 5000
    assert "groupBy" in catalog.text("sales_by_region") and catalog.text("none") == ""
    assert "sales_by_region" in catalog.search("avg_sale", in_text=True) and "sales_by_region" not in catalog.search("avg_sale")
    assert catalog.listing(spark).filter("text = ''").count() == 0


def test_forest_of_each_key(spark):
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), float(m * (1 + i % 4))) for k, m in (("a", 10), ("b", 100)) for i in range(80)]
    rows += [("short", date(2024, 1, 1) + timedelta(days=i), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    found = forecast.forecast(df, "d", "v", "random_forest", 6, ["k"], trees=10).collect()
    got = {(r.k, r.step): r.value for r in found}
    assert {k for k, _ in got} == {"a", "b"}
    assert [got["a", s] for s in range(1, 7)] == pytest.approx([10, 20, 30, 40, 10, 20], abs=6)
    assert [got["b", s] for s in range(1, 7)] == pytest.approx([100, 200, 300, 400, 100, 200], abs=60)
    methods = {(r.k, r.method) for r in forecast.forecast(df, "d", "v", periods=1, by=["k"]).collect()}
    assert ("a", "random_forest") in methods and ("a", "ensemble") in methods and ("short", "random_forest") not in methods


def test_keyed_trees_fit_what_they_see():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (400, 3))
    y = np.where(x[:, 0] > 5, 3.0, -1.0) + 0.5 * (x[:, 1] > 2)
    forest = forecast._Regressor(x, y, 20, 30, 1, 64)
    assert np.abs(forest.predict(x) - y).mean() < 0.1
    assert forecast._Regressor(x[:, :1] * 0, y, 3, 30, 1, 64).predict(x[:2, :1]).shape == (2,)


def test_work_tables_are_removed(spark, tmp_path):
    with shared.work_tables(spark) as folder:
        one = shared.write_shared(spark.range(5), "one")
        assert one.count() == 5 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))
    outside = shared.write_shared(spark.range(2), "two")
    assert folder not in outside.inputFiles()[0]


def test_package_reaches_the_workers(tmp_path):
    code = """
import sys
sys.path.append({root!r})
from sievelark.session import build_session
from sievelark.operators.isolation import isolation_forest
from sievelark.operators.explore import correlation_matrix
from pyspark.sql import functions as F
spark = build_session("other", "local[2]", spark__sql__shuffle__partitions="2", spark__checkpoint__dir={place!r})
sys.path.remove({root!r})
df = spark.range(300).select(F.col("id"), *[F.rand(n).alias(f"x{{n}}") for n in range(12)])
assert isolation_forest(df, ["id"], trees=5).count() > 0
assert correlation_matrix(df).count() == 169
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code.format(root=str(ROOT), place=str(tmp_path / "shared"))], cwd=tmp_path,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=240)
    assert "fine" in done.stdout, done.stderr[-2000:]
