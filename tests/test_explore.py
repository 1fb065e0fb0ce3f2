import random

import numpy as np
import pytest

from sievelark.operators import explore, kpi, profile
from sievelark.plans.moments import correlations, moments


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def matrix(df):
    return {(r.column1, r.column2): r.correlation for r in df.collect()}


def test_summary(spark):
    df = frame(spark, "id int, amount double", *[(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0, None])])
    row = {r["column"]: r for r in profile.numeric_summary(df).collect()}["amount"]
    assert row["count"] == 4 and row["mean"] == 4.0 and row["median"] == 2.5
    assert round(row["skewness"], 4) == 1.0182 and row["min"] == 1.0 and row["q75"] == 4.75


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.gamma(2, 3, 500) + 1e6
    m = moments(frame(spark, "x double", *[(float(v),) for v in values]), ["x"])["x"]
    d = values - values.mean()
    assert m.std == pytest.approx(values.std(ddof=1), rel=1e-10)
    assert m.skewness == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5, rel=1e-8)
    assert m.kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3, rel=1e-8)


def test_correlation(spark):
    df = frame(spark, "x double, y double, z double, c double", *[(float(i), 2.0 * i, 6.0 - i, 5.0) for i in range(1, 6)])
    found = matrix(explore.correlation_matrix(df))
    assert found["x", "y"] == 1.0 and found["x", "z"] == -1.0 and found["x", "x"] == 1.0
    assert found["x", "c"] is None and found["c", "c"] is None


def test_correlation_ways_agree(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(100, 5, (400, 4))
    base[:, 3] = base[:, 0] * 2 + rng.normal(0, 1, 400)
    rows = [tuple(None if rng.random() < 0.2 and j else float(v) for j, v in enumerate(r)) for r in base]
    df = frame(spark, "a double, b double, c double, d double", *rows)
    sums, product = correlations(df, df.columns), correlations(df, df.columns, pair_sums=0)
    numbers = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for i, a in enumerate(df.columns):
        for j, b in enumerate(df.columns):
            both = ~np.isnan(numbers[:, i]) & ~np.isnan(numbers[:, j])
            want = np.corrcoef(numbers[both, i], numbers[both, j])[0, 1]
            assert sums[a, b] == pytest.approx(want, abs=1e-9)
            assert product[a, b] == pytest.approx(want, abs=1e-9)


def test_normality(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, "n double, u double", *[(float(a), float(b)) for a, b in zip(rng.normal(size=400), rng.exponential(size=400))])
    found = {r["column"]: r for r in explore.normality(df).collect()}
    assert found["n"].distribution_type == "normal" and found["u"].distribution_type == "non-normal"
    few = explore.normality(frame(spark, "x double", *[(float(i),) for i in range(5)])).first()
    assert few.distribution_type == "insufficient_data" and few.normality_pvalue is None


def test_histogram(spark):
    df = frame(spark, "x int, c int", *[(i, 5) for i in range(11)])
    found = {}
    for r in explore.histogram(df).orderBy("column", "bin").collect():
        found.setdefault(r["column"], []).append(r["count"])
    assert found == {"x": [2] + [1] * 9, "c": [0, 0, 0, 0, 11, 0, 0, 0, 0, 0]}


def test_categories(spark):
    df = frame(spark, "product string", *[(p,) for p in "AAAABBCD"], (None,))
    rows = explore.categorical_distribution(df, 2).orderBy("rank").collect()
    assert [(r.category, r["count"]) for r in rows] == [("A", 4), ("B", 2)]
    assert rows[0].total_unique == 4 and rows[0].missing_count == 1 and round(rows[0].percentage, 2) == 44.44


def test_trends(spark):
    df = frame(spark, "day string, revenue double", ("2024-01-05", 10.0), ("2024-01-20", None), ("2024-03-01", 5.0),
               ("bad", 99.0), ("2023-03-01", None))
    months = [(r.period, r.total, r["count"]) for r in explore.monthly_trend(df, "day").collect()]
    assert months == [("2023-03", 0.0, 0), ("2024-01", 10.0, 1), ("2024-03", 5.0, 1)]
    assert [(r.year, r.total) for r in explore.yearly_trend(df, "day").collect()] == [(2023, 0.0), (2024, 15.0)]


def test_insights_and_report(spark):
    rng = random.Random(4)
    rows = [(i, float(i * 3), rng.choice("xyz"), "2024-01-%02d" % (1 + i % 28)) for i in range(100)]
    df = frame(spark, "id int, amount double, category string, date string", *rows)
    lines = explore.insight_lines(df)
    assert lines[0] == "100 rows in 4 columns"
    assert "pairs with a strong correlation: 1" in lines and "amount with id: r = 1.000" in lines
    assert lines[-1] == "text columns: 2"
    report = explore.eda_report(df)
    assert report["dataset_shape"].first() == (100, 4, 2, 2) and report["monthly_trend"].count() == 1


def test_columns(spark):
    df = frame(spark, "amount int, category string", (1, "A"), (2, "B"), (3, "A"), (4, None), (5, "C"))
    row = explore.column_insight(df, "amount").first()
    assert row.unique_values == 5 and row.mean == 3.0
    assert [r.value for r in explore.column_top_values(df, "category").orderBy("rank").collect()] == ["A", "B", "C"]
    assert explore.column_insight(df, "category").first().null_count == 1
    with pytest.raises(ValueError):
        explore.column_insight(df, "nope")
    pair = explore.compare_columns(frame(spark, "x int, y int", (1, 2), (2, 4), (3, None)), "x", "y").first()
    assert pair.correlation == pytest.approx(1.0) and pair.column2_null_count == 1


def test_kpis(spark):
    df = frame(spark, "date string, amount string, quantity int", ("2024-01-01", "10", 1), ("2024-01-31", "20", 2),
               ("2024-02-10", "x", 3), (None, "5", None))
    row = kpi.kpis(df).first()
    assert (row.total_rows, row.total_revenue, row.average_transaction_value) == (4, 35.0, 35 / 3)
    assert row.days_covered == 40 and row.monthly_average_revenue == 15.0 and row.total_quantity == 6.0
    plain = kpi.kpis(frame(spark, "a string", ("x",))).first()
    assert plain.asDict() == {"total_rows": 1, "total_columns": 1}
