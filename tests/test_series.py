from datetime import date, datetime, timedelta

import numpy as np
import pytest

from sievelark.operators import anomaly, forecast
from sievelark.operators.isolation import average_path, draw_samples, isolation_forest


def series(spark, values, start=date(2024, 1, 1), by=None):
    rows = [(start + timedelta(days=i), float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "d date, v double")


def test_constant_column_has_no_anomalies(spark):
    df = spark.createDataFrame([(i, 0.1 * 3) for i in range(10)], "id int, x double")
    assert anomaly.z_scores(df, ["id"]).count() == 0 and anomaly.iqr(df, ["id"]).count() == 0


def test_z_score_uses_the_population(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1] * 10 + [100])], "id int, x double")
    row = anomaly.z_scores(df, ["id"], threshold=3.0).first()
    x = np.array([1.0] * 10 + [100.0])
    assert row.score == pytest.approx((100 - x.mean()) / x.std()) and row["std"] == pytest.approx(x.std(ddof=1))


def test_groups_have_their_own_bounds(spark):
    rows = [(i, "a" if i < 20 else None, float(i % 5 if i < 20 else 1000 + i % 5)) for i in range(40)] + [(99, "a", 1000.0)]
    df = spark.createDataFrame(rows, "id int, k string, x double")
    assert [r.id for r in anomaly.iqr(df, ["id"], by=["k"]).collect()] == [99]
    assert [r.id for r in anomaly.z_scores(df, ["id"], by=["k"]).collect()] == [99]


def test_spikes(spark):
    df = series(spark, [10, 11, 10, 11, 10, 11, 500, 10])
    got = anomaly.spikes(df, "d", "v", threshold=2.2).collect()
    assert [(str(r.date)[:10], r.spike_type) for r in got] == [("2024-01-07", "spike")]
    assert anomaly.spikes(df, "d", "v", threshold=2.28).count() == 0  # beyond what seven rows can reach
    assert anomaly.spikes(series(spark, [5] * 9), "d", "v").count() == 0


def test_spikes_put_rows_without_date_last(spark):
    rows = [(datetime(2024, 1, i), 10.0 + i % 2) for i in range(1, 7)] + [(None, 900.0)]
    got = anomaly.spikes(spark.createDataFrame(rows, "d timestamp, v double"), "d", "v").collect()
    assert [(r.date, r.amount) for r in got] == [(None, 900.0)]


def test_dispatch(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id int, x double")
    assert anomaly.detect(df, ["id"], "iqr").count() == 0
    with pytest.raises(ValueError):
        anomaly.detect(df, ["id"], "spikes")
    with pytest.raises(ValueError):
        anomaly.detect(df, ["id"], "other")


def cloud(spark, parts=4):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))]
    rows += [(1000 + i, 20.0 + i, -20.0 + i) for i in range(5)]
    return spark.createDataFrame(rows, "id int, x double, y double").repartition(parts)


def test_isolation_ranks_far_points_first(spark):
    found = isolation_forest(cloud(spark), ["id"], contamination=0.05)
    ranked = [r.id for r in anomaly.top(found, 5, "anomaly_score", ascending=True).collect()]
    assert sorted(ranked) == [1000, 1001, 1002, 1003, 1004]
    assert 20 <= found.count() <= 26  # five per cent of 505


def test_isolation_finds_far_rows_that_most_samples_miss(spark):
    """Three far rows among 60,000: hardly a sample of 256 holds one, yet they come before the corners of the rest."""
    x = np.random.default_rng(3).uniform(size=(60_000, 3))
    x[::20_000] = x[::20_000] * 50 + 1000
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id int, x double, y double, z double")
    found = isolation_forest(df, ["id"], contamination=0.01)
    ranked = [r.id for r in anomaly.top(found, 3, "anomaly_score", ascending=True).collect()]
    assert sorted(ranked) == [0, 20_000, 40_000] and 590 <= found.count() <= 600


def test_isolation_does_not_depend_on_partitions(spark):
    a, b = (sorted((r.id, r.anomaly_score) for r in isolation_forest(cloud(spark, n), ["id"], trees=20).collect())
            for n in (1, 7))
    assert a == b


def test_isolation_leaves_out_rows_with_gaps(spark):
    df = spark.createDataFrame([(i, float(i % 9) if i else None, 1.0) for i in range(60)], "id int, x double, c double")
    assert 0 not in [r.id for r in isolation_forest(df, ["id"], trees=10, contamination=0.3).collect()]


def test_samples_are_full_at_every_size(spark):
    df = spark.range(20_000).withColumnRenamed("id", "key")
    drawn = draw_samples(df, ["key"], trees=10, sample=16, seed=1, rows=20_000).collect()
    assert len(drawn) == 160 and len({(r.tree, r.key) for r in drawn}) == 160 and len({r.key for r in drawn}) > 140
    assert draw_samples(df, ["key"], 10, 16, 1, 10**14).count() == 0  # a share far below one row is no error
    small = draw_samples(spark.range(100).withColumnRenamed("id", "key"), ["key"], 10, 16, 1, 100).collect()
    assert len(small) == 160


def test_average_path():
    assert [round(float(average_path(n)), 3) for n in (0, 1, 2, 256)] == [0.0, 0.0, 1.0, 10.245]


def test_combined(spark):
    found = anomaly.combined(cloud(spark), ["id"]).collect()
    best = [r.id for r in found if r.method_count == 3]
    assert set(range(1000, 1005)) <= set(best)
    assert anomaly.combined(cloud(spark), ["id"], shown=2).count() <= 6


def test_linear_series(spark):
    s = forecast.prepare(series(spark, [3 + 2 * t for t in range(20)]), "d", "v")
    metrics = forecast.linear_metrics(s).first()
    assert metrics.trend == pytest.approx(2) and metrics.r_squared == pytest.approx(1)
    assert metrics.rmse == pytest.approx(0, abs=1e-9)
    got = forecast.linear_forecast(s, 3).orderBy("step").collect()
    assert [round(r.value, 6) for r in got] == [43.0, 45.0, 47.0]
    assert [str(r.date) for r in got] == ["2024-01-21", "2024-01-22", "2024-01-23"]


def test_position_counts_rows_not_days(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=30 * i), float(i), None) for i in range(10)]
    df = spark.createDataFrame(rows, "d date, v double, other string")
    assert forecast.linear_forecast(forecast.prepare(df, "d", "v"), 1).first().value == pytest.approx(10)


def test_smoothing(spark):
    s = forecast.prepare(series(spark, [3, 5, 2, 8, 1]), "d", "v")
    assert {round(r.value, 4) for r in forecast.smoothing_forecast(s).collect()} == {3.5088}
    gaps = forecast.prepare(series(spark, [3, 5, None, 2, 8, 1]), "d", "v")
    assert round(forecast.smoothing_forecast(gaps, 1).first().value, 4) == 3.5088


def test_split_series_is_the_same(spark):
    df = series(spark, [(i * 37) % 101 for i in range(300)])
    one, many = (forecast.prepare(df, "d", "v", lags=7, group_rows=n) for n in (10**9, 40))
    assert sorted(map(repr, one.df.collect())) == sorted(map(repr, many.df.collect()))


def test_zero_values_and_metrics(spark):
    zero = forecast.linear_metrics(forecast.prepare(series(spark, [1] * 8 + [0, 0]), "d", "v")).first()
    assert zero.mape is None
    some = forecast.linear_metrics(forecast.prepare(series(spark, [1] * 8 + [0, 1]), "d", "v")).first()
    assert some.mape == float("inf")


def test_short_series_goes_without_the_forest(spark):
    df = series(spark, range(12))
    with pytest.raises(forecast.TooShort):
        forecast.forest_forecast(forecast.prepare(df, "d", "v", lags=7))
    got = forecast.forecast(df, "d", "v", periods=2).collect()
    assert {r.method for r in got} == {"linear_regression", "exponential_smoothing", "ensemble"}
    by_step = {(r.method, r.step): r.value for r in got}
    assert by_step["ensemble", 1] == pytest.approx(
        (by_step["linear_regression", 1] + by_step["exponential_smoothing", 1]) / 2)


def test_forest(spark):
    values = [10, 20, 30, 40] * 20
    s = forecast.prepare(series(spark, values), "d", "v", lags=7)
    result = forecast.forest_forecast(s, periods=6, trees=10)
    got = [r.value for r in result.forecast.orderBy("step").collect()]
    assert got == pytest.approx([10, 20, 30, 40, 10, 20], abs=6)
    assert sorted(r.feature for r in result.importance.collect()) == [f"lag_{i}" for i in range(1, 8)]


def test_report(spark):
    s = forecast.prepare(series(spark, [10, 20, 30, 40] * 10), "d", "v", lags=7)
    report = forecast.forecast_report(s, 2)
    assert {r.method for r in report["metrics"].collect()} == {"linear_regression", "random_forest"}
    rows = report["forecast"].collect()
    means = {m: [r.value for r in rows if r.method == m and r.step == 1][0] for m in {r.method for r in rows}}
    best = means.pop("ensemble")
    assert len(means) == 3 and best == pytest.approx(sum(means.values()) / 3)


def test_groups_of_series(spark):
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), float(i * m)) for k, m in (("a", 1), ("b", 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {(r.k, r.step): round(r.value, 6) for r in forecast.forecast(df, "d", "v", "linear_regression", 2, ["k"]).collect()}
    assert got == {("a", 1): 10.0, ("a", 2): 11.0, ("b", 1): 50.0, ("b", 2): 55.0}


def test_forest_of_a_long_series_uses_all_rows(spark):
    rows = [(k, date(2020, 1, 1) + timedelta(days=n), float((n * 37) % 11 + (n > 200) * 50))
            for k, size in (("long", 307), (None, 257), ("short", 57)) for n in range(size)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    series = forecast.prepare(df, "d", "v", ["k"], lags=7)
    found = forecast.forest_forecast(series, periods=3, trees=5, depth=6, rows=100)
    assert {r.k: r.test_rows for r in found.metrics.collect()} == {"long": 60, None: 50, "short": 10}
    assert found.forecast.count() == 9 and found.importance.count() == 21
    whole = forecast.prepare(df.filter("k = 'long'"), "d", "v", lags=7)
    assert forecast.forest_forecast(whole, periods=3, trees=5, depth=6, rows=100).metrics.first().test_rows == 60


def test_both_ways_grow_the_same_forest(spark):
    rows = [(k, date(2020, 1, 1) + timedelta(days=n), float((n * 37) % 11 * m + (n % 30 > 20) * 50) + 0.37)
            for k, m, size in (("a", 1, 260), (None, -3, 190)) for n in range(size)]
    series = forecast.prepare(spark.createDataFrame(rows, "k string, d date, v double"), "d", "v", ["k"], lags=7)
    whole = forecast.forest_forecast(series, periods=5, trees=6, depth=8, leaves=60)
    spread = forecast.forest_forecast(series, periods=5, trees=6, depth=8, rows=0, leaves=60)

    def figures(found):
        return [sorted(map(repr, part.collect())) for part in (found.forecast, found.importance)]

    assert figures(whole) == figures(spread)
    close = {r.k: r for r in spread.metrics.collect()}
    for r in whole.metrics.collect():
        assert (r.test_rows, r.rmse, r.r_squared) == (close[r.k].test_rows, pytest.approx(close[r.k].rmse), pytest.approx(close[r.k].r_squared))


def test_forest_splits_equal_a_plain_search():
    import numpy as np

    from sievelark.operators import forest

    rng = np.random.default_rng(2)
    for least in (1, 3, 6):
        place = np.concatenate([np.arange(5), rng.integers(0, 5, 40)])
        bins, weight = rng.integers(0, 6, (45, 3)), rng.integers(1, 4, 45).astype(float)
        weighed = weight * rng.integers(-9, 10, 45)
        gain, base, feature, cut, n0, s0, n1, s1 = forest._best(place, bins, weight, weighed, 5, 6, least)
        for k in range(5):
            found = []
            for f in range(3):
                for c in range(5):
                    low, high = (place == k) & (bins[:, f] <= c), (place == k) & (bins[:, f] > c)
                    if weight[low].sum() >= least and weight[high].sum() >= least:
                        value = weighed[low].sum() ** 2 / weight[low].sum() + weighed[high].sum() ** 2 / weight[high].sum()
                        found.append((value, -f, -c, weight[low].sum(), weighed[low].sum()))
            best = max(found, default=None)
            if best is None or best[0] <= base[k] * (1 + 1e-9):
                assert gain[k] == -np.inf
            else:
                assert (gain[k], n0[k], s0[k]) == (pytest.approx(best[0]), best[3], best[4]) and feature[k] == -best[1]
                assert n0[k] + n1[k] == weight[place == k].sum() and s0[k] + s1[k] == weighed[place == k].sum()


def test_poisson_weights():
    import numpy as np

    from sievelark.operators import forest

    drawn = forest.weights(np.arange(200_000), 3, 42)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    assert not np.array_equal(drawn, forest.weights(np.arange(200_000), 4, 42))
    assert np.array_equal(drawn[500:600], forest.weights(np.arange(500, 600), 3, 42))


def test_intervals_hold_their_level(spark):
    """Of 150 series with a trend and noise, about the level's share has the next value inside."""
    import numpy as np

    rng = np.random.default_rng(7)
    size, many = 150, 400
    noise = rng.standard_t(4, (many, size + 1))
    values = 3 + 0.5 * np.arange(size + 1) + noise
    rows = [(k, date(2020, 1, 1) + timedelta(days=n), float(values[k, n])) for k in range(many) for n in range(size)]
    series = forecast.prepare(spark.createDataFrame(rows, "k long, d date, v double"), "d", "v", ["k"])
    for level in (0.6, 0.9):
        found = forecast.linear_intervals(series, 1, level).collect()
        inside = np.mean([r.lower <= values[r.k, size] <= r.upper for r in found])
        assert len(found) == many and abs(inside - level) < 0.05


def test_interval_ranks(spark):
    steps = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 20.0), (None, 1, 30.0)], "k string, step long, value double")
    tested = spark.createDataFrame([("a", float(m), 0.0) for m in (5, -1, 3, 2, 4, 9, -7, 6, 8)] + [("b", 1.0, 0.0)] + [
        (None, 2.0, 0.0)] * 30, "k string, y double, guess double")
    for rows in (forecast.GROUP_ROWS, 4):
        got = {r.k: (r.lower, r.upper) for r in forecast.with_intervals(steps, tested, ["k"], 0.7, rows).collect()}
        assert got == {"a": (3.0, 17.0), "b": (None, None), None: (28.0, 32.0)}  # the 7th of 9 misses; one row is too few
    with pytest.raises(ValueError):
        forecast.with_intervals(steps, tested, ["k"], 1.0)


def test_forest_intervals(spark):
    s = forecast.prepare(series(spark, [10, 20, 30, 40] * 20), "d", "v", lags=7)
    for r in forecast.forest_intervals(s, periods=3, level=0.8, trees=10).collect():
        assert r.lower <= r.value <= r.upper and r.upper - r.lower < 20
