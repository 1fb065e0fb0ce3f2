"""The ways for large groups must give what the plain window or aggregate gives."""

import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelark.plans.ordered import add_positions, carry_last, located, ordered, running_sum, slices_in_order
from sievelark.plans.quantiles import quantiles


def skewed(spark, n=1200):
    """One key holds half of all rows, and a third of all rows are equal copies."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append(("hot", 5, 2.0, 1.0))
        else:
            key = "hot" if i % 6 == 1 else rng.choice(["a", "b", None])
            rows.append((key, rng.randrange(40), float(rng.randrange(100)),
                         float(i) if rng.random() < 0.3 else None))
    return spark.createDataFrame(rows, "k string, t int, v double, gap double").repartition(5)


def bag(df):
    return sorted(map(repr, df.collect()))


def test_positions_are_contiguous_and_ordered(spark):
    df = skewed(spark)
    placed = add_positions(located(df), ["k"], ["t", "v"], False, df.count(), slice_rows=100)
    rows = placed.orderBy("k", "__position").collect()
    assert len(rows) == df.count()
    seen = {}
    for r in rows:
        previous = seen.get(r.k)
        if previous is None:
            assert r["__position"] == 0
        else:
            assert r["__position"] == previous["__position"] + 1
            assert (r.t, r.v) >= (previous.t, previous.v)
        seen[r.k] = r


def test_bounded_windows_match_plain(spark):
    df = skewed(spark)
    results = []
    for limit in (10**9, 60):
        rows = ordered(df, ["k"], ["t", "v", "gap"], before=6, after=2, group_rows=limit)
        assert rows.split == (limit == 60)
        out = rows.df.select(
            "*",
            rows.row_number().alias("rn"),
            F.lag("v", 3).over(rows.window).alias("lag3"),
            F.lead("t", 2).over(rows.window).alias("lead2"),
            F.sum("v").over(rows.window.rowsBetween(-6, 0)).alias("s7"),
        )
        results.append(bag(rows.finish(out)))
    assert results[0] == results[1]


def test_row_number_ignores_edge_copies(spark):
    df = skewed(spark)
    rows = ordered(df, [], ["t", "v", "gap", "k"], before=3, group_rows=50)
    out = rows.finish(rows.df.withColumn("rn", rows.row_number()))
    assert sorted(r.rn for r in out.collect()) == list(range(1, df.count() + 1))


def test_descending_split(spark):
    df = skewed(spark)
    results = []
    for limit in (10**9, 75):
        rows = ordered(df, ["k"], ["t", "v", "gap"], descending=True, before=1, group_rows=limit)
        results.append(bag(rows.finish(rows.df.withColumn("p", F.lag("v").over(rows.window)))))
    assert results[0] == results[1]


def test_running_sum_and_carry(spark):
    df = skewed(spark)
    order = ["t", "v", "gap"]
    assert bag(running_sum(df, "v", "s", ["k"], order)) == bag(running_sum(df, "v", "s", ["k"], order, group_rows=40))
    # "gap" itself must not be an order column here: rows equal in (t, v) differ in it.
    unique = df.withColumn("id", F.monotonically_increasing_id())
    unique = unique.sparkSession.createDataFrame(unique.collect(), unique.schema)
    for descending in (False, True):
        plain = carry_last(unique, ["gap"], [], ["t", "id"], descending)
        split = carry_last(unique, ["gap"], [], ["t", "id"], descending, unique=True, group_rows=90)
        assert bag(plain) == bag(split.select(plain.columns))


def test_quantile_search_is_exact(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 2 else rng.choice("ab"), 1.0 if i % 3 == 0 else rng.gauss(0, 50), float(rng.randrange(9)))
            for i in range(20000)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(6)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]
    for by in ([], ["k"]):
        built_in = {tuple(r[b] for b in [*by, "column"]): r["quantiles"]
                    for r in quantiles(df, ["x", "y"], probs, by).collect()}
        searched = {tuple(r[b] for b in [*by, "column"]): r["quantiles"]
                    for r in quantiles(df, ["x", "y"], probs, by, limit=40).collect()}
        assert built_in.keys() == searched.keys()
        for key, values in built_in.items():
            for a, b in zip(values, searched[key]):
                assert abs(a - b) < 1e-9, (key, values, searched[key])


def test_equal_rows_are_spread_over_slices(spark):
    """A third of all rows are copies of one row; no slice may hold them all."""
    df = skewed(spark).filter("k = 'hot' and t = 5 and v = 2 and gap = 1")
    rows = df.count()
    sliced = slices_in_order(located(df), ["k"], ["t", "v", "gap"], False, rows, 50)
    assert sliced.groupBy("__slice").count().agg(F.max("count")).first()[0] < rows / 3
    placed = add_positions(located(df), ["k"], ["t", "v", "gap"], False, rows, slice_rows=50)
    assert sorted(r["__position"] for r in placed.collect()) == list(range(rows))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=60),
       st.lists(st.floats(0, 1), min_size=1, max_size=3))
def test_quantile_search_on_any_values(spark, values, probabilities):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(df, ["x"], probabilities, limit=2).first()["quantiles"]
    ordered_values = sorted(values)
    for p, q in zip(probabilities, got):
        at = p * (len(values) - 1)
        low, high = ordered_values[math.floor(at)], ordered_values[math.ceil(at)]
        assert low <= q <= high or math.isclose(q, low + (high - low) * (at - math.floor(at)), rel_tol=1e-9)
