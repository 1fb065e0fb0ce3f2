import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievelark.operators import incremental

SCHEMA = "k long, v double, t string, b boolean, d timestamp"


def rows(low, high):
    return [(n, None if n % 5 == 0 else n * 1.5 - 20 if n % 7 else float("nan"), None if n % 3 == 0 else str(n), n % 2 == 0, datetime(2024, 1, 1 + n % 28))
            for n in range(low, high)]


def written(spark, place, low, high, parts=2):
    spark.createDataFrame(rows(low, high), SCHEMA).repartition(parts, "k").write.mode("append").parquet(place)


def figures(frame):
    return {r["column"]: r for r in frame.collect()}


def test_appends_merge_to_the_whole(spark, tmp_path):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    for low, high in ((0, 100), (100, 130), (130, 400)):
        written(spark, grown, low, high)
        assert 1 <= incremental.update(spark, grown, str(tmp_path / "s1")) <= 2
    assert incremental.update(spark, grown, str(tmp_path / "s1")) == 0
    written(spark, whole, 0, 400, 1)
    incremental.update(spark, whole, str(tmp_path / "s2"))
    one, other = figures(incremental.profile(spark, grown, str(tmp_path / "s1"))), figures(incremental.profile(spark, whole, str(tmp_path / "s2")))
    assert set(one) == {"k", "v", "t", "b", "d"}
    plain = [v for _, v, *_ in rows(0, 400) if v is not None and v == v]
    mean = sum(plain) / len(plain)
    for name in one:
        for field in ("kind", "rows", "known", "nulls", "least", "largest", "suggested"):
            assert one[name][field] == other[name][field], (name, field)
        assert one[name]["distinct_estimate"] == pytest.approx(other[name]["distinct_estimate"], rel=0.03)
    assert one["v"]["known"] == len(plain) and one["v"]["mean"] == pytest.approx(mean)
    assert one["v"]["std"] == pytest.approx((sum((v - mean) ** 2 for v in plain) / (len(plain) - 1)) ** 0.5)
    ranks = sorted(plain)
    assert abs(sum(v <= one["v"]["median_estimate"] for v in ranks) / len(ranks) - 0.5) < 0.03
    assert one["t"]["suggested"] == "numeric" and one["b"]["kind"] == "other" and abs(one["k"]["distinct_estimate"] - 400) < 12


def test_removed_rewritten_and_missing_files(spark, tmp_path):
    place, state = str(tmp_path / "p"), str(tmp_path / "s")
    assert incremental.profile(spark, _folder(place), state).count() == 0
    written(spark, place, 0, 50, 1)
    incremental.update(spark, place, state)
    first = [f for f in os.listdir(place) if f.endswith(".parquet")][0]
    written(spark, place, 50, 80, 1)
    incremental.update(spark, place, state)
    assert figures(incremental.profile(spark, place, state))["k"]["rows"] == 80
    os.remove(os.path.join(place, first))
    left = figures(incremental.profile(spark, place, state))["k"]
    assert (left["rows"], left["least"]) == (30, 50.0)


def test_a_changed_schema_and_repeated_updates(spark, tmp_path):
    place, state = str(tmp_path / "p"), str(tmp_path / "s")
    written(spark, place, 0, 20, 1)
    incremental.update(spark, place, state)
    spark.range(5).select(F.lit("x").alias("new"), F.col("id").alias("k")).write.mode("append").parquet(place)
    incremental.update(spark, place, state)
    incremental._read(spark, state).write.mode("append").parquet(state + "-again")
    spark.read.parquet(state + "-again").write.mode("append").parquet(state)  # every state twice
    got = figures(incremental.profile(spark, place, state))
    assert got["k"]["rows"] == got["new"]["rows"] == 25 and got["k"]["nulls"] == 0 and got["new"]["nulls"] == 20


def test_files_without_rows_are_looked_at_once(spark, tmp_path):
    place, state = str(tmp_path / "p"), str(tmp_path / "s")
    written(spark, place, 0, 40, 1)
    assert incremental.update(spark, place, state) == 1
    before = figures(incremental.profile(spark, place, state))
    written(spark, place, 0, 0, 1)
    files = len([f for f in os.listdir(place) if f.endswith(".parquet")])
    assert files > 1 and incremental.update(spark, place, state) == files - 1
    assert incremental.update(spark, place, state) == 0 and incremental.new_files(spark, place, state) == []
    assert figures(incremental.profile(spark, place, state)) == before
    alone, other = str(tmp_path / "alone"), str(tmp_path / "o")
    written(spark, alone, 0, 0, 1)
    assert incremental.update(spark, alone, other) > 0 and incremental.update(spark, alone, other) == 0
    assert incremental.profile(spark, alone, other).count() == 0


def _folder(place):
    os.makedirs(place)
    return place
