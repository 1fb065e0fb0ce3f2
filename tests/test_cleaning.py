from datetime import datetime

import pytest

from sievelark.operators import cleaning, quality


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_dedup(spark):
    df = frame(spark, "id int, name string", (1, "A"), (2, "B"), (2, "B"), (3, "C"))
    once = cleaning.remove_duplicates(df)
    assert once.count() == 3 and cleaning.remove_duplicates(once).count() == 3
    assert cleaning.remove_duplicates(df, keep=False).count() == 2


def test_dedup_by_subset_and_order(spark):
    df = frame(spark, "k string, t int", ("a", 2), ("a", 1), (None, 5), (None, 4), ("b", 9))
    first = {(r.k, r.t) for r in cleaning.remove_duplicates(df, ["k"], "first", ["t"]).collect()}
    last = {(r.k, r.t) for r in cleaning.remove_duplicates(df, ["k"], "last", ["t"]).collect()}
    assert first == {("a", 1), (None, 4), ("b", 9)} and last == {("a", 2), (None, 5), ("b", 9)}
    single = {(r.k, r.t) for r in cleaning.remove_duplicates(df, ["k"], False).collect()}
    assert single == {("b", 9)}


def test_dedup_in_file_order(spark):
    df = frame(spark, "k string, t int", *[("a", i) for i in range(50, 0, -1)]).coalesce(1)
    assert cleaning.remove_duplicates(df, ["k"]).first().t == 50
    assert cleaning.remove_duplicates(df, ["k"], "last").first().t == 1


def test_fill_mean_and_median(spark):
    df = frame(spark, "amount double, n int, s string", (100.0, 1, "a"), (200.0, 2, None), (None, None, "c"), (400.0, 4, "d"))
    rows = cleaning.fill_missing(df, "mean").collect()
    assert round(rows[2].amount, 2) == 233.33 and round(rows[2].n, 2) == 2.33 and rows[1].s is None
    assert cleaning.fill_missing(df, "median").collect()[2].amount == 200.0


def test_fill_mode(spark):
    df = frame(spark, "category string, n int, none string", ("A", 2, None), ("B", 10, None), ("A", 10, None), (None, 2, None), (None, None, None))
    rows = cleaning.fill_missing(df, "mode").collect()
    assert rows[3].category == "A" and rows[4].n == 2 and rows[4].none is None  # numeric order on a tie


def test_fill_value_by_type(spark):
    df = frame(spark, "a int, s string", (None, None))
    assert cleaning.fill_missing(df, "value", 0).first() == (0, None)
    assert cleaning.fill_missing(df, "value", "x").first() == (None, "x")
    assert cleaning.fill_missing(df, "value", {"a": 1, "s": "y"}).first() == (1, "y")


def test_carry_with_order_and_partition(spark):
    df = frame(spark, "k string, t int, v int", ("a", 1, 1), ("a", 2, None), ("a", 3, 3), ("b", 1, None), ("b", 2, 7))
    ahead = {(r.k, r.t): r.v for r in cleaning.fill_forward(df, ["t"], partition_by=["k"]).collect()}
    back = {(r.k, r.t): r.v for r in cleaning.fill_backward(df, ["t"], partition_by=["k"]).collect()}
    assert ahead == {("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("b", 1): None, ("b", 2): 7}
    assert back == {("a", 1): 1, ("a", 2): 3, ("a", 3): 3, ("b", 1): 7, ("b", 2): 7}


def test_carry_in_file_order(spark):
    df = frame(spark, "v int", *[(i if i % 4 == 0 else None,) for i in range(40)]).coalesce(1)
    got = sorted(r.v for r in cleaning.fill_missing(df, "forward_fill").collect())
    assert got == sorted(4 * (i // 4) for i in range(40))


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        cleaning.fill_missing(frame(spark, "v int", (1,)), "guess")


def test_text(spark):
    df = frame(spark, "email string, name string, note string", ("  JOHN@TEST.COM  ", "\tJohn ", " Keep Case "))
    assert cleaning.normalize_text(df).first() == ("john@test.com", "john", "Keep Case")


def test_dates(spark):
    df = frame(spark, "created_date string, updated int", ("2024-01-05", 5), ("no", 6))
    assert cleaning.date_candidates(df) == ["created_date"]
    rows = cleaning.standardize_dates(df).collect()
    assert rows[0].created_date == datetime(2024, 1, 5) and rows[1].created_date is None and rows[1].updated == 6


def test_categories(spark):
    df = frame(spark, "status string", ("Active",), ("Inactive",), ("Active",), ("pending",))
    assert {(r.value, r["count"]) for r in cleaning.category_inventory(df).collect()} == {
        ("Active", 2), ("Inactive", 1), ("pending", 1)}
    mapped = cleaning.map_categories(df, {"status": {"Active": "on"}, "other": {"a": "b"}})
    assert sorted(r.status for r in mapped.collect()) == ["Inactive", "on", "on", "pending"]
    many = frame(spark, "s string", *[(str(i),) for i in range(120)])
    assert cleaning.map_categories(many, {"s": {"1": "x"}}).filter("s = 'x'").count() == 1
    assert cleaning.category_inventory(many).count() == 0 and cleaning.category_inventory(many, 121).count() == 120


def test_chain(spark):
    df = frame(spark, "id double, name string, email string, created string, amount double",
               (1.0, " A", "X@Y.COM", "2024-01-01", 10.0), (1.0, " A", "X@Y.COM", "2024-01-01", 10.0),
               (2.0, "A", None, "bad", None), (3.0, "B", "z@y.com", "01/02/2024", -5.0))
    out, done = cleaning.apply_rules(df, cleaning.Rules(
        remove_invalid=True, validation_rules={"amount": "amount >= 0"}, standardize_categorical=True,
        categorical_mapping={"name": {"b": "bee"}}))
    rows = {r.id: r for r in out.collect()}
    assert (done.initial_rows, done.removed_duplicates, done.removed_invalid_records, done.final_rows) == (4, 1, 1, 2)
    assert rows[2.0].amount == 2.5 and rows[2.0].email is None and rows[2.0].created is None
    assert rows[1.0].name == "a" and rows[1.0].email == "x@y.com"
    assert done.had_nulls == {"email": 1, "amount": 1} and done.filled == {"amount": 1}
    assert done.normalized_text_columns == 2 and done.standardized_dates == 1


def test_chain_keeps_file_order_for_carrying(spark):
    df = frame(spark, "k int, v int", *[(i // 2, i // 2 if (i // 2) % 3 == 0 else None) for i in range(30)]).coalesce(1)
    out, done = cleaning.apply_rules(df, cleaning.Rules(fill_strategy="forward_fill"))
    assert {r.k: r.v for r in out.collect()} == {k: 3 * (k // 3) for k in range(15)}
    assert done.removed_duplicates == 15 and out.columns == ["k", "v"]


def test_cleaning_never_lowers_completeness(spark):
    df = frame(spark, "id double, amount double", (1.0, None), (None, 2.0), (3.0, 4.0))
    before = quality.score(quality.measure(df)).completeness
    out, _ = cleaning.apply_rules(df)
    assert quality.score(quality.measure(out)).completeness >= before
