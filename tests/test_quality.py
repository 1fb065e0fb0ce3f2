import pytest
from pyspark.sql import functions as F

from sievelark.functions import predicates
from sievelark.operators import profile, quality


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def judged(spark, values, test):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.ok for r in df.select("v", test(F.col("v")).alias("ok")).collect()}


def test_dates(spark):
    good = ["2024-1-5", "05-01-2024", "2024/01/05", "2024-01-05 07:08:09", "13-12-2024", "12-13-2024",
            "31/12/2024", "12/31/2024", "05-01-2024 1:2:3", "2024-01-05   07:08:09"]
    bad = ["2024-02-30", "24-01-01", "20240-01-01", "2024-01-05x", "x2024-01-05", "", "2024-13-01",
           "2024-01-05 25:00:00", "13-13-2024", "2024-01-05\n"]
    found = judged(spark, good + bad, predicates.is_date)
    assert [v for v in good if not found[v]] == [] and [v for v in bad if found[v]] == []


def test_phones(spark):
    good = ["+12125550123", "(212) 555-0123", "212.555.0123", "1 212 555 0123", "+442079460958"]
    bad = ["12345", "abc", "0125550123", "112 555 0123"]
    found = judged(spark, good + bad, predicates.is_phone)
    assert all(found[v] for v in good) and not any(found[v] for v in bad)
    df = spark.createDataFrame([("(212) 555-0123",), ("+442079460958",), ("12",)], "v string")
    assert [r[0] for r in df.select(predicates.normalize_phone(F.col("v"))).collect()] == [
        "+12125550123", "+442079460958", None]
    assert judged(spark, ["2125550123", "+33123456789"], lambda c: predicates.is_phone(c, "FR")) == {
        "2125550123": False, "+33123456789": True}


def test_emails_and_urls(spark):
    found = judged(spark, ["a.b+c@example.com", "a@b", "a b@example.com", "@example.com", "a@x.org\n"], predicates.is_email)
    assert [v for v, ok in found.items() if ok] == ["a.b+c@example.com"]
    found = judged(spark, ["https://example.com/x", "http://localhost:80/", "ftp://example.com", "example.com",
                           "HTTP://1.2.3.4?q=1"], predicates.is_url)
    assert [v for v, ok in found.items() if ok] == ["https://example.com/x", "http://localhost:80/", "HTTP://1.2.3.4?q=1"]


def test_numbers_and_non_negative(spark):
    found = judged(spark, ["1", " -2.5e3 ", ".5", "1d", "", "abc", "NaN", "1,000"], predicates.is_number)
    assert [v for v, ok in found.items() if ok] == ["1", " -2.5e3 ", ".5"]
    assert judged(spark, ["3", "-1", "x"], predicates.is_non_negative) == {"3": True, "-1": False, "x": False}


def test_completeness(spark):
    df = frame(spark, "id double, name string, email string",
               (1.0, "A", "a@x.com"), (2.0, None, "b@x.com"), (None, "C", "c@x.com"), (4.0, "D", "d@x.com"))
    m = quality.measure(df)
    assert sum(m.nulls.values()) == 2 and quality.score(m).completeness == 83.33
    assert {r["column"]: r.null_percentage for r in quality.completeness(df).collect()} == {
        "id": 25.0, "name": 25.0, "email": 0.0}
    assert [quality.completeness_severity(s) for s in (69.9, 89.9, 90.0)] == ["critical", "warning", "ok"]


@pytest.mark.parametrize("hashed_rows", [0, 10**9])
def test_uniqueness(spark, hashed_rows):
    df = frame(spark, "id int, name string", (1, "A"), (2, "B"), (2, "B"), (3, None), (3, None), (None, "3"))
    row = quality.uniqueness(df, hashed_rows).first()
    assert (row.duplicate_rows, row.severity, row.duplicate_percentage) == (2, "critical", 33.33)
    assert quality.duplicate_members(df, hashed_rows=hashed_rows).count() == 4


def test_hash_tells_nulls_apart(spark):
    df = frame(spark, "a string, b string", (None, "x"), ("x", None), ("x", "y"))
    assert quality.uniqueness(df, 0).first().duplicate_rows == 0


def test_consistency_of_variants(spark):
    df = frame(spark, "id int, v string", (1, "1"), (2, "2.5"), (3, '"text"'), (4, None))
    found = {r["column"]: r for r in quality.consistency(df, ["v"]).collect()}
    assert found["v"].issue == "mixed_types" and found["v"].types_found == ["NUMBER", "STRING"]
    assert found["id"].issue is None
    s = quality.score(quality.measure(df, json_columns=["v"]))
    assert s.consistency == 50.0 and s.critical_issues == 1


def test_empty_column_is_neither_consistent_nor_an_issue(spark):
    df = frame(spark, "a int, b string", (1, None), (2, None))
    s = quality.score(quality.measure(df))
    assert s.consistency == 50.0


def test_outliers(spark):
    df = frame(spark, "row long, amount int", *enumerate([100, 105, 110, 115, 1000]))
    found = quality.violations(df, ["row"], ("outlier",), quality.Roles(numeric=["amount"])).collect()
    assert [(r.row, r.value, r.lower_bound, r.upper_bound) for r in found] == [(4, "1000", 90.0, 130.0)]


def test_clean_report(spark):
    df = frame(spark, "id int, name string, email string, amount double",
               (1, "A", "a@example.com", 100.0), (2, "B", "b@example.com", 200.0), (3, "C", "c@example.com", 150.0))
    report = quality.quality_report(df)
    assert report["scores"].overall_quality_score == 100.0 and report["scores"].validation_status == "pass"
    assert report["recommendations"] == []


def test_dirty_report(spark):
    df = frame(spark, "id double, email string, amount int",
               (1.0, "a@example.com", 100), (None, None, -50), (None, None, 200), (1.0, "bad@", 10000))
    report = quality.quality_report(df, ids=["amount"])
    s = report["scores"]
    assert 0 <= s.overall_quality_score <= 100 and s.critical_issues + s.warning_issues > 0
    assert s.invalid_emails == 1 and s.negative_quantities == 1 and s.outliers == 1
    assert report["recommendations"][0] == "More than a fifth of the values is missing in: id, email"
    checks = {r["check"] for r in report["violations"].collect()}
    assert checks == {"email", "negative", "outlier"}


def test_empty_frame(spark):
    df = frame(spark, "id int, email string")
    s = quality.score(quality.measure(df))
    assert s.total_rows == 0 and s.validity == 100.0 and s.uniqueness == 100.0
    row = profile.overview(df).first()
    assert row.null_percentage == 0.0 and row.duplicate_percentage == 0.0


def test_score_counts_all_outliers():
    m = quality.Measures(rows=1000, columns=1, nulls={"x": 0}, known={"x": 1000}, outliers=250)
    s = quality.score(m)
    assert s.accuracy == 75.0 and s.accuracy_capped == 90.0
    assert s.overall_quality_score == round(85 + 75 * 0.15, 2)
    assert quality.score(m, outlier_cap=50).accuracy_capped == 95.0


def test_rule_filter(spark):
    df = frame(spark, "amount int", (100,), (-50,), (200,), (0,))
    for rule in ("amount >= 0", F.col("amount") >= 0, lambda v: v >= 0):
        assert quality.keep_valid(df, {"amount": rule, "other": "false"}).count() == 3


def test_roles_can_be_given(spark):
    df = frame(spark, "hotel string, mail string", ("Ritz", "a@"))
    assert quality.measure(df).phones == 1  # "tel" is part of "hotel"
    assert quality.measure(df, quality.Roles(phones=[], emails=[])).phones == 0


def test_issue_summary(spark):
    df = frame(spark, "id int, phone string", (1, "12"), (2, "12"), (3, "x"), (4, "2125550123"))
    row = quality.issue_summary(quality.violations(df, ["id"], ("phone",)), 4).first()
    assert (row["check"], row["count"], row.percentage, row.examples) == ("phone", 3, 75.0, ["12", "x"])


def test_profile(spark):
    df = frame(spark, "id int, name string, email string, amount double",
               (1, "A", "a@x.com", 10.0), (2, "B", None, 20.0), (3, "C", "c@x.com", 30.0))
    parts = profile.profile(df)
    row = parts["overview"].first()
    assert (row.total_rows, row.total_columns, row.duplicate_rows) == (3, 4, 0) and row.null_percentage == 8.33
    numeric = {r["column"]: r for r in parts["numeric"].collect()}
    assert numeric["amount"]["median"] == 20.0 and numeric["amount"]["std"] == 10.0
    unique = {r["column"]: r.unique_values for r in parts["columns"].collect()}
    assert unique == {"id": 3, "name": 3, "email": 2, "amount": 3}


def test_suggested_types(spark):
    df = frame(spark, "i int, d double, b boolean, t string, s string, n string",
               (1, 1.5, True, "2024-01-01", "x", None), (2, 2.5, False, "2024-1-2", "2024-01-01", None))
    assert {r["column"]: r.suggested_type for r in profile.suggested_types(df).collect()} == {
        "i": "integer", "d": "float", "b": "boolean", "t": "datetime", "s": "string", "n": "unknown"}


def test_special_column_names(spark):
    df = frame(spark, "`a.b` int, `c d` string", (1, "x"), (1, "x"), (None, None))
    assert profile.overview(df).first().duplicate_rows == 1
    assert quality.measure(df).nulls == {"a.b": 1, "c d": 1}


def test_sample_and_tables(spark):
    frame(spark, "x int", (3,), (1,), (2,)).createOrReplaceTempView("three_rows")
    assert [r.x for r in profile.sample(spark.table("three_rows"), 2, ["x"]).collect()] == [1, 2]
    with pytest.raises(ValueError):
        profile.sample(spark.table("three_rows"), 1001)
    assert profile.table_stats(spark, ["three_rows"]).first().row_count == 3
    with pytest.raises(ValueError):
        profile.table_summary(spark, "no_such_table")
