import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sievelark.operators import cleaning
from sievelark.plans.rowid import with_row_index
from sievelark.plans.shared import shared_dir
from sievelark.sources import files
from sievelark.sources.registry import Registry, paged


def test_csv_types_and_missing(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,amount,flag,name,when\n1,1.5,True,"He said ""x, y""",2024-01-01\n2,NA,False,n/a,\n3,-2e3,true,Zoë,x\n')
    df = files.read_dataset(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "name": "string", "when": "string"}
    rows = df.orderBy("id").collect()
    assert rows[0].name == 'He said "x, y"' and rows[1].amount is None and rows[1].name is None and rows[2].amount == -2000


def test_csv_encoding_and_schema(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("id,name\n1,Zoë\n".encode("latin-1"))
    assert files.read_dataset(spark, str(path), encoding="ISO-8859-1").first().name == "Zoë"
    assert files.read_dataset(spark, str(path), schema="id string, name string").first().id == "1"


def test_json_forms(spark, tmp_path):
    records = [{"id": 1, "v": "x"}, {"id": 2, "v": None}]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    for name in ("array.json", "lines.json"):
        assert files.read_dataset(spark, str(tmp_path / name)).count() == 2
    (tmp_path / "mixed.jsonl").write_text('{"v": 1}\n{"v": "a"}\n{"v": 2.5}\n')
    mixed = files.read_json_values(spark, str(tmp_path / "mixed.jsonl"), ["v"])
    from sievelark.operators.quality import consistency
    assert consistency(mixed).first().types_found == ["NUMBER", "STRING"]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\"b,c", float("nan")), (2, None, 1.0)], "id int, s string, x double")
    for fmt in ("csv", "json", "parquet", "orc"):
        back = files.read_dataset(spark, files.write_dataset(df, str(tmp_path / f"out.{fmt}"), fmt))
        rows = back.orderBy("id").collect()
        assert rows[0].s == 'a"b,c' and rows[1].s is None and rows[0].x is None and rows[1].x == 1.0, fmt
    for bad in ("x.xlsx", "x.txt", "noext"):
        with pytest.raises(ValueError):
            files.read_dataset(spark, bad)
    with pytest.raises(ValueError):
        files.write_dataset(df, str(tmp_path / "x"), "xlsx")


def test_shared_dir_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_row_index_follows_the_file(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100, 0, -1).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert [r.row_index for r in with_row_index(df).orderBy(F.desc("id")).collect()] == list(range(100))
    several = spark.range(1000).repartition(5)
    assert sorted(r.row_index for r in with_row_index(several).collect()) == list(range(1000))


@pytest.fixture()
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "registry"))


def dirty(spark, path, rows=8):
    df = spark.createDataFrame(
        [(i, f" User{i}", None if i % 3 else f"u{i}@example.com", float(i) if i % 2 else None) for i in range(rows)],
        "id int, name string, email string, amount double")
    return files.write_dataset(df, path, "parquet")


def test_empty_registry(registry):
    assert registry.datasets().count() == 0 and registry.runs("validation").count() == 0
    assert registry.latest_of("analytics", "x") is None
    with pytest.raises(KeyError):
        registry.load("x")


def test_datasets_and_pages(spark, registry, tmp_path):
    ids = [registry.register(f"Data {i}", dirty(spark, str(tmp_path / f"d{i}"), 4 + i), "parquet") for i in range(3)]
    page, total = registry.page(1, 2, search="dATA", order_by="total_rows")
    assert total == 3 and [r.total_rows for r in page.collect()] == [6, 5]
    assert [r.name for r in registry.page(2, 2, order_by="name", descending=False)[0].collect()] == ["Data 2"]
    assert registry.page(search="none")[1] == 0 and registry.load(ids[0]).count() == 4
    with pytest.raises(ValueError):
        paged(registry.datasets(), "no_such_column")


def test_validation_history(spark, registry, tmp_path):
    one = registry.register("one", dirty(spark, str(tmp_path / "one")), "parquet")
    gone = registry.register("gone", str(tmp_path / "nothing"), "parquet", describe=False)
    done = {r.dataset_id: (r.ok, r.error) for r in registry.validate_all([one, gone]).collect()}
    assert done[one] == (True, None) and done[gone][0] is False and done[gone][1]
    second = registry.validate(one)
    assert [r.run_id for r in registry.history("validation", one, 1).collect()] == [second["run_id"]]
    assert registry.history("validation", one).count() == 2
    assert registry.latest("validation").filter(F.col("dataset_id") == one).first().run_id == second["run_id"]
    assert registry.run("validation", second["run_id"]).first().recommendations == second["recommendations"]
    assert registry.find_runs("validation", status="failed").first().dataset_id == gone
    assert registry.find_runs("validation", datetime.now(timezone.utc) + timedelta(days=2)).count() == 0
    assert registry.dataset(one)["quality_score"] == second["overall_quality_score"]
    summary = registry.quality_summary(one).first()
    assert summary.dataset_name == "one" and summary.completeness == second["completeness"]


def test_cleaning_run_and_export(spark, registry, tmp_path):
    one = registry.register("one", dirty(spark, str(tmp_path / "one")), "parquet")
    run = registry.clean(one, cleaning.Rules())
    stored = registry.run("cleaning", run["run_id"]).first()
    assert stored.status == "completed" and stored.cleaned_rows == 8 and stored.filled == {"amount": 4}
    assert registry.dataset(one)["is_cleaned"] and registry.cleaned(run["run_id"]).filter("name like 'user%'").count() == 8
    out = registry.export_cleaned(run["run_id"], str(tmp_path / "out"), "json")
    assert files.read_dataset(spark, out, "json").count() == 8
    assert files.read_dataset(spark, registry.export(one, str(tmp_path / "raw"), "csv"), "csv").count() == 8
    bad = registry.clean(one, cleaning.Rules(fill_strategy="guess"))
    assert registry.run("cleaning", bad["run_id"]).first().status == "failed"
    with pytest.raises(ValueError):
        registry.cleaned(bad["run_id"])


def test_stored_analysis(spark, registry, tmp_path):
    one = registry.register("one", dirty(spark, str(tmp_path / "one")), "parquet")
    run = registry.analyse(one)
    assert run["status"] == "completed", run.get("error")
    assert registry.latest_insights(one, 1) == ["8 rows in 4 columns"]
    assert spark.read.parquet(f"{run['sections_path']}/dataset_shape").first()["rows"] == 8


def test_history_is_compacted(spark, registry):
    from datetime import date, datetime

    def run(n, day, status):
        return {"run_id": f"r{n}", "dataset_id": "d", "created_at": datetime(2024, 1, day, 10, n), "run_date": date(2024, 1, day), "status": status}

    for n in range(6):
        for status in ("processing", "completed"):
            registry.append_runs("validation", [run(n, 1 + n % 3, status)])
    before = sorted(map(repr, registry.runs("validation").collect()))
    assert registry.compact("validation", date(2024, 1, 3)) == 2 and registry.compact("validation", date(2023, 1, 1)) == 0
    assert sorted(map(repr, registry.runs("validation").collect())) == before
    files_of_day = spark.read.parquet(f"{registry.root}/validation").groupBy("run_date").agg(
        F.count_distinct("_metadata.file_path").alias("files"), F.count(F.lit(1)).alias("rows"))
    assert {r.run_date.day: (r.files, r.rows) for r in files_of_day.collect()} == {1: (1, 2), 2: (1, 2), 3: (4, 4)}
