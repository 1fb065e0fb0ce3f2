"""Dataset registry and run history as append-only Parquet tables.

Rows are only added. The current state of a dataset is its newest row, the latest run the
newest row of that kind. Run tables are partitioned by day, so a look at recent runs reads
recent folders only. Nothing of the data itself is kept here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelark.operators import catalog, cleaning, explore, profile, quality
from sievelark.plans.shared import write_shared
from sievelark.sources.files import read_dataset, write_dataset

DATASETS = (
    "dataset_id string, name string, path string, format string, total_rows long, total_columns long, "
    "null_percentage double, duplicate_rows long, duplicate_percentage double, is_cleaned boolean, "
    "quality_score double, read_options string, created_at timestamp, updated_at timestamp"
)
_RUN = "run_id string, dataset_id string, created_at timestamp, run_date date, status string, error string, "
RUNS = {
    "validation": _RUN + quality.SCORES_SCHEMA
    + ", null_percentages map<string,double>, recommendations array<string>",
    "cleaning": _RUN + "completed_at timestamp, output_path string, table_path string, cleaned_rows long, removed_duplicates long, "
    "filled map<string,long>, had_nulls map<string,long>, normalized_text_columns long, "
    "standardized_dates long, removed_invalid_records long",
    "analytics": _RUN + "sections_path string, sections array<string>, insights array<string>",
}
HISTORY_ROWS = 10
PROCESSING = "processing"


def _now() -> datetime:
    return datetime.now(timezone.utc)


class Registry:
    """Datasets and runs below ``root``, a folder all executors can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- tables ---------------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, schema: str, rows: list[dict], by: list[str] | None = None) -> None:
        kinds = StructType.fromDDL(schema)
        frame = self.spark.createDataFrame([tuple(r.get(f) for f in kinds.names) for r in rows], kinds)
        write_dataset(frame.coalesce(1), f"{self.root}/{name}", "parquet", "append", by)

    def runs(self, kind: str) -> DataFrame:
        """One row a run: its end if it has one, else its start (status ``processing``)."""
        last = Window.partitionBy("run_id").orderBy(F.col("status") == PROCESSING)
        rows = self._table(kind, RUNS[kind]).withColumn("__n", F.row_number().over(last))
        return rows.filter(F.col("__n") == 1).drop("__n")

    def append_runs(self, kind: str, rows: list[dict]) -> None:
        self._append(kind, RUNS[kind], rows, ["run_date"])

    def compact(self, kind: str, before: date) -> int:
        """Rewrite the runs of the days before ``before`` as one file a day, without rows that a run's end replaced; the days rewritten.

        An append writes a file of its own, so the history of a busy day is many small files. The runs are stored in the shared folder
        first, so a lost driver leaves either the old files or the new ones to be written again. Nothing else may write to these
        days meanwhile.
        """
        old = write_shared(self.runs(kind).filter(F.col("run_date") < F.lit(before)), "runs")
        days = old.select("run_date").distinct().count()
        if days:
            old.repartition("run_date").sortWithinPartitions("run_date", "created_at").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{self.root}/{kind}")
        return days

    # --- datasets -------------------------------------------------------------------

    def register(self, name: str, path: str, fmt: str | None = None, describe: bool = True, **options) -> str:
        """Add a dataset, with the size and gap figures of its profile unless told not to.

        ``options`` go to the reader whenever the dataset is loaded (encoding, multi_line, null_tokens, a schema text).
        """
        row = {"dataset_id": uuid.uuid4().hex, "name": name, "path": path, "format": fmt, "is_cleaned": False,
               "read_options": json.dumps(options) if options else None,
               "created_at": _now(), "updated_at": _now()}
        if describe:
            row.update(profile.overview(read_dataset(self.spark, path, fmt, **options)).first().asDict())
        self._append("datasets", DATASETS, [row])
        return row["dataset_id"]

    def datasets(self) -> DataFrame:
        """The newest row of each dataset."""
        newest = Window.partitionBy("dataset_id").orderBy(F.desc("updated_at"))
        rows = self._table("datasets", DATASETS).withColumn("__n", F.row_number().over(newest))
        return rows.filter(F.col("__n") == 1).drop("__n")

    def dataset(self, dataset_id: str) -> dict:
        found = self.datasets().filter(F.col("dataset_id") == dataset_id).first()
        if found is None:
            raise KeyError(f"no dataset {dataset_id}")
        return found.asDict()

    def page(self, number: int = 1, size: int = 10, search: str | None = None, order_by: str = "created_at",
             descending: bool = True) -> tuple[DataFrame, int]:
        """One page of datasets and the number of all that match."""
        found = self.datasets()
        if search:
            found = found.filter(F.col("name").ilike(f"%{search}%"))
        return paged(found, order_by, number, size, descending), found.count()

    def load(self, dataset_id: str) -> DataFrame:
        entry = self.dataset(dataset_id)
        return read_dataset(self.spark, entry["path"], entry["format"], **json.loads(entry["read_options"] or "{}"))

    def _update(self, dataset_id: str, **changes) -> None:
        self._append("datasets", DATASETS, [{**self.dataset(dataset_id), **changes, "updated_at": _now()}])

    def export(self, dataset_id: str, path: str, fmt: str = "csv") -> str:
        return write_dataset(self.load(dataset_id), path, fmt)

    # --- history --------------------------------------------------------------------

    def latest(self, kind: str) -> DataFrame:
        """The newest finished run of each dataset."""
        order = Window.partitionBy("dataset_id").orderBy(F.desc("created_at"))
        done = self.runs(kind).filter(F.col("status") == "completed")
        return done.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") == 1).drop("__n")

    def latest_of(self, kind: str, dataset_id: str) -> dict | None:
        done = self.runs(kind).filter((F.col("dataset_id") == dataset_id) & (F.col("status") == "completed"))
        found = done.orderBy(F.desc("created_at")).limit(1).collect()
        return found[0].asDict() if found else None

    def history(self, kind: str, dataset_id: str, n: int = HISTORY_ROWS) -> DataFrame:
        return self.runs(kind).filter(F.col("dataset_id") == dataset_id).orderBy(F.desc("created_at")).limit(n)

    def run(self, kind: str, run_id: str) -> DataFrame:
        return self.runs(kind).filter(F.col("run_id") == run_id)

    def find_runs(self, kind: str, since: datetime | None = None, **equal) -> DataFrame:
        """Runs since a time whose columns equal the given values."""
        found = self.runs(kind)
        if since is not None:
            found = found.filter((F.col("run_date") >= F.lit(since.date())) & (F.col("created_at") >= F.lit(since)))
        for column, value in equal.items():
            found = found.filter(F.col(column) == value)
        return found

    # --- runs -----------------------------------------------------------------------

    def _started(self, dataset_id: str) -> dict:
        now = _now()
        return {"run_id": uuid.uuid4().hex, "dataset_id": dataset_id, "created_at": now, "run_date": now.date()}

    def _attempt(self, dataset_id: str, work: Callable[[dict], dict], row: dict | None = None) -> dict:
        """The run row of ``work``; an error becomes the row's status and text."""
        row = row or self._started(dataset_id)
        try:
            return {**row, **work(row), "status": "completed"}
        except Exception as error:  # the history keeps failed runs as well
            return {**row, "status": "failed", "error": f"{type(error).__name__}: {error}"}

    def _validation_row(self, dataset_id: str, assigned: quality.Roles | None = None) -> dict:
        def work(_row: dict) -> dict:
            measures = quality.measure(self.load(dataset_id), assigned)
            shares = {c: round(100 * n / measures.rows, 2) if measures.rows else 0.0
                      for c, n in measures.nulls.items()}
            return {**asdict(quality.score(measures)), "null_percentages": shares,
                    "recommendations": quality.recommendations(measures)}

        return self._attempt(dataset_id, work)

    def _store_validations(self, rows: list[dict]) -> None:
        self.append_runs("validation", rows)
        scored = [r for r in rows if r["status"] == "completed"]
        if scored:
            known = {r["dataset_id"]: r.asDict() for r in self.datasets().filter(
                F.col("dataset_id").isin([r["dataset_id"] for r in scored])).collect()}
            self._append("datasets", DATASETS, [
                {**known[r["dataset_id"]], "quality_score": r["overall_quality_score"], "updated_at": _now()}
                for r in scored])

    def validate(self, dataset_id: str, assigned: quality.Roles | None = None) -> dict:
        row = self._validation_row(dataset_id, assigned)
        self._store_validations([row])
        return row

    def validate_all(self, dataset_ids: list[str], at_once: int = 4) -> DataFrame:
        """(dataset_id, ok, error) of many validations; their Spark jobs run side by side."""
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            rows = list(pool.map(self._validation_row, dataset_ids))
        self._store_validations(rows)
        return self.spark.createDataFrame(
            [(r["dataset_id"], r["status"] == "completed", r.get("error")) for r in rows],
            "dataset_id string, ok boolean, error string")

    def quality_summary(self, dataset_id: str) -> DataFrame:
        """The newest scores of a dataset with its name, size and recommendations."""
        last = self.latest("validation").filter(F.col("dataset_id") == dataset_id)
        entry = self.datasets().select("dataset_id", F.col("name").alias("dataset_name"))
        return last.join(entry, "dataset_id").select(
            "dataset_id", "dataset_name", F.col("created_at").alias("analysis_date"), "overall_quality_score",
            "validation_status", "completeness", "uniqueness", "consistency", "validity", "accuracy",
            F.col("outliers").alias("accuracy_issues"), "total_rows", "total_columns", "critical_issues",
            "warning_issues", F.lit(0).cast("long").alias("info_messages"), "recommendations",
        )

    def clean(self, dataset_id: str, rules: cleaning.Rules | None = None, out: str | None = None) -> dict:
        """Read, clean, write as CSV and record the run.

        The run is on record from its start, so one whose driver is lost leaves a trace. The result is written as
        Parquet too: that is what later steps read, with the types and texts as they are.
        """
        def work(row: dict) -> dict:
            cleaned, done = cleaning.apply_rules(self.load(dataset_id), rules)
            stored = write_dataset(cleaned, f"{self.root}/cleaned/{row['run_id']}-table", "parquet")
            path = write_dataset(self.spark.read.parquet(stored), out or f"{self.root}/cleaned/{row['run_id']}", "csv")
            return {"output_path": path, "table_path": stored, "cleaned_rows": done.final_rows, "completed_at": _now(),
                    "removed_duplicates": done.removed_duplicates, "filled": done.filled,
                    "had_nulls": done.had_nulls, "normalized_text_columns": done.normalized_text_columns,
                    "standardized_dates": done.standardized_dates,
                    "removed_invalid_records": done.removed_invalid_records}

        row = self._started(dataset_id)
        self.append_runs("cleaning", [{**row, "status": PROCESSING}])
        row = self._attempt(dataset_id, work, row)
        self.append_runs("cleaning", [row])
        if row["status"] == "completed":
            self._update(dataset_id, is_cleaned=True)
        return row

    def cleaned(self, run_id: str) -> DataFrame:
        found = self.run("cleaning", run_id).first()
        if found is None or found["status"] != "completed":
            raise ValueError("no completed cleaning run with this id")
        rows = self.spark.read.parquet(found["table_path"])
        if rows.count() != found["cleaned_rows"]:
            raise ValueError(f"{found['table_path']} does not hold the {found['cleaned_rows']} rows of the run")
        return rows

    def export_cleaned(self, run_id: str, path: str, fmt: str = "csv") -> str:
        return write_dataset(self.cleaned(run_id), path, fmt)

    def analyse(self, dataset_id: str) -> dict:
        """Write the sections of the exploration report and record the run."""
        def work(row: dict) -> dict:
            report = explore.eda_report(self.load(dataset_id))
            base = f"{self.root}/sections/{row['run_id']}"
            for name, frame in report.items():
                write_dataset(frame, f"{base}/{name}", "parquet")
            lines = self.spark.read.parquet(f"{base}/generated_insights").orderBy("position").collect()
            return {"sections_path": base, "sections": list(report), "insights": [r["insight"] for r in lines]}

        row = self._attempt(dataset_id, work)
        self.append_runs("analytics", [row])
        return row

    def latest_insights(self, dataset_id: str, n: int | None = None) -> list[str]:
        last = self.latest_of("analytics", dataset_id)
        return [] if last is None else list(last["insights"])[:n]


def paged(df: DataFrame, order_by: str, number: int = 1, size: int = 10, descending: bool = True,
          ties: list[str] | None = None) -> DataFrame:
    """Page ``number`` (from 1) of the sorted frame; the sort column must exist."""
    if order_by not in df.columns:
        raise ValueError(f"unknown sort column {order_by!r}")
    order = [F.col(order_by).desc() if descending else F.col(order_by).asc(), *[F.col(t) for t in ties or []]]
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def export_report(spark: SparkSession, name: str, path: str, fmt: str = "csv", table: str = "transactions") -> str:
    """Write the result of a named report."""
    return write_dataset(catalog.run(spark, name, table=table), path, fmt)
