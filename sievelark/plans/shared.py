"""Tables written to the folder the cluster shares, to cut lineage between passes.

A written table survives the loss of executors, keeps its exact size for the planner and
can be read by several later jobs without computing its input again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER: ContextVar[str | None] = ContextVar("work_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local master (tests, one machine) gets a folder of its own making. A cluster has
    to name one, because a driver-local path is invisible to its executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sievelark-"))
    return context.getCheckpointDir().rstrip("/")


def byte_setting(spark: SparkSession, name: str) -> int:
    """A setting of the session in bytes; it may carry a unit."""
    text = spark.conf.get(name).lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[str]:
    """A folder of one run: tables written inside the block go there and are removed at its end.

    Results read these tables, so write or collect them before the block ends::

        with work_tables(spark):
            anomaly.iqr(df, ["id"]).write.parquet(path)
    """
    with work_folder(spark) as folder:
        try:
            yield folder
        finally:
            remove_folder(spark, folder)


@contextmanager
def work_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables written inside the block; whoever reads the results removes it."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, or the run's own."""
    return f"{_FOLDER.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, or the run's own, and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether the frame holds every row of a file scan once (a scan, or columns of one)."""
    return _source(df, ("Project", "SubqueryAlias"))


def is_picked(df: DataFrame) -> bool:
    """Whether each row of the frame is a row of a file scan, none twice (a scan, filtered or not)."""
    return _source(df, ("Project", "SubqueryAlias", "Filter"))


def _source(df: DataFrame, passed: tuple[str, ...]) -> bool:
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in passed and node.deterministic():
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def with_place(df: DataFrame, file: str, at: str) -> DataFrame | None:
    """``df`` with file and place of each row, None where it has none (joins, unions, aggregates)."""
    return with_source(df, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))


def with_source(df: DataFrame, *columns: Column) -> DataFrame | None:
    """``df`` with columns made of the file and place of each row, None where it has none."""
    try:
        placed = df.select("*", *columns)
        placed.schema  # resolve now
        return placed
    except AnalysisException:
        return None


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` for several passes: joins, unions and aggregates are written once, what only picks rows of a scan is read again."""
    return df if _source(df, ("Project", "SubqueryAlias", "Filter", "Generate")) else write_shared(df, label)
