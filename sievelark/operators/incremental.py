"""Profiles of datasets that grow: a state for each file, merged on read, so an append scans only what is new.

A state row holds what one column of one file adds: rows, known values, mean, sum of squares about it, least and largest value,
number and truth texts, a distinct sketch and a quantile sketch. Files are known by path, length and time of change. An
update scans the files without a state and appends theirs; a profile merges the states of the files that are there now, so
removed and rewritten files drop out by themselves. A file without rows has one state row, without a column.

Counts, means, deviations, extremes and text kinds are exact (sums of squares are merged about the common mean). Distinct values and the
median come from sketches (relative error about 2 %, rank within 2 %) and are named estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelark.functions.predicates import is_number
from sievelark.plans.longform import quoted

STATE = ("file string, length long, changed timestamp, `column` string, kind string, rows long, known long, mean double, squares double, "
         "least double, largest double, numbers long, truths long, distinct binary, quantiles binary")
_FILE = ["file", "length", "changed"]
_LISTED = "file string, length long, changed timestamp"
_NAMES = [f.split()[0].strip("`") for f in STATE.split(", ")]
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)\z"


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """file, length and changed of all data files, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed"))


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    return "text" if isinstance(field.dataType, T.StringType) else "other"


def _parts(field: T.StructField) -> Column:
    c, kind = quoted(field.name), _kind(field)
    nothing = F.lit(None)
    value = c.cast("double") if kind == "numeric" else nothing.cast("double")
    value = F.when(~F.isnan(value), value)
    known = F.count(value if kind == "numeric" else c)
    text = c.cast("string")
    return F.struct(
        F.lit(field.name).alias("column"), F.lit(kind).alias("kind"), known.alias("known"), F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("squares"), F.min(value).alias("least"), F.max(value).alias("largest"),
        (F.count_if(is_number(c)) if kind == "text" else F.lit(0)).cast("long").alias("numbers"),
        (F.count_if(c.rlike(_TRUTH)) if kind == "text" else F.lit(0)).cast("long").alias("truths"),
        F.hll_sketch_agg(text).alias("distinct"),
        (F.kll_sketch_agg_double(value) if kind == "numeric" else nothing.cast("binary")).alias("quantiles"))


def states(df: DataFrame) -> DataFrame:
    """A row for each file and column of a file scan, one pass with partial sums before the shuffle."""
    file = F.col("_metadata.file_path").alias("file")
    own = df.select("*", file, F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("changed"))
    wide = own.groupBy(*_FILE).agg(F.count(F.lit(1)).alias("rows"), F.array(*[_parts(f) for f in df.schema.fields]).alias("parts"))
    long = wide.select(*_FILE, "rows", F.explode("parts").alias("p")).select(*_FILE, "rows", "p.*")
    return long.select(*_NAMES)


def new_files(spark: SparkSession, path: str, state: str) -> list[str]:
    """Files without a state; one that was changed counts as new."""
    return [r.file for r in _without_state(spark, files_of(spark, path), state).toLocalIterator()]


def _without_state(spark: SparkSession, files: DataFrame, state: str) -> DataFrame:
    return files.join(_read(spark, state).select(*_FILE).distinct(), _FILE, "left_anti")


def _read(spark: SparkSession, state: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(state)


def update(spark: SparkSession, path: str, state: str, fmt: str = "parquet") -> int:
    """Scan the files of ``path`` without a state and append theirs to ``state``; how many they were."""
    fresh = [tuple(r) for r in _without_state(spark, files_of(spark, path), state).select(*_FILE).toLocalIterator()]
    if fresh:
        states(spark.read.format(fmt).option("mergeSchema", True).load([f[0] for f in fresh])).write.mode("append").parquet(state)
        listed = spark.createDataFrame(fresh, _LISTED)  # as they were before the scan: one rewritten since stays new
        empty = _without_state(spark, listed, state).withColumn("rows", F.lit(0).cast("long"))
        kinds = {f.name: f.dataType for f in _read(spark, state).schema}
        marks = empty.select(*[F.col(c) if c in empty.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _NAMES])
        if not marks.isEmpty():
            marks.write.mode("append").parquet(state)
    return len(fresh)


def profile(spark: SparkSession, path: str, state: str) -> DataFrame:
    """A row for each column of the files that are there: column, kind, rows, known, nulls, null_share, mean, std, least, largest,
    suggested type, distinct_estimate, median_estimate. Reads states only.

    A column missing in some files counts as NULL there. Files twice in the state (two updates at once) count once. Without files
    there are no rows.
    """
    here = files_of(spark, path)
    rows = _read(spark, state).filter(F.col("column").isNotNull()).dropDuplicates([*_FILE, "column"]).join(here, _FILE, "left_semi")
    total = F.lit(rows.select(*_FILE, "rows").distinct().agg(F.sum("rows")).first()[0] or 0).cast("long").alias("rows")
    weighed = rows.groupBy("column").agg(
        F.max("kind").alias("kind"), F.sum("known").alias("known"), (F.sum(F.col("mean") * F.col("known")) / F.sum(
            F.when(F.col("mean").isNotNull(), F.col("known")))).alias("mean"),
        F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("numbers").alias("numbers"), F.sum("truths").alias("truths"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_estimate"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))
    median = F.when((F.col("kind") == "numeric") & (F.col("known") > 0), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)))
    about = rows.join(weighed.select("column", F.col("mean").alias("common")), "column").groupBy("column").agg(
        F.sum(F.col("squares") + F.col("known") * (F.col("mean") - F.col("common")) * (F.col("mean") - F.col("common"))).alias("squares"))
    suggested = F.when(F.col("kind") != "text", F.col("kind")).when(F.col("known") == 0, "unknown").when(
        F.col("numbers") == F.col("known"), "numeric").when(F.col("truths") == F.col("known"), "boolean").otherwise("text")
    merged = weighed.join(about, "column").select("*", total)
    return merged.select(
        "column", "kind", "rows", "known", (F.col("rows") - F.col("known")).alias("nulls"),
        (1 - F.try_divide("known", "rows")).alias("null_share"), "mean",
        F.sqrt(F.try_divide("squares", F.when(F.col("known") > 1, F.col("known") - 1))).alias("std"), "least", "largest",
        suggested.alias("suggested"), "distinct_estimate", median.alias("median_estimate"))
