"""Readers and writers for CSV, JSON, Parquet and ORC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelark.plans.longform import quoted
from sievelark.plans.shared import byte_setting
from sievelark.sources.splits import array_to_lines, largest_file, read_csv_splits

# Texts that stand for a missing value in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy", ".deflate")
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc"}
_WHOLE = r"^\s*[+-]?[0-9]+\s*\z"
_REAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)\z"


def format_of(path: str, fmt: str | None = None) -> str:
    """Format by name or by the extension of the path; unknown ones are refused."""
    name = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported format: {name}")
    return FORMATS[name]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it becomes NULL on the way in."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats}) if floats else df


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to BIGINT, DOUBLE or BOOLEAN where all known values allow it.

    One aggregate looks at all columns. Dates stay text: their formats are a matter of the
    date checks.
    """
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df
    wanted = []
    for i, name in enumerate(columns):
        c = quoted(name)
        whole = F.when(c.rlike(_WHOLE), F.trim(c).try_cast("bigint"))
        wanted += [F.count(c).alias(f"n{i}"), F.count(whole).alias(f"w{i}"),
                   F.count_if(c.rlike(_REAL)).alias(f"r{i}"), F.count_if(c.rlike(_TRUTH)).alias(f"b{i}")]
    seen = df.agg(*wanted).first()
    casts = {}
    for i, name in enumerate(columns):
        known = seen[f"n{i}"]
        kind = next((k for letter, k in (("w", "bigint"), ("r", "double"), ("b", "boolean"))
                     if known and seen[f"{letter}{i}"] == known), None)
        if kind:
            casts[name] = F.trim(quoted(name)).try_cast(kind)
    return df.withColumns(casts) if casts else df


def _read_csv(spark: SparkSession, path: str, schema, null_tokens, encoding: str, multi_line: bool | None, split_bytes: int) -> DataFrame:
    reader = spark.read.options(header=True, quote='"', escape='"', encoding=encoding, multiLine=multi_line is not False)
    raw = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    if multi_line is None and encoding.upper() in ("UTF-8", "UTF8") and _splits(spark, path, split_bytes):
        raw = read_csv_splits(spark, path, raw.schema, split_bytes)
    if schema is not None:
        return raw
    # all text; types are found after the missing values are known
    texts = [f.name for f in raw.schema if isinstance(f.dataType, T.StringType)]  # columns named by folders have types
    known = raw.withColumns({c: F.when(~quoted(c).isin(*null_tokens), quoted(c)) for c in texts})
    return infer_types(known)


def _splits(spark: SparkSession, path: str, split_bytes: int) -> bool:
    """Whether a file is larger than a split and can be cut. Compressed files are read from beginning to end, and folders whose names hold
    columns by Spark's reader, which knows these."""
    if largest_file(spark, path) <= split_bytes or path.rstrip("/*").lower().endswith(COMPRESSED):
        return False
    return spark.read.text(path).columns == ["value"]


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file starts as one array instead of one record per line."""
    pieces = spark.read.option("lineSep", "}").text(path)  # an array may be one line
    first = pieces.select(F.regexp_replace("value", r"^\s+", "").alias("v")).filter(F.length("v") > 0).limit(1).collect()
    return bool(first) and first[0]["v"].startswith("[")


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
                 null_tokens: tuple[str, ...] = NULL_TOKENS, encoding: str = "UTF-8",
                 multi_line: bool | None = None, split_bytes: int | None = None) -> DataFrame:
    """A frame from files of a known format.

    Give a ``schema`` for repeated jobs: it spares the pass that finds the types. Files above ``split_bytes`` (the session's
    split size) are read by many tasks also if they are CSV with line breaks inside quotes or one array of JSON records: see
    :mod:`sievelark.sources.splits`. Smaller ones are read whole, a task a file. ``multi_line=True`` reads every
    file whole; ``multi_line=False`` splits CSV at any line break, for data without breaks in quotes, and reads JSON as lines.
    Compressed files, folders with columns in their names and CSV in other encodings than UTF-8 are read whole. JSON lines and Parquet split over tasks.
    """
    kind = format_of(path, fmt)
    split_bytes = split_bytes or byte_setting(spark, "spark.sql.files.maxPartitionBytes")
    if kind == "csv":
        return nan_to_null(_read_csv(spark, path, schema, null_tokens, encoding, multi_line, split_bytes))
    if kind == "json":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        array = multi_line is True or (multi_line is None and _is_array(spark, path))
        if array and multi_line is None and _splits(spark, path, split_bytes):
            return nan_to_null(reader.json(array_to_lines(spark, path, split_bytes)))
        return nan_to_null(reader.option("multiLine", array).json(path))
    return nan_to_null(getattr(spark.read.schema(schema) if schema is not None else spark.read, kind)(path))


def read_json_values(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """JSON lines with each field as a variant, so that mixed types in a field stay visible."""
    parsed = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    return parsed.select(*[F.try_variant_get("v", f"$.{c}", "variant").alias(c) for c in columns])


def write_dataset(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error",
                  partition_by: list[str] | None = None) -> str:
    """Write ``df`` in parallel, one file per task; JSON goes out as one record per line.

    Text formats have no form for NaN: it is written as a missing value.
    """
    kind = format_of(path, fmt)
    if kind in ("csv", "json"):
        df = nan_to_null(df)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        getattr(writer, kind)(path)
    return path


def read_database_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                        lower: int | None = None, upper: int | None = None, parts: int = 1,
                        **options: str) -> DataFrame:
    """A table of an external database; a numeric column splits the scan into ``parts``."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column is not None:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
                                numPartitions=parts)
    return nan_to_null(reader.load())
