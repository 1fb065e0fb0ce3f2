"""Description of a dataset: shape, types, gaps, copies, numeric statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelark.functions import roles
from sievelark.functions.predicates import parse_date
from sievelark.plans.copies import HASHED_ROWS, count_copies
from sievelark.plans.longform import all_rows_distinct_counts, per_column, quoted
from sievelark.plans.moments import moments
from sievelark.plans.quantiles import QUANTILE_ROWS, collect_quantiles


def missing(c: Column) -> Column:
    return F.count_if(c.isNull())


def overview(df: DataFrame, hashed_rows: int = HASHED_ROWS) -> DataFrame:
    """One row: rows, columns, NULL cells and copies with their percentages.

    Two jobs: one narrow aggregate for sizes and gaps, then the copies.
    """
    sizes = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        sum((missing(quoted(c)) for c in df.columns), F.lit(0).cast("long")).alias("null_cells"),
    ).first()
    rows, nulls, width = sizes["total_rows"], sizes["null_cells"], len(df.columns)
    total = F.lit(rows).cast("long")
    return count_copies(df, rows=rows, hashed_rows=hashed_rows).select(
        total.alias("total_rows"), F.lit(width).cast("long").alias("total_columns"),
        F.lit(nulls).cast("long").alias("null_cells"),
        F.lit(round(100.0 * nulls / (rows * width), 2) if rows * width else 0.0).alias("null_percentage"),
        "duplicate_rows",
        F.coalesce(F.round(F.try_divide(F.col("duplicate_rows") * 100.0, total), 2), F.lit(0.0)).alias(
            "duplicate_percentage"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count, has_nulls)."""
    return per_column(df, df.columns, {"null_count": missing}).withColumn(
        "has_nulls", F.col("null_count") > 0
    )


def column_types(df: DataFrame) -> DataFrame:
    """(position, column, data_type, kind): the schema as a frame."""
    numeric, text = set(roles.numeric_columns(df)), set(roles.string_columns(df))
    kinds = [
        (i, c, t, "numeric" if c in numeric else "categorical" if c in text else "other")
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return df.sparkSession.createDataFrame(
        kinds, "position long, column string, data_type string, kind string"
    )


def unique_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, unique_values) without NULL; 0 for a column that is all NULL."""
    if approx:
        return per_column(df, df.columns, {"unique_values": F.approx_count_distinct})
    counted = all_rows_distinct_counts(df, df.columns)
    listed = column_types(df).select("column")
    return listed.join(counted, "column", "left").select(
        "column", F.coalesce("unique_values", F.lit(0)).cast("long").alias("unique_values")
    )


SUMMARY_SCHEMA = (
    "column string, count long, mean double, median double, std double, min double, max double, "
    "q25 double, q50 double, q75 double, skewness double, kurtosis double"
)


def numeric_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False,
                    limit: int = QUANTILE_ROWS) -> DataFrame:
    """count, mean, median, std (n-1), min, max, quartiles, skewness and kurtosis per column.

    All columns share two passes of plain sums for the moments, and the quantile passes.
    """
    columns = roles.existing(df, columns, roles.numeric_columns(df))
    found = moments(df, columns) if columns else {}
    rows = max((m.rows for m in found.values()), default=0)
    quartiles = collect_quantiles(df, columns, [0.25, 0.5, 0.75], approx=approx, rows=rows, limit=limit) if columns else {}
    listed = []
    for c, m in found.items():
        q25, q50, q75 = quartiles[c]
        listed.append((c, m.count, m.mean, q50, m.std, m.min, m.max, q25, q50, q75, m.skewness, m.kurtosis))
    return df.sparkSession.createDataFrame(listed, SUMMARY_SCHEMA)


def numeric_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """The profile's shorter list of numeric statistics."""
    return numeric_summary(df, approx=approx).select(
        "column", "mean", "median", "std", "min", "max", "q25", "q75"
    )


def suggested_types(df: DataFrame) -> DataFrame:
    """(column, suggested_type): integer, float, boolean, datetime, string or unknown.

    A text column is ``datetime`` when all its values parse, not only the first few.
    """
    def by_schema(kind: T.DataType) -> str:
        if isinstance(kind, T.BooleanType):
            return "boolean"
        if isinstance(kind, T.IntegralType):
            return "integer"
        if isinstance(kind, T.NumericType):
            return "float"
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        return "string"

    rows = []
    for f in df.schema:
        c = quoted(f.name)
        dates = F.count(parse_date(c)) if isinstance(f.dataType, T.StringType) else F.lit(-1).cast("long")
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(by_schema(f.dataType)).alias("kind"),
                             F.count(c).alias("known"), dates.alias("dates")))
    found = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    kind = (
        F.when(F.col("known") == 0, "unknown")
        .when(F.col("dates") == F.col("known"), "datetime")
        .otherwise(F.col("kind"))
    )
    return found.select("column", kind.alias("suggested_type"))


def column_summary(df: DataFrame) -> DataFrame:
    """Schema, kind and gaps per column: the short view of a dataset."""
    return column_types(df).join(null_counts(df), "column")


def profile(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """All parts of the profile by name."""
    return {
        "overview": overview(df),
        "columns": column_summary(df).join(unique_counts(df, approx), "column"),
        "numeric": numeric_stats(df, approx),
        "types": suggested_types(df),
    }


# --- tables known to the session ----------------------------------------------------


def table_stats(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(table, row_count) of the session's tables and views, in one job."""
    names = names if names is not None else [t.name for t in spark.catalog.listTables()]
    counted = None
    for name in names:
        one = spark.table(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("row_count"))
        counted = one if counted is None else counted.unionAll(one)
    return spark.createDataFrame([], "table string, row_count long") if counted is None else counted


def table_summary(spark: SparkSession, name: str, rows: int = 5) -> dict[str, DataFrame]:
    """Types, size and a few rows of one table; unknown names raise ``ValueError``."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table named {name!r}")
    df = spark.table(name)
    return {"columns": column_types(df), "size": table_stats(spark, [name]), "sample": df.limit(rows)}


def sample(df: DataFrame, rows: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """The first rows, 1 to 1000; deterministic when ``order_by`` decides the order."""
    if not 1 <= rows <= 1000:
        raise ValueError("rows must be between 1 and 1000")
    return (df.orderBy(*order_by) if order_by else df).limit(rows)
