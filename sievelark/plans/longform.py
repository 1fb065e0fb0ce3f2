"""One row per cell: the shape in which all columns share a single shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    """Column whose name may hold dots or other special characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """A text that is equal exactly when the values are equal."""
    kind = df.schema[name].dataType
    c = quoted(name)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")  # -0.0 becomes 0.0
    return c.cast("string")


def cells(df: DataFrame, columns: list[str], by: list[str] | None = None,
          as_type: str | None = None) -> DataFrame:
    """(by..., column, value) with NULL values dropped; text unless ``as_type`` is given."""
    by = list(by or [])
    shown = [
        (quoted(c).cast(as_type) if as_type else as_text(df, c)).alias(c) for c in columns
    ]
    keys = [F.col(b).alias(f"__by_{b}") for b in by]
    long = df.select(*keys, *shown).unpivot(
        [F.col(f"__by_{b}") for b in by], [quoted(c) for c in columns], "column", "value"
    )
    long = long.filter(F.col("value").isNotNull())
    return long.withColumnsRenamed({f"__by_{b}": b for b in by})


def _numbered_cells(df: DataFrame, columns: list[str], shown: list[Column]) -> DataFrame:
    """(place, value) with NULL values dropped; the place in ``columns`` is a small key."""
    pairs = [x for i, c in enumerate(shown) for x in (F.lit(i), c)]
    return df.select(F.stack(F.lit(len(columns)), *pairs).alias("place", "value")).filter(
        F.col("value").isNotNull())


def _named(place: str, columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(place) + 1).alias("column")


def value_counts(df: DataFrame, columns: list[str], as_type: str | None = None) -> DataFrame:
    """(column, value, count): one scan and one shuffle for all columns."""
    shown = [quoted(c).cast(as_type) if as_type else as_text(df, c) for c in columns]
    counted = _numbered_cells(df, columns, shown).groupBy("place", "value").agg(
        F.count(F.lit(1)).alias("count"))
    return counted.select(_named("place", columns), "value", "count")


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent values per column; ties by value.

    ``row_number() <= n`` lets Spark keep only ``n`` rows per column and task before the
    shuffle, so a column with very many values does not flood one task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)


def all_rows_distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unique_values) without NULL.

    Columns of one type are counted together and as they are, so numbers are not turned
    into text. Each column is read once; the first aggregation combines equal values
    before the shuffle.
    """
    by_type: dict[str, list[str]] = {}
    for c in columns:
        kind = df.schema[c].dataType
        plain = not isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
        by_type.setdefault(kind.simpleString() if plain else "text", []).append(c)
    counted = None
    for kind, group in by_type.items():
        shown = [as_text(df, c) if kind == "text" else quoted(c) for c in group]
        one = (
            _numbered_cells(df, group, shown).groupBy("place", "value").agg(F.lit(1).alias("seen"))
            .groupBy("place").agg(F.count("seen").alias("unique_values"))
            .select(_named("place", group), "unique_values")
        )
        counted = one if counted is None else counted.unionAll(one)
    return counted


def per_column(df: DataFrame, columns: list[str], metrics: dict) -> DataFrame:
    """(column, metric...) with one row per column, from a single aggregate over ``df``.

    ``metrics`` maps a result name to a function from Column to aggregate Column.
    """
    rows = [
        F.struct(F.lit(c).alias("column"), *[make(quoted(c)).alias(name) for name, make in metrics.items()])
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
