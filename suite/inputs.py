"""Input frames of the registered queries and the same inputs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUDGE = 0.00003
"""Amounts have four decimals, so many lie exactly on a half cent, where the last bit of a
sum decides how it rounds. A shift smaller than the last decimal keeps them off it."""


def rounded(df: DataFrame, places: int = 2, nudge: float = NUDGE) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show in the comparison."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c) + nudge, places) for c in doubles})


def nudged(sql: str) -> str:
    """``near(x, 2)`` in the SQL stands for the rounding that :func:`rounded` does."""
    return sql.replace("near(", f"round({NUDGE:.5f} + ")


def dated(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps that hold whole days, as dates."""
    return df.withColumns({c: F.to_date(c) for c in columns})


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its customer, product and region.

    Orders find their customer first, so a large order table is joined before the lines are, and the lines
    go through a shuffle once for their order and once for their product.
    """
    line, orders, customer, nation, region, part = (
        table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")
    )
    price = F.col("l_extendedprice")
    priced = line.select("l_orderkey", "l_partkey", "l_quantity", (price * (1 - F.col("l_discount"))).alias("amount"),
                         (price * (0.6 + F.col("l_tax"))).alias("cost"))
    ordered = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        priced.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"), F.col("r_name").alias("region"),
            "amount", "cost", F.col("l_quantity").alias("quantity"), F.col("o_orderdate").alias("transaction_date"),
        )
    )


TRANSACTIONS_SQL = """
t AS (
  SELECT o_custkey AS customer_id, c_name AS customer_name, l_partkey AS product_id,
         p_name AS product_name, p_type AS category, r_name AS region,
         l_extendedprice * (1 - l_discount) AS amount, l_extendedprice * (0.6 + l_tax) AS cost,
         l_quantity AS quantity, o_orderdate AS transaction_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""

# The same text runs in Spark and in DuckDB.
DIRTY_SQL = """
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 11 = 0 THEN concat('  ', upper(c_name), ' ') ELSE c_name END AS name,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
         WHEN c_custkey % 17 = 0 THEN concat('user', c_custkey, '.example.com')
         WHEN c_custkey % 19 = 0 THEN concat('User', c_custkey, '@Example.COM')
         ELSE concat('user', c_custkey, '@example.com') END AS email,
    CASE WHEN c_custkey % 23 = 0 THEN '12345'
         ELSE concat('+1212555', lpad(concat(c_custkey % 10000, ''), 4, '0')) END AS phone,
    CASE WHEN c_custkey % 29 = 0 THEN 'not a date'
         WHEN c_custkey % 3 = 0 THEN concat('2024/', 1 + c_custkey % 12, '/', 1 + c_custkey % 28)
         WHEN c_custkey % 3 = 1 THEN concat(1 + c_custkey % 28, '-', 1 + c_custkey % 12, '-2024')
         ELSE concat('2024-', 1 + c_custkey % 12, '-', 1 + c_custkey % 28) END AS created_date,
    CASE WHEN c_custkey % 31 = 0 THEN 'n/a' ELSE concat(c_custkey % 1000, '.5') END AS balance_text,
    concat(c_custkey % 1000, '.25') AS score_text,
    CASE WHEN c_custkey % 37 = 0 THEN -1 ELSE CAST(c_custkey % 50 AS INT) END AS quantity,
    CASE WHEN c_custkey % 7 = 0 THEN NULL
         WHEN c_custkey % 41 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS amount,
    CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment)
         WHEN c_custkey % 5 = 1 THEN concat(' ', c_mktsegment) ELSE c_mktsegment END AS category
  FROM {customer}"""

DIRTY_CTE = f"""
base AS ({DIRTY_SQL.format(customer="customer")}),
d AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE id % 50 = 0)"""


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with deterministic damage: gaps, bad values, padded text, copies."""
    base = spark.sql(DIRTY_SQL.format(customer="{customer}"), customer=table(spark, sf_dir, "customer"))
    return base.unionByName(base.filter(F.col("id") % 50 == 0))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per day: the series of the trend, spike and forecast queries."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )


DAILY_CTE = """
daily AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total
          FROM orders GROUP BY 1)"""
