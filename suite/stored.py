"""Sources, sinks, projections, SQL by text, registry and run history."""

from __future__ import annotations

import uuid

from functools import reduce

import pandas as pd
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from sievelark.functions import roles
from sievelark.operators import catalog, cleaning, incremental, kpi
from sievelark.plans.rowid import with_row_index
from sievelark.plans.shared import shared_dir
from sievelark.sources import files
from sievelark.sources.registry import Registry, export_report, paged
from sievelark.sources.splits import largest_file
from suite.cleaning import DATE_TRIES
from suite.inputs import DIRTY_CTE, TRANSACTIONS_SQL, dirty_customers, nudged, rounded, table, transactions

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _place(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _round_trip(name, fmt):
    """Write a table, read it back with the types found in the file, all columns and rows."""
    def query(spark, sf):
        path = files.write_dataset(table(spark, sf, name), _place(spark, f"{name}.{fmt}"), fmt)
        back = files.read_dataset(spark, path, fmt)
        return rounded(back.select(*sorted(back.columns)), 2, 0.0)
    return query


_SUPPLIER = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier"
_add("s01_s04_csv_round_trip", _round_trip("supplier", "csv"), _SUPPLIER)
_add("s02_s05_json_round_trip", _round_trip("supplier", "json"), _SUPPLIER)
_add("s03_parquet_round_trip", _round_trip("supplier", "parquet"),
     "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")


def _csv_with_gaps(spark, sf):
    """Damaged customers through CSV: gaps stay gaps, the text ``n/a`` is read as one."""
    path = files.write_dataset(dirty_customers(spark, sf), _place(spark, "dirty"), "csv")
    back = files.read_dataset(spark, path, "csv")
    return rounded(back.withColumn("phone", F.col("phone").cast("string")), 2, 0.0)


_add("s01_csv_line_breaks", _round_trip("documents", "csv"), "SELECT doc_id, text, lang, source, n_chars FROM documents")


def _split_csv(spark, sf):
    """Texts with line breaks inside quotes, each file read by 16 tasks."""
    path = files.write_dataset(table(spark, sf, "documents"), _place(spark, "documents"), "csv")
    back = files.read_dataset(spark, path, "csv", split_bytes=max(1, largest_file(spark, path) // 16))
    return back.select(*sorted(back.columns))


_add("s01_csv_line_breaks_split", _split_csv, "SELECT doc_id, text, lang, source, n_chars FROM documents")


def _as_arrays(batches):
    """Records as one array a file."""
    first = True
    for frame in batches:
        frame["value"] = (("[" if first else ",") + frame["value"]).where(frame.index == 0, "," + frame["value"])
        first = False
        yield frame
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def _split_arrays(spark, sf):
    """JSON arrays, each file read by 16 tasks."""
    docs = table(spark, sf, "documents")
    path = _place(spark, "arrays")
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).mapInPandas(_as_arrays, "value string").write.text(path)
    back = files.read_dataset(spark, path, "json", split_bytes=max(1, largest_file(spark, path) // 16))
    return back.select(*sorted(back.columns))


_add("s02_json_array_split", _split_arrays, "SELECT doc_id, text, lang, source, n_chars FROM documents")


_add("s01_csv_null_tokens", _csv_with_gaps, f"""WITH {DIRTY_CTE.strip()}
SELECT id, name, email, CAST(CAST(phone AS BIGINT) AS VARCHAR) AS phone, created_date, category,
  round(try_cast(balance_text AS DOUBLE), 2) AS balance_text, round(CAST(score_text AS DOUBLE), 2) AS score_text,
  CAST(quantity AS BIGINT) AS quantity, round(amount, 2) AS amount FROM d""")


def _exported(spark, sf):
    transactions(spark, sf).createOrReplaceTempView("transactions")
    path = export_report(spark, "sales_by_region", _place(spark, "report"), "json")
    return rounded(files.read_dataset(spark, path, "json"))


_add("s08_exported_report", _exported, nudged(f"""WITH {TRANSACTIONS_SQL.strip()}
SELECT region, count(*) AS transaction_count, near(sum(amount), 2) AS total_sales, near(avg(amount), 2) AS avg_sale,
  near(min(amount), 2) AS min_sale, near(max(amount), 2) AS max_sale FROM t GROUP BY region"""))


def _sql(spark, sf):
    transactions(spark, sf).createOrReplaceTempView("transactions")
    return rounded(catalog.run_sql(spark, """
        WITH big AS (SELECT category, region, amount FROM transactions WHERE amount > :least)
        SELECT category, region, count(*) AS n, sum(amount) AS total FROM big GROUP BY category, region
        ORDER BY category, region""", {"least": 20000}))


_add("s09_sql_text", _sql, nudged(f"""WITH {TRANSACTIONS_SQL.strip()}
SELECT category, region, count(*) AS n, near(sum(amount), 2) AS total FROM t WHERE amount > 20000 GROUP BY 1, 2"""))


def _sql_total(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return catalog.sql_total(spark, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")


def _sql_all_rows(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return catalog.run_sql(spark, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 5")


_add("s09_sql_all_rows", _sql_all_rows, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 5")
_add("s09_sql_total_rows", _sql_total, "SELECT count(DISTINCT o_custkey) AS total_rows FROM orders")
_add("t05_page", lambda spark, sf: paged(
    table(spark, sf, "orders").select("o_orderkey", "o_orderdate").withColumn("o_orderdate", F.to_date("o_orderdate")),
    "o_orderdate", 3, 25, True, ["o_orderkey"]), """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
_add("t11_chosen_sort", lambda spark, sf: paged(
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_size", 1, 40, False, ["p_partkey"]),
    "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size, p_partkey LIMIT 40")
_add("t03_latest_per_key", lambda spark, sf: table(spark, sf, "events").groupBy("user_id").agg(
    F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("events")),
    "SELECT user_id, arg_max(event_id, ROW(ts, event_id)) AS event_id, count(*) AS events FROM events GROUP BY 1")
_add("j01_numeric_columns", lambda spark, sf: _only_numbers(table(spark, sf, "supplier")),
     "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
_add("j02_existing_columns", lambda spark, sf: _chosen(table(spark, sf, "supplier"), ["s_acctbal", "missing", "s_name"]),
     "SELECT s_suppkey, s_acctbal FROM supplier")
_add("j08_drop_missing", lambda spark, sf: rounded(dirty_customers(spark, sf).dropna(subset=["amount"]).select(
    "id", "email", "amount"), 4, 0.0),
    f"WITH {DIRTY_CTE.strip()} SELECT id, email, round(amount, 4) AS amount FROM d WHERE amount IS NOT NULL")


def _only_numbers(df):
    return df.select(*roles.numeric_columns(df))


def _chosen(df, wanted):
    return df.select("s_suppkey", *roles.existing(df, wanted, roles.numeric_columns(df)))


def _first_in_file_order(spark, sf):
    """First row of each key in a filtered scan, by its place in the file."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").filter("o_orderkey % 3 = 0")
    return cleaning.remove_duplicates(rows, ["o_custkey"], "first")


_add("c01_first_in_file_order", _first_in_file_order, """
WITH f AS (SELECT o_orderkey, o_custkey, row_number() OVER () AS i FROM orders)
SELECT arg_min(o_orderkey, i) AS o_orderkey, o_custkey FROM f WHERE o_orderkey % 3 = 0 GROUP BY o_custkey""")
_add("s10_row_index_filtered", lambda spark, sf: with_row_index(
    table(spark, sf, "customer").select("c_custkey").filter("c_custkey % 7 = 2")), """
SELECT c_custkey, row_number() OVER (ORDER BY i) - 1 AS row_index
FROM (SELECT c_custkey, row_number() OVER () AS i FROM customer) WHERE c_custkey % 7 = 2""")
_add("s10_row_index", lambda spark, sf: with_row_index(table(spark, sf, "customer").select("c_custkey")),
     "SELECT c_custkey, row_number() OVER () - 1 AS row_index FROM customer")


# --- registry and history -----------------------------------------------------------


def _registry(spark, sf):
    """Three registered datasets, two of them validated twice."""
    registry = Registry(spark, _place(spark, "registry"))
    ids = {}
    for name in ("supplier", "part", "customer"):
        ids[name] = registry.register(name, f"{sf}/{name}.parquet")
    registry.validate_all([ids["supplier"], ids["part"]])
    registry.validate(ids["part"])
    return registry, ids


def _history(spark, sf):
    registry, ids = _registry(spark, sf)
    names = registry.datasets().select("dataset_id", "name")
    runs = registry.runs("validation").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("runs"))
    last = registry.latest("validation").select("dataset_id", "total_rows", "total_columns", "duplicate_rows", "status")
    return names.join(runs, "dataset_id").join(last, "dataset_id").drop("dataset_id")


_add("s11_s12_t03_validation_history", _history, """
SELECT 'supplier' AS name, CAST(1 AS BIGINT) AS runs, count(*) AS total_rows, CAST(4 AS BIGINT) AS total_columns,
  CAST(0 AS BIGINT) AS duplicate_rows, 'completed' AS status FROM supplier
UNION ALL SELECT 'part', 2, count(*), 6, 0, 'completed' FROM part""")


def _batch(spark, sf):
    registry, ids = _registry(spark, sf)
    done = registry.validate_all([*ids.values(), "unknown"])
    names = registry.datasets().select("dataset_id", "name", F.col("total_rows").alias("rows"))
    return done.join(names, "dataset_id", "left").select(
        F.coalesce("name", "dataset_id").alias("name"), "ok", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


_add("s12_batch_validation", _batch, """
SELECT 'supplier' AS name, true AS ok, count(*) AS rows FROM supplier UNION ALL
SELECT 'part', true, count(*) FROM part UNION ALL SELECT 'customer', true, count(*) FROM customer UNION ALL
SELECT 'unknown', false, 0""")


def _summary(spark, sf):
    registry, ids = _registry(spark, sf)
    return registry.quality_summary(ids["part"]).select(
        "dataset_name", "completeness", "uniqueness", "consistency", "validity", "total_rows", "total_columns")


_add("f14_n07_quality_summary", _summary, """
SELECT 'part' AS dataset_name, 100.0::DOUBLE AS completeness, 100.0::DOUBLE AS uniqueness,
  100.0::DOUBLE AS consistency, 100.0::DOUBLE AS validity, count(*) AS total_rows,
  CAST(6 AS BIGINT) AS total_columns FROM part""")


def _portfolio(spark, sf):
    registry, _ = _registry(spark, sf)
    scores = [r.quality_score or 0.0 for r in registry.datasets().collect()]
    found = rounded(kpi.portfolio(registry.datasets()), 2, 0.0)
    return found.withColumn("average_quality", F.abs(F.col("average_quality") - sum(scores) / len(scores)) < 0.01)


_add("k05_portfolio", _portfolio, "SELECT count(*) AS datasets, count(*) - 1 AS validated, true AS average_quality "
     "FROM (SELECT DISTINCT k FROM (SELECT 'a' AS k FROM supplier UNION ALL SELECT 'b' FROM part UNION ALL "
     "SELECT 'c' FROM customer))")


def _cleaned(spark, sf):
    """Clean a damaged CSV dataset through the registry and read the written result."""
    registry = Registry(spark, _place(spark, "registry"))
    path = files.write_dataset(dirty_customers(spark, sf), _place(spark, "dirty"), "parquet")
    dataset = registry.register("dirty", path, "parquet")
    run = registry.clean(dataset)
    out = registry.export_cleaned(run["run_id"], _place(spark, "export"), "json")
    back = files.read_dataset(spark, out, "json").withColumn("created_date", F.to_date("created_date"))
    return rounded(back, 4, 0.0)


def _strip(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_add("c08_s07_cleaning_run", _cleaned, f"""WITH {DIRTY_CTE.strip()}, u AS (SELECT DISTINCT * FROM d)
SELECT id, lower({_strip('name')}) AS name, lower({_strip('email')}) AS email, {_strip('phone')} AS phone,
  CAST(coalesce({DATE_TRIES.format(c=_strip('created_date'))}) AS DATE) AS created_date, {_strip('balance_text')} AS balance_text,
  {_strip('score_text')} AS score_text, CAST(quantity AS BIGINT) AS quantity,
  round(coalesce(amount, (SELECT avg(amount) FROM u)), 4) AS amount, lower({_strip('category')}) AS category FROM u""")


def _cleaned_documents(spark, sf):
    """Texts with line breaks through a cleaning run, all columns; what the run stored, what its CSV holds."""
    registry = Registry(spark, _place(spark, "registry"))
    dataset = registry.register("documents", f"{sf}/documents.parquet", describe=False)
    run = registry.clean(dataset)
    stored, written = registry.cleaned(run["run_id"]), files.read_dataset(spark, run["output_path"], "csv")
    return stored.withColumn("place", F.lit("table")).unionByName(written.withColumn("place", F.lit("csv")))


_add("c08_cleaning_documents", _cleaned_documents, r"""
WITH u AS (SELECT DISTINCT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, lang, source, n_chars FROM documents)
SELECT *, 'table' AS place FROM u UNION ALL SELECT *, 'csv' FROM u""")


def _incremental(spark, sf):
    """Orders in two appends: the second update scans the new files alone, the profile is that of all rows."""
    place, state = _place(spark, "grown"), _place(spark, "state")
    orders, seen = table(spark, sf, "orders"), []
    for part in (0, 1):
        orders.filter(F.col("o_orderkey") % 2 == part).write.mode("append").parquet(place)
        before = seen[-1][0] if seen else 0
        files_now = incremental.files_of(spark, place).filter(F.col("file").endswith(".parquet")).count()
        seen.append((files_now, incremental.update(spark, place, state) == files_now - before))
    again = incremental.update(spark, place, state) == 0
    found = incremental.profile(spark, place, state)
    near = F.abs(F.col("distinct_estimate") / F.lit(orders.count()) - 1) < 0.05
    return rounded(found.select(
        "column", "kind", "rows", "nulls", "mean", "std", "least", "largest", "suggested",
        F.when(F.col("column") == "o_orderkey", near).alias("distinct_is_near"), F.lit(seen[1][1] and again).alias("new_files_only")), 3, 0.0)


_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice")
_add("p01_p08_incremental_profile", _incremental, " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", 'numeric' AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, round(avg({c}), 3) AS mean,
  round(stddev_samp({c}), 3) AS std, round(min({c})::DOUBLE, 3) AS least, round(max({c})::DOUBLE, 3) AS largest, 'numeric' AS suggested,
  {'true' if c == 'o_orderkey' else 'NULL::BOOLEAN'} AS distinct_is_near, true AS new_files_only FROM orders""" for c in _NUMERIC]
    + [f"""SELECT c.column_name, CASE WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'other' END, n.n, 0, NULL, NULL, NULL, NULL,
  CASE WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'other' END, NULL, true FROM (DESCRIBE orders) AS c, (SELECT count(*) AS n FROM orders) AS n
  WHERE c.column_name NOT IN {_NUMERIC}""".replace("data_type", "column_type")]))


def _refused(spark, sf):
    """How many commands against an existing view are refused by the parser, and the rows the view has afterwards."""
    view = f"guarded_{uuid.uuid4().hex}"
    table(spark, sf, "nation").createOrReplaceTempView(view)
    commands = (f"DROP VIEW {view}", f"INSERT INTO {view} SELECT * FROM {view}", f"CREATE OR REPLACE TEMP VIEW {view} AS SELECT 1",
                f"SELECT * FROM {view}); DROP VIEW {view}; SELECT (1", f"TRUNCATE TABLE {view}", "SET spark.sql.ansi.enabled = false")
    refused = 0
    for command in commands:
        try:
            catalog.run_sql(spark, command).collect()
        except ParseException:
            refused += 1
    left = catalog.run_sql(spark, f"WITH created_at AS (SELECT * FROM {view}) SELECT * FROM created_at ORDER BY 1").count()
    spark.catalog.dropTempView(view)
    return refused, left


def _stored_lookups(spark, sf):
    """Search by name, runs by status, history and a run by its id, all through the registry."""
    registry, ids = _registry(spark, sf)
    page, total = registry.page(1, 10, search="PAR", order_by="name")
    runs = registry.history("validation", ids["part"], 1).collect()
    again = registry.run("validation", runs[0]["run_id"])
    exported = files.read_dataset(spark, registry.export(ids["supplier"], _place(spark, "export"), "parquet"), "parquet")
    counts = [(page, "f18_name_search"), (registry.find_runs("validation", dataset_id=ids["part"]), "f23_runs_of_a_dataset"),
              (registry.history("validation", ids["part"], 1), "t04_history_of_one"), (again, "t10_run_by_id"), (exported, "s06_export")]
    parts = [frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("lookup"), "rows") for frame, name in counts]
    shown = reduce(lambda a, b: a.unionByName(b), parts)
    refused, kept = _refused(spark, sf)
    return shown.unionByName(spark.createDataFrame([("f21_commands_refused", refused), ("f21_rows_left", kept), ("f18_total", total)], "lookup string, rows long"))


_add("s06_f18_f21_f23_t04_t10_lookups", _stored_lookups, """
SELECT 'f18_name_search' AS lookup, CAST(1 AS BIGINT) AS rows UNION ALL SELECT 'f18_total', 1 UNION ALL
SELECT 'f23_runs_of_a_dataset', 2 UNION ALL SELECT 't04_history_of_one', 1 UNION ALL SELECT 't10_run_by_id', 1 UNION ALL
SELECT 'f21_commands_refused', 6 UNION ALL SELECT 'f21_rows_left', count(*) FROM nation UNION ALL SELECT 's06_export', count(*) FROM supplier""")


def _catalog(spark, sf):
    """How many reports have a name and a definition, how many a search for a column name finds, and the rows of one run by name."""
    transactions(spark, sf).createOrReplaceTempView("transactions")
    listed = catalog.listing(spark).filter("text <> ''").agg(F.count(F.lit(1)).alias("reports"))
    return listed.withColumns({
        "with_region_sales": F.lit(len([n for n in catalog.search("avg_sale", in_text=True) if n.startswith("sales_by_")])).cast("long"),
        "regions": catalog.run(spark, "sales_by_region").agg(F.count(F.lit(1))).scalar()})


_add("catalog_names_and_texts", _catalog, f"""WITH {TRANSACTIONS_SQL.strip()}
SELECT CAST(29 AS BIGINT) AS reports, CAST(2 AS BIGINT) AS with_region_sales, count(DISTINCT region) AS regions FROM t""")


def _analysis(spark, sf):
    registry = Registry(spark, _place(spark, "registry"))
    dataset = registry.register("lineitem", f"{sf}/lineitem.parquet", describe=False)
    registry.analyse(dataset)
    lines = registry.latest_insights(dataset)
    return spark.createDataFrame([(t,) for t in lines if t.startswith("text columns") or " rows in " in t], "insight string")


_add("e13_t04_stored_insights", _analysis, """
SELECT concat(count(*), ' rows in 11 columns') AS insight FROM lineitem
UNION ALL SELECT concat('text columns: ', count(DISTINCT k)) FROM
  (SELECT unnest(['l_returnflag', 'l_linestatus']) AS k FROM lineitem)""")
