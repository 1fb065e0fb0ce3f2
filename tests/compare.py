"""Run registered queries against their SQL in DuckDB: python tests/compare.py [name-part ...]"""

from __future__ import annotations

import datetime
import os
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value):
    """One form for a value from either engine."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, db, name, query, sql, sf_dir) -> str | None:
    """None when both engines agree on columns, types in kind, and rows."""
    df = query(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    want = bag(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if t in same and same[t] != kinds[c]]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, columns {sorted(names)}: {wrong[:3]}"
    return f"types {odd}" if odd else None


def main(parts: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as registered

    from sievelark.session import build_session

    spark = build_session("compare", os.environ.get("COMPARE_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    db, oracles, bad = connect(sf_dir), registered.oracle_sql(), 0
    for name, query in registered.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            found = difference(spark, db, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # show the failure and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        label = "ok" if found is None else "BAD"
        if found is None and name not in oracles:
            label = "rows"
        print(f"{label:4} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
