"""The registered queries run, and a few give what DuckDB gives (tests/compare.py runs all)."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as registered
from tests.compare import connect, difference
from tests.conftest import SF

SPOT = ["q06_customer_retention", "q16_running_total_sales", "q17_sales_rank_split", "f10_f11_f12_quality_score",
        "c07_cleaning_chain", "c02d_forward_fill_split", "e09_insights", "m05_linear_metrics", "a03_iqr_by_type_search"]


def test_names():
    queries, oracles = registered.queries(), registered.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 140


def test_import_needs_no_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", SPOT)
def test_spot(spark, name):
    found = difference(spark, connect(SF), name, registered.queries()[name], registered.oracle_sql()[name], SF)
    assert found is None
