"""Every registered query against its SQL on the smallest data; the others must give rows."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check import rows
from quirework.plans.fixtures import DRIVER_TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, SF_DIR)
    got = rows(frame.columns, frame.collect())
    assert got
    statement = entry.oracle_sql().get(name)
    if statement is not None:
        result = sql.execute(statement)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_parsed_ranges_drop_equal_rows_before_they_become_pages(spark):
    """what is shuffled is a row a text, not a row a page."""
    plan = entry.queries()["h1_parse_ranges_set"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
