"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.compare import TABLES, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_twins_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = entry_points.queries()[name](spark, sf_dir)
    result = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
