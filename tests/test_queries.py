"""Every query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_agrees_with_sql(spark, db, name):
    df = entry_points.queries()[name](spark, FOLDER)
    got = normal(df.collect(), df.columns)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    want = normal(result.fetchall(), columns)
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
