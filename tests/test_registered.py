"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from workload import reference_sql, registry


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert registry.queries().keys() == reference_sql.oracle_sql().keys()
    assert registry.queries().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SMALL)
    result = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == sorted(map(repr, result.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
