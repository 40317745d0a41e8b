"""Every registered query against its DuckDB statement, on whole tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from carbonsplit.plans.catalog import registered
from carbonsplit.plans.oracle import statements

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered()
STATEMENTS = statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def comparable(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in found]
    return sorted(picked, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", QUERIES)
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(STATEMENTS[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.collect(), df.columns) == comparable(result.fetchall(), columns)


def test_every_operator_has_queries_and_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert {name[:3] for name in QUERIES} == {f"d{i:02d}" for i in range(1, 53)} | {"p02"}


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
