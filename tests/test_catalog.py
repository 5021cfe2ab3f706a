"""Every registered query against its SQL, over the whole smallest test tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402
from watchlake.plans.catalog import ORACLES, QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, database, name):
    result = contract.queries()[name](spark, FOLDER)
    answer = database.sql(contract.oracle_sql()[name])
    names = sorted(result.columns)
    assert names == sorted(answer.columns)
    got = sorted((tuple(row[n] for n in names) for row in result.collect()), key=repr)
    places = [answer.columns.index(n) for n in names]
    expected = sorted((tuple(row[p] for p in places) for row in answer.fetchall()), key=repr)
    assert got == expected and got


def test_entry(spark):
    assert contract.entry(spark).count() > 0
