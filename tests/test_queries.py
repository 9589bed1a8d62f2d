"""Every registered query against the SQL oracle on the smallest test tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from seriesloom.plans.queries import REGISTRY
from tests.support import same_values

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["events", "part", "orders", "conversations"]
ORACLE = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_each_query_has_an_oracle():
    assert set(REGISTRY) <= set(entry_point.queries())
    assert set(REGISTRY) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_oracle(spark, database, name):
    actual = entry_point.queries()[name](spark, SF_DIR).toPandas()
    assert len(actual) > 0
    assert same_values(actual, database.sql(ORACLE[name]).df()) == ""


def test_entry(spark):
    result = entry_point.entry(spark)
    counts = [r["series_count"] for r in result.select("series_count").collect()]
    assert counts == sorted(counts, reverse=True) and len(counts) == 862
