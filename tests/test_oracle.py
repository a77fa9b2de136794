"""Every registered query against its SQL on DuckDB."""

import os

import pytest

import __spark_entry__ as registry
from compare import connect, differences
from workload.oracle import ORACLE_SQL
from workload.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_all_are_registered():
    assert QUERIES.items() <= registry.queries().items()
    assert ORACLE_SQL.items() <= registry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, duck, ORACLE_SQL[name]) == []


def test_entry(spark):
    assert registry.entry(spark).count() > 0
