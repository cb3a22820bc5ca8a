"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registry
from parity.check import open_tables, spark_bag, sql_bag

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


def test_every_query_has_sql():
    assert registry.library_queries().keys() <= registry.oracle_sql().keys()


@pytest.mark.parametrize("name", list(registry.library_queries()))
def test_same_rows(spark, con, name):
    columns, ours = spark_bag(spark, name, SF_DIR)
    sql_columns, theirs = sql_bag(con, name)
    assert columns == sql_columns
    assert ours == theirs
    assert sum(ours.values()) > 0


def test_entry_runs(spark):
    assert registry.entry(spark).count() == 4
