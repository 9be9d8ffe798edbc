"""Registered queries against their SQL twins on the smallest tables."""

import pytest
from oracle import compare, connect

from bindings.all import QUERIES, SQL

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
# Checked by tests/oracle.py; their plans take long to compile however small the tables are.
SLOW = {"virtual_relations", "virtual_relations_of_table"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_entry(spark):
    assert entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query(spark, con, name):
    # Some alerts never fire on the smallest tables.
    problems = compare(spark, con, queries()[name], oracle_sql()[name], SMALL)
    assert [p for p in problems if p != "no rows"] == []


def test_every_own_query_has_sql():
    """Only training-data queries may lack SQL; their brute-force versions are in the tests of that subpackage."""
    assert set(QUERIES) == set(SQL) and set(oracle_sql()) <= set(queries())
