"""Every named query against DuckDB, and the shape of the catalogue."""

from __future__ import annotations

import pytest

import __spark_entry__
from classatlas.plans import catalogue, oracles
from tests.compare import connect, mismatch

DIRECTORY = "/root/testdata/sf0.001"
EXPECTED = oracles.oracle_sql()
QUERIES = {name: query for name, query in __spark_entry__.queries().items() if name in catalogue.queries()}


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_query_has_expected_rows():
    assert set(QUERIES) == set(EXPECTED)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["simple_name", "fqn", "jar_path", "version"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert mismatch(QUERIES[name](spark, DIRECTORY), duck, EXPECTED[name]) is None
