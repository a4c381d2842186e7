"""Every registered query against its DuckDB counterpart, at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect
from workloads import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_market_query_has_a_counterpart():
    assert set(registry.QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    equal, _, note = compare(spark, con, queries()[name], oracle_sql()[name], SF_DIR)
    assert equal, note


def test_entry(spark):
    assert entry(spark).count() > 0
