"""The operators that SQL can express, against DuckDB at the smallest scale."""

from __future__ import annotations

import pytest

from tests.compare import compare, connect
from tickloom.llm.oracles import ORACLES
from tickloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    equal, _, note = compare(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR)
    assert equal, note
