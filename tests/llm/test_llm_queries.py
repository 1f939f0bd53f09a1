"""The queries of this subpackage that SQL can state, against DuckDB at the smallest scale."""

import pytest

from check_queries import compare, connect
from probeline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    problem, _ = compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None, problem


def test_all_operators_have_a_query():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 11))
