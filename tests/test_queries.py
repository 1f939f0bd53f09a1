"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import os

import pytest

from check_queries import compare, connect
from probeline.plans import load

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem, count = compare(spark, duck, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None, problem


def test_entry_runs(spark):
    import __spark_entry__ as entry_module

    found = entry_module.entry(spark).collect()
    assert {(r["k"], r["factor"]) for r in found} == {(k, f) for k in (10, 64) for f in (1, 2, 5)}
    assert all(0 <= r["recall"] <= 1 for r in found)
