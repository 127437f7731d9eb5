"""Every registered query against its SQL on the given tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from workload import compare  # noqa: E402

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


def test_every_query_of_the_library_has_an_oracle():
    from workload.queries import QUERIES as own

    assert set(own) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, small, con, name):
    assert compare.differences(QUERIES[name](spark, small), con, ORACLES[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
