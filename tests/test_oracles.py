"""Every registered query with comparison SQL gives the SQL's rows."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, key):
    assert difference(spark, SMALL, QUERIES[key], ORACLES[key]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
