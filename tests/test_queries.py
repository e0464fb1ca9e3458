"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry_points
from tallyguard.plans.oracle import ORACLE
from tallyguard.plans.queries import QUERIES

from .compare import connect, differences
from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert differences(entry_points.queries()[name](spark, SMALL), duck, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["provider", "week", "cost_usd", "events"]
