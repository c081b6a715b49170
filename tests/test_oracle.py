"""Every catalog query against its oracle text on the smallest tables."""

import pytest

from tests.conftest import SMALL
from tests.oracle import compare, connect

import __spark_entry__ as entry
from ledgerloom.plans.catalog import QUERIES

# The full model comparisons are covered by tests/test_models.py on fewer models.
SLOW = {"fit_candidates", "model_comparison", "refit_best"}
NAMES = [n for n in QUERIES if n not in SLOW]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["order_year", "order_month"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
