"""Registered queries with an oracle text, and which there are."""

import pytest

import __spark_entry__ as entry
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name]) == ""


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names if n in QUERIES] == list(range(1, 14))
    assert "pipeline" in entry.queries()
