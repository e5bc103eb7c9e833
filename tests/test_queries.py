"""Every registered query against its SQL counterpart, value by value."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, SF) == ""


def test_comparison_notices_a_difference(spark, duck, monkeypatch):
    from checks import compare as module

    wrong = module.ORACLE["avg_cycle"].replace("avg_cycle_hours FROM", "avg_cycle_hours + 1e-9 AS avg_cycle_hours FROM")
    monkeypatch.setitem(module.ORACLE, "avg_cycle", wrong)
    assert compare(spark, duck, "avg_cycle", SF) != ""
