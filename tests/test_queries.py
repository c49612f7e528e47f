"""Every registered query runs, and gives what its SQL gives."""

import pytest

import __spark_entry__ as entry
from registry import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.oracle(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    ok, note = check.compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
