"""Each query of the reference's operators against its SQL, on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(n for plan in entry._plans() for n in plan.SQL)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    return compare.oracle(SF)


@pytest.mark.parametrize("name", OWN)
def test_equals_sql(spark, db, name):
    assert not compare.differs(spark, db, name, entry.queries()[name], entry.oracle_sql()[name], SF)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
