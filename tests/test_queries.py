"""Every registered query with SQL gives the rows of that SQL; the others run."""

import os

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_against_sql(spark, con, name):
    assert compare(entry_module.queries()[name](spark, SF), con, entry_module.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(entry_module.oracle_sql())))
def test_runs(spark, name):
    df = entry_module.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
