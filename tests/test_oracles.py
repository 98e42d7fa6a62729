"""Every registered query with an oracle, on the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from check import compare, connect
from conftest import SF

ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    status, note, _ = compare(spark, con, SF, name)
    assert status == "OK", note


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry_module.queries())


def test_flagship(spark):
    out = entry_module.entry(spark)
    assert out.columns == ["user_id", "hr", "home", "fails", "amount"]
    assert 0 < out.count() <= 20
