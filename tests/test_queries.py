"""Every query of the core against its SQL on the smallest data; those without SQL must run and give rows."""

import pytest

from gridloom.plans import registry
from tests.oracle import connect, same

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.columns
        df.limit(5).collect()


def test_names_and_sql_agree():
    assert set(SQL) <= set(registry.queries())


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0


def test_figures(spark):
    assert set(registry.FIGURE_DATA.values()) <= set(registry.queries())
    assert registry.figure(spark, DATA, "power law").columns
