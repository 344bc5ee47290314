"""Every query of the subpackage against its SQL; those without SQL must run."""

import pytest

from gridloom.llm import registry
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
        assert df.count() > 0


def test_splits_hold_every_row_once(spark):
    rows = registry.queries()["p1_splits"](spark, DATA)
    for t in ("features", "picp_per_design"):
        assert rows.where(f"source_table = '{t}'").count() == spark.read.parquet(f"{DATA}/{t}.parquet").count()
    assert rows.where("split is null").count() == 0


def test_each_group_has_one_split(spark):
    groups = registry.queries()["p1_groups"](spark, DATA)
    assert groups.count() == groups.select("group_id").distinct().count()
    rows = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("features", "picp_per_design"))
    assert groups.agg({"n_rows": "sum"}).first()[0] == rows
