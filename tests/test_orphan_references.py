from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from gridloom.operators.orphan_references import _block, bloom_blocks, filter_blocks, may_contain, merged_periods, orphan_references

REF = "id long, g string, k string, t timestamp_ntz"
PAR = "g string, k string, a timestamp_ntz, b timestamp_ntz"


def day(n):
    return D(2024, 1, n)


def run(spark, refs, parents, **kw):
    out = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), ["g", "k"], "t", "a", "b", **kw)
    return sorted((r.id, r.reason) for r in out.collect())


PARENTS = [("d", "x", day(2), day(5)), ("d", "x", day(2), day(5)), ("d", "x", day(4), day(8)), ("d", "x", day(10), None), ("d", "n", None, None), ("e", "y", day(3), day(3))]


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_reasons(spark, most):
    refs = [(1, "d", "x", day(2)), (2, "d", "x", day(7)), (3, "d", "x", day(8)), (4, "d", "x", day(1)), (5, "d", "x", day(20)), (6, "d", "q", day(3)), (7, None, "x", day(3)), (8, "d", None, day(3)), (9, "d", "x", None), (10, "d", "n", day(9)), (11, "e", "y", day(3)), (12, "e", "x", day(3)), (6, "d", "q", day(3))]
    assert run(spark, refs, PARENTS, max_broadcast=most) == [(3, "deleted"), (4, "late"), (6, "missing"), (6, "missing"), (7, "missing"), (9, "deleted"), (10, "deleted"), (11, "deleted"), (12, "missing")]


def test_empty(spark):
    assert run(spark, [(1, "d", "x", day(2))], []) == [(1, "missing")]
    assert run(spark, [], PARENTS) == []
    with pytest.raises(ValueError):
        orphan_references(spark.createDataFrame([], REF + ", reason string"), spark.createDataFrame([], PAR), ["g", "k"], "t", "a", "b")


def test_periods_are_disjoint(spark):
    got = merged_periods(spark.createDataFrame(PARENTS, PAR), ["g", "k"], "a", "b").orderBy("_o_from").collect()
    assert [(r._o_from, r._o_to.year) for r in got] == [(day(2), 2024), (day(10), 9999)]


def test_filter_follows_its_keys(spark):
    assert filter_blocks(0) == 1 and filter_blocks(10**9) * 4096 == pytest.approx(1.25 * 10**9, rel=0.01)
    n = 20_000
    blocks = filter_blocks(n)
    keys = spark.range(2 * n).selectExpr("cast(id as string) k")
    bloom = bloom_blocks(keys.where(f"cast(k as int) < {n}"), ["k"], blocks)
    sizes = bloom.selectExpr("count(*) n", "min(size(_o_words)) a", "max(size(_o_words)) b").first()
    assert (sizes.n, sizes.a, sizes.b) == (blocks, 512, 512)
    key = [F.col("k")]
    tested = keys.withColumn("at", _block(key, blocks)).join(bloom, F.col("at") == F.col("_o_block"), "left").select(F.col("k").cast("int").alias("k"), may_contain(F.col("_o_words"), key).alias("held"))
    got = tested.groupBy((F.col("k") < n).alias("real")).agg(F.count_if("held").alias("held")).collect()
    held = {r.real: r.held for r in got}
    assert held[True] == n and held[False] < 0.03 * n
