import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm.top_per_group import top_per_group

SCHEMA = "g string, h string, s double, y int, x int, extra string"


def brute(rows, n):
    best = {}
    for g, h, s, y, x, _ in rows:
        if None in (g, h, s, y, x) or not 0 <= s <= 0.2:
            continue
        key = (g, h, y, x)
        best[key] = max(best.get(key, -1), s)
    groups = {}
    for (g, h, y, x), s in best.items():
        groups.setdefault((g, h), []).append((-s, y, x))
    return sorted((g, h, y, x, -s, i + 1) for (g, h), v in groups.items() for i, (s, y, x) in enumerate(sorted(v)[:n]))


def run(spark, rows, n, parts=7, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = top_per_group(df, {"g": F.col("g"), "h": F.col("h")}, "s", ["y", "x"], n, 0.0, 0.2, **kw)
    return sorted((r.g, r.h, r.y, r.x, r.score, r["rank"]) for r in out.collect())


@pytest.mark.parametrize("most_groups", [100_000, 3, 1])
def test_like_brute_force(spark, most_groups):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaaab"), rnd.choice(["p", "q", None]), rnd.choice([None, float("nan"), float("inf"), -0.1, 0.3, *[k / 50 for k in range(11)]]), rnd.choice([None, *range(-3, 12)]), rnd.randrange(9), "z") for _ in range(3000)]
    rows += rows[:500]
    assert run(spark, rows, 5, most_groups=most_groups) == brute(rows, 5)
    assert run(spark, rows, 5, 1) == brute(rows, 5)


def test_ties_never_depend_on_order(spark):
    rows = [("a", "p", 0.1, y, x, "") for y in range(20) for x in range(20)]
    random.Random(0).shuffle(rows)
    assert [r[2:4] for r in run(spark, rows, 3)] == [(0, 0), (0, 1), (0, 2)]


def test_empty_and_clashing_names(spark):
    assert run(spark, [], 5) == []
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        top_per_group(df, {"score": F.col("g")}, "s", ["y"], 5, 0, 1)
