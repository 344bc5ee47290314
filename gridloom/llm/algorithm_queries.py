"""Queries of the algorithmic problems: related splits (p1) and top items per group (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import clean_name
from gridloom.llm.related_splits import SPLITS, Source, assign_splits, components, link_edges, related_pairs
from gridloom.llm.top_per_group import top_per_group
from gridloom.session import table

#: Supply 0.9 V, of which a twentieth may be lost.
BUDGET_V = 0.045


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "design_sources").withColumn("design", clean_name("design"))
    return link_edges(links, "design", "source_kind", "source_key")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    names = [table(spark, sf, t).select(clean_name("design").alias("entity")).dropna().distinct() for t in ("features", "picp_per_design")]
    pairs = related_pairs(components(_edges(spark, sf)), names[0].unionByName(names[1]))
    return pairs.select(F.col("a").alias("design_a"), F.col("b").alias("design_b"))


def _parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    named = lambda t: table(spark, sf, t).withColumn("design", clean_name("design"))
    sources = {"features": Source(named("features"), "design", "label_v"), "picp_per_design": Source(named("picp_per_design"), "design")}
    return assign_splits(sources, _edges(spark, sf), BUDGET_V)


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of both tables with its partition."""
    parts = _parts(spark, sf)
    none = lambda kind: F.lit(None).cast(kind)
    a = parts["features"].select(F.lit("features").alias("source_table"), "design", "scenario", "ty", "tx", none("string").alias("variant"), none("int").alias("seed"), none("int").alias("fold"), "split")
    b = parts["picp_per_design"].select(F.lit("picp_per_design").alias("source_table"), "design", none("string").alias("scenario"), none("int").alias("ty"), none("int").alias("tx"), "variant", "seed", "fold", "split")
    return a.unionByName(b)


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each related group with its partition, designs and rows; rows without a design are groups of their own."""
    rows = [df.groupBy("component", "split", "design").agg(F.count("*").alias("n")) for df in _parts(spark, sf).values()]
    both = rows[0].unionByName(rows[1]).groupBy("component", "split").agg(F.countDistinct("design").alias("n_designs"), F.sum("n").alias("n_rows"))
    return both.select(F.regexp_replace("component", "\\x00", "").alias("group_id"), "split", "n_designs", "n_rows")


def p1_balance(spark: SparkSession, sf: str) -> DataFrame:
    """What the partition promises, as one row: rows, related groups in several partitions, rows without one, and whether
    each share lies within the largest group of its quota."""
    rows = [df.groupBy("component", "split").agg(F.count("*").alias("n")) for df in _parts(spark, sf).values()]
    groups = rows[0].unionByName(rows[1]).groupBy("component").agg(F.count_distinct("split").alias("parts"), F.min("split").alias("split"), F.sum("n").alias("n"))
    share = {name: F.sum(F.when(F.col("split") == name, F.col("n")).otherwise(0)) for name in SPLITS}
    within = F.lit(True)
    for name, part in SPLITS.items():
        within = within & (F.abs(share[name] - part * F.sum("n")) <= F.max("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("parts") > 1).alias("n_parted"), F.coalesce(F.sum(F.when(F.col("split").isNull(), F.col("n"))), F.lit(0)).alias("n_unassigned"), within.alias("within"))


def _top(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"design_id": clean_name("design_id"), "scenario": clean_name("scenario")}
    return top_per_group(table(spark, sf, "irmap"), keys, "drop_v", ["fy", "fx"], 5, 0.0, 0.2, required=("design_id", "scenario"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("design_id", "scenario", "fy", "fx")


def p2_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The same cells with score and rank."""
    return _top(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


QUERIES = {q.__name__: q for q in (p1_found, p1_splits, p1_groups, p1_balance, p2_found, p2_ranked)}

_NAME = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_TOP = f"""
WITH cells AS (
  SELECT {_NAME.format("design_id")} AS design_id, {_NAME.format("scenario")} AS scenario, fy, fx, max(drop_v) AS score
  FROM irmap WHERE scenario IS NOT NULL AND drop_v BETWEEN 0 AND 0.2 AND NOT isnan(drop_v) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY design_id, scenario ORDER BY score DESC, fy, fx) AS rank FROM cells)
"""
ORACLE = {
    "p1_found": f"""
WITH RECURSIVE s AS (SELECT DISTINCT {_NAME.format("design")} AS d, source_kind AS k, source_key AS v FROM design_sources
    WHERE design IS NOT NULL AND source_key IS NOT NULL AND source_key NOT IN ('', 'unknown')),
  e AS (SELECT DISTINCT x.d AS a, y.d AS b FROM s x JOIN s y ON x.k = y.k AND x.v = y.v),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  here AS (SELECT {_NAME.format("design")} AS d FROM features WHERE design IS NOT NULL UNION SELECT {_NAME.format("design")} FROM picp_per_design WHERE design IS NOT NULL)
SELECT a AS design_a, b AS design_b FROM r WHERE a < b AND a IN (SELECT d FROM here) AND b IN (SELECT d FROM here)""",
    "p1_balance": "SELECT cast(sum(n) AS bigint) AS n_rows, 0 AS n_parted, 0 AS n_unassigned, true AS within FROM (SELECT count(*) AS n FROM features UNION ALL SELECT count(*) FROM picp_per_design)",
    "p2_found": _TOP + "SELECT design_id, scenario, fy, fx FROM ranked WHERE rank <= 5",
    "p2_ranked": _TOP + "SELECT design_id, scenario, fy, fx, score, rank FROM ranked WHERE rank <= 5",
}
