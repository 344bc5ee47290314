"""Acceptance gates as data: check, ok, value. Nothing is raised; a consumer decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.schema import BUDGET_V, FEATURES


def _gate(df: DataFrame, check: str, value: Column, ok: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(F.lit(check).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), "value")


def feature_gates(features: DataFrame, tiles: int = 576) -> DataFrame:
    """No value that is not finite; full grids; ranks within 0..1; weakness independent of the scenario."""
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in FEATURES), F.lit(0))
    groups = features.groupBy("design", "scenario").agg(F.count_distinct("ty", "tx").alias("n"))
    weak = features.groupBy("design", "ty", "tx").agg((F.max("grid_weak") - F.min("grid_weak")).alias("d"))
    v = F.col("value")
    return reduce(DataFrame.unionByName, [
        _gate(features, "values not finite", F.sum(bad), v == 0),
        _gate(groups, "groups without a full grid", F.count_if(F.col("n") != tiles), v == 0),
        _gate(features, "greatest rank", F.max("phys_base_rank"), (v > 0) & (v <= 1)),
        _gate(weak, "spread of weakness over scenarios", F.max("d"), v == 0),
    ])


def corpus_gates(maps: DataFrame, budget: float = BUDGET_V) -> DataFrame:
    """Plausible and uneven drop maps, with some tiles over budget and most below."""
    v = F.col("value")
    spread = maps.groupBy("design", "scenario").agg(F.stddev_samp("drop_v").alias("s"))
    return reduce(DataFrame.unionByName, [
        _gate(maps, "greatest drop", F.max("drop_v"), (v > 0) & (v <= 0.2)),
        _gate(maps, "share over budget", F.avg(F.when(F.col("drop_v") > budget, 1.0).otherwise(0.0)), (v > 0) & (v < 0.5)),
        _gate(spread, "uniform maps", F.count_if(F.coalesce("s", F.lit(0.0)) <= 1e-4), v == 0),
    ])


def model_gates(validation: DataFrame) -> DataFrame:
    """The affine variant beats bare physics, the hybrid beats both in absolute error; coverage is near its level."""
    v = F.col("value")
    of = lambda name, metric: F.max(F.when((F.col("variant") == name) & (F.col("metric") == metric), F.col("mean")))
    return reduce(DataFrame.unionByName, [
        _gate(validation, "mae affine minus physics", of("physics_affine", "mae") - of("physics_only", "mae"), v < 0),
        _gate(validation, "mae hybrid minus affine", of("hybrid", "mae") - of("physics_affine", "mae"), v < 0),
        _gate(validation, "coverage of hybrid", of("hybrid", "picp"), (v >= 0.7) & (v <= 0.95)),
    ])
