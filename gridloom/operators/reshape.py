"""Set operations, upserts and changes of shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; null keys match no row."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_appearances(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Distinct values of each group with the place of their first appearance."""
    return df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first")).select(*keys, value, "first.*")


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric."""
    return wide.unpivot(keys, metrics, "metric", "value")


def wide_metrics(long: DataFrame, keys: list[str], metric: str, value: str, names: list[str]) -> DataFrame:
    """One column per metric; the names are given, so that no job is needed to find them."""
    return long.groupBy(*keys).pivot(metric, names).agg(F.first(value))


def dense_lines(tiles: DataFrame, keys: list[str], value: str, n: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Each map as n lines of n values: keys, ``ty`` and the array ``line``; absent tiles are 0. Lines without tiles too."""
    held = tiles.groupBy(*keys, ty).agg(F.map_from_entries(F.collect_list(F.struct(tx, value))).alias("_m"))  # n entries at most
    every = tiles.select(*keys).distinct().withColumn(ty, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.coalesce(F.try_element_at("_m", x), F.lit(0.0)))
    return every.join(held, [*keys, ty], "left").withColumn("line", at).drop("_m")


def formatted(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Numbers as text of fixed digits; null becomes ``n/a``."""
    return df.withColumns({c: F.coalesce(F.format_string(f"%.{digits}f", F.col(c)), F.lit("n/a")) for c in columns})


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
