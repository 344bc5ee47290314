"""Bootstraps of groups and permutation importance."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multiplicities(spark: SparkSession, groups: list[str], replicates: int, seed: int) -> DataFrame:
    """How often each group is drawn in each replicate, as distinct multisets with their weight: multiset, weight,
    group, times. Replicates that drew the same groups are evaluated once."""
    draw, names = np.random.RandomState(seed), np.array(sorted(groups))
    sets: dict[tuple[int, ...], int] = {}
    for _ in range(replicates):
        key = tuple(np.bincount(np.searchsorted(names, draw.choice(names, size=len(names), replace=True)), minlength=len(names)).tolist())
        sets[key] = sets.get(key, 0) + 1
    rows = [(i, w, str(g), t) for i, (key, w) in enumerate(sorted(sets.items())) for g, t in zip(names, key, strict=True) if t]
    return spark.createDataFrame(rows, "multiset int, weight int, grp string, times int")


#: Cuts of a number of 32 bits that give Poisson counts of mean 1: how many of them lie below it.
POISSON_CUTS = [float(int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)))) for k in range(10)]


def drawn_sums(per: DataFrame, group: str, sums: list[str], replicates: int, draw: Callable[[Column], Column]) -> DataFrame:
    """Bootstrap of groups from their sums (one row a group): each replicate weighs every group by a Poisson count made
    from ``draw(replicate)``, a number of 32 bits, and adds up. Groups are never gathered; sums are combined before they
    are shuffled, so that a row a replicate and task is."""
    reps = per.select(group, *sums, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    u = reps.withColumn("_u", draw(F.col("rep")))
    times = sum((F.when(F.col("_u") > c, 1).otherwise(0) for c in map(int, POISSON_CUTS)), F.lit(0))
    return u.withColumn("_t", times).groupBy("rep").agg(*(F.sum(F.col("_t") * F.col(c)).alias(c) for c in sums))


def weighted_interval(df: DataFrame, keys: list[str], value: str, weight: str, share: float = 0.95) -> DataFrame:
    """Mean, deviation and percentile interval of weighted values (linear between order statistics)."""
    low, high = (1 - share) / 2, (1 + share) / 2
    by = df.where(F.col(value).isNotNull()).groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.percentile(value, low, F.col(weight)).alias("ci_lo"), F.percentile(value, high, F.col(weight)).alias("ci_hi"), F.sum(weight).alias("replicates"))
    return by.withColumn("excludes_zero", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def bootstrap_means(df: DataFrame, keys: list[str], value: str, row_id: str, replicates: int, seed: int) -> DataFrame:
    """Percentile interval of the mean of few rows a group (runs): each replicate weighs every row by a Poisson
    count hashed from (seed, replicate, row), so that any partitioning gives the same result."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", *keys, row_id), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts, p, total = [], float(np.exp(-1)), 0.0
    for k in range(1, 9):
        total += p
        p /= k
        cuts.append(F.when(u > total, 1).otherwise(0))
    times = sum(cuts[1:], cuts[0])
    means = reps.withColumn("_k", times).groupBy(*keys, "rep").agg(F.sum(F.col(value) * F.col("_k")).alias("_s"), F.sum("_k").alias("_n")).where("_n > 0").withColumn("_m", F.col("_s") / F.col("_n"))
    return means.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.percentile("_m", 0.025).alias("ci_lo"), F.percentile("_m", 0.975).alias("ci_hi"))


def permuted(df: DataFrame, row_id: str, columns: list[str], seed: int, repeat: int, within: list[str]) -> DataFrame:
    """Values of all ``columns`` exchanged by one permutation within each group of ``within`` (designs): rows are
    numbered by id and by hash, and matched number to number."""
    by = W.partitionBy(*within)
    left = df.drop(*columns).withColumn("_r", F.row_number().over(by.orderBy(row_id)))
    right = df.select(*within, *columns, F.row_number().over(by.orderBy(F.xxhash64(F.lit(seed), F.lit(repeat), row_id), row_id)).alias("_r"))
    return left.join(right, [*within, "_r"]).drop("_r").select(df.columns)


def mean_error_increase(base: Column, changed: Column, label: Column, scale: float = 1000.0) -> Column:
    return (F.avg(F.abs(changed - label)) - F.avg(F.abs(base - label))) * scale
