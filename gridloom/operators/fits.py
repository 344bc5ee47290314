"""Least squares in closed form: every fit is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import guarded_corr, ratio


def through_origin(u: str, target: str) -> Column:
    """Scale k of the conductances for which u / k fits the target best: sum(u^2) / sum(u * target); null if that is not positive."""
    num, den = F.sum(F.col(u) * F.col(u)), F.sum(F.col(u) * F.col(target))
    return ratio(num, den)


def scalar_multiple(df: DataFrame, keys: list[str], one: str, other: str) -> DataFrame:
    """Best c with other = c * one, what share of other's size it leaves, and their correlation."""
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    by = df.groupBy(*keys).agg(s(one, one).alias("_aa"), s(one, other).alias("_ab"), s(other, other).alias("_bb"), guarded_corr(one, other).alias("corr"), F.count("*").alias("n"))
    c = ratio(F.col("_ab"), F.col("_aa"))
    left = F.greatest(F.col("_bb") - c * F.col("_ab"), F.lit(0.0))
    return by.select(*keys, c.alias("scale"), F.sqrt(ratio(left, F.col("_bb"), 0.0)).alias("residual"), "corr", "n")


def line(x: str, y: str) -> dict[str, Column]:
    """Ordinary least squares y = slope * x + intercept; null for a constant x."""
    varies = F.stddev_pop(x) > 1e-15
    r2 = F.when(varies & (F.stddev_pop(y) > 1e-15), F.pow(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(2.0)))
    slope = F.when(varies, F.try_divide(F.covar_pop(x, y), F.var_pop(x)))
    return {"slope": slope, "intercept": F.avg(y) - slope * F.avg(x), "r2": r2}


def loglog(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Power law by least squares of logarithms, with the slope's standard error; only positive pairs count."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, F.log(x).alias("lx"), F.log(y).alias("ly"))
    fit = line("lx", "ly")
    by = logs.groupBy(*keys).agg(fit["slope"].alias("slope"), fit["intercept"].alias("intercept"), fit["r2"].alias("r2"), F.var_pop("lx").alias("_vx"), F.var_pop("ly").alias("_vy"), F.count("*").alias("n"))
    error = F.sqrt(ratio(F.greatest(F.col("_vy") * (1 - F.col("r2")), F.lit(0.0)), F.col("_vx") * (F.col("n") - 2)))
    return by.select(*keys, "slope", "intercept", "r2", error.alias("stderr"), "n")


def nearest_setting(df: DataFrame, keys: list[str], value: Column, settings: list[tuple[float, float]]) -> DataFrame:
    """The (width, pitch) of ``settings`` whose ratio is nearest to a value by logarithm (ties: the first)."""
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(p).alias("p")) for i, (w, p) in enumerate(settings)))
    best = F.array_min(F.transform(table, lambda s: F.struct(F.abs(F.log(s["w"] / s["p"]) - F.log(value)).alias("d"), s["i"].alias("i"), s["w"].alias("w"), s["p"].alias("p"))))
    return df.withColumn("_b", best).select(*keys, F.col("_b.w").alias("strap_width_um"), F.col("_b.p").alias("strap_pitch_um"))
