"""Shares, concentrations, currents and peaks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.numeric import clip, ratio


def domain_concentration(df: DataFrame, keys: list[str], domain: str, current: str) -> DataFrame:
    """Herfindahl index and greatest share of the current over domains; idle groups (no current) give 0."""
    sums = df.groupBy(*keys, domain).agg(F.sum(current).alias("_c"))
    by = sums.groupBy(*keys).agg(F.sum("_c").alias("_t"), F.sum(F.col("_c") * F.col("_c")).alias("_q"), F.max("_c").alias("_m"))
    return by.select(*keys, ratio(F.col("_q"), F.col("_t") * F.col("_t"), 0.0).alias("hhi"), ratio(F.col("_m"), F.col("_t"), 0.0).alias("topshare"))


def concentration(fine: DataFrame, keys: list[str], value: str, cells: int = 16, top: int = 4) -> DataFrame:
    """Greatest over mean, and share of the ``top`` cells, of a tile's ``cells`` fine cells (absent ones are 0).
    Idle tiles give 1 and ``top / cells``. At most ``cells`` values are gathered per tile."""
    by = fine.groupBy(*keys).agg(F.sum(value).alias("_s"), F.max(value).alias("_m"), F.reverse(F.array_sort(F.collect_list(value))).alias("_l"))
    best = F.aggregate(F.slice("_l", 1, top), F.lit(0.0), lambda a, x: a + x)
    return by.select(*keys, ratio(F.col("_m"), F.col("_s") / cells, 1.0).alias("conc_ratio"), ratio(best, F.col("_s"), top / cells).alias("conc_top"))


def power_fraction(activity: DataFrame, modules: DataFrame, design: str = "design") -> DataFrame:
    """Power of a scenario against the rated power of its modules; 0 where nothing is rated."""
    joined = activity.join(modules.select(design, "module", "rated_power_mw"), [design, "module"])
    by = joined.groupBy(design, "scenario").agg(F.sum(F.col("rated_power_mw") * F.col("activity")).alias("_a"), F.sum("rated_power_mw").alias("_r"))
    return by.select(design, "scenario", ratio(F.col("_a"), F.col("_r"), 0.0).alias("power_frac"))


def instance_currents(instances: DataFrame, modules: DataFrame, activity: DataFrame | None, vdd: float, design: str = "design") -> DataFrame:
    """Current of each instance: its module's rated power times activity, over the supply, shared equally by the
    module's instances. Missing module, rating or activity counts as 0; without ``activity`` the activity is 1. An instance
    has a row for each scenario of its design."""
    counts = instances.groupBy(design, "module").agg(F.count("*").alias("_n"))  # one row a module
    per = counts.join(modules.select(design, "module", "rated_power_mw", "clock_domain"), [design, "module"], "left")
    unit = per.withColumn("unit_a", F.coalesce("rated_power_mw", F.lit(0.0)) * 1e-3 / (F.lit(vdd) * F.col("_n"))).select(design, "module", "clock_domain", "unit_a")
    if activity is None:
        return instances.join(unit, [design, "module"], "left")
    scenarios = activity.select(design, "scenario").distinct()
    # the instances without module are a group of their own
    every = unit.join(scenarios, design).join(activity.select(design, "scenario", "module", "activity"), [design, "scenario", "module"], "left")
    rated = every.withColumn("current_a", F.col("unit_a") * F.coalesce("activity", F.lit(0.0))).select(design, "scenario", "module", "clock_domain", "current_a")
    mine = rated.withColumnsRenamed({design: "_d", "module": "_m"})
    return instances.join(mine, (F.col(design) == F.col("_d")) & F.col("module").eqNullSafe(F.col("_m"))).drop("_d", "_m")


def peak_normalised(df: DataFrame, keys: list[str], value: str, name: str = "relative") -> DataFrame:
    """Value against the peak of its group, within 0..1; groups whose peak is not positive give no rows."""
    peak = F.max(value).over(W.partitionBy(*keys))
    return df.withColumn("_peak", peak).where("_peak > 0").withColumn(name, clip(F.col(value) / F.col("_peak"), 0.0, 1.0)).drop("_peak")


def weighted_split(df: DataFrame, keys: list[str], total: Column, weight: Column, name: str = "part") -> DataFrame:
    """A total shared by weight over the rows of each group."""
    return df.withColumn("_w", weight).withColumn(name, ratio(total * F.col("_w"), F.sum("_w").over(W.partitionBy(*keys)), 0.0)).drop("_w")


def weighted_cut(df: DataFrame, keys: list[str], order: list[str], weight: str, shares: list[float], name: str = "part") -> DataFrame:
    """Rows of each group parted where the running weight passes each share of the total: the number of cuts below."""
    by = W.partitionBy(*keys)
    run = df.withColumn("_run", F.sum(weight).over(by.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(by))
    cuts = sum((F.when(F.col("_run") > F.col("_all") * s, 1).otherwise(0) for s in shares), F.lit(0))
    return run.withColumn(name, cuts).drop("_run", "_all")


def cell_weight(area: Column, is_clk: Column, is_seq: Column) -> Column:
    """Area weighted by kind: clock cells 2, sequential cells 1.5, others 1."""
    return area * F.when(is_clk == 1, 2.0).when(is_seq == 1, 1.5).otherwise(1.0)


def normalised_density(df: DataFrame, keys: list[str], value: str, q: float = 0.95, floor: float = 0.15, name: str = "density") -> DataFrame:
    """Value against the quantile of the positive values of its group, within ``floor..1``."""
    limits = df.where(F.col(value) > 0).groupBy(*keys).agg(F.percentile(value, q).alias("_p"))
    return df.join(limits, keys, "left").withColumn(name, clip(ratio(F.col(value), F.col("_p"), 0.0), floor, 1.0)).drop("_p")


def prefer_measured(assumed: DataFrame, measured: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Measured values where there are any, else the assumed ones, with the origin."""
    m = measured.select(*keys, F.col(value).alias("_m"))
    return assumed.join(m, keys, "left").withColumn("origin", F.when(F.col("_m").isNotNull(), "measured").otherwise("assumed")).withColumn(value, F.coalesce("_m", value)).drop("_m")


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities of equal bins; the last bin holds its upper edge; values outside are left out."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high) & ~F.isnan(value))
    counts = inside.withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys)) if keys else F.sum("n").over(W.partitionBy(F.lit(0)))  # one row a bin
    return counts.withColumn("share", F.col("n") / (total * width))
