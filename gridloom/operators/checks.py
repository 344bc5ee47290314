"""Validation of design bundles: every check is a frame of faults (design_id, file, check, message); all are united.

No fault: the result is empty. Checks never raise on bad data; NaN counts as a fault of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import id_list
from gridloom.sources.schema import BUNDLE, FINE


def _faults(df: DataFrame, file: str, check: str, message: Column | str) -> DataFrame:
    return df.select("design_id", F.lit(file).alias("file"), F.lit(check).alias("check"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def columns_present(frames: dict[str, DataFrame]) -> list[str]:
    """Files and columns that are missing altogether (known without a job)."""
    out = [f"{n}.csv is missing" for n in BUNDLE if n not in frames]
    return out + [f"{n}.csv lacks {sorted(lost)}" for n in BUNDLE if n in frames and (lost := {f.name for f in BUNDLE[n]} - set(frames[n].columns))]


def one_stats_row(stats: DataFrame) -> DataFrame:
    return _faults(stats.groupBy("design_id").count().where("count <> 1"), "design_stats", "one_row", F.format_string("%d rows", F.col("count")))


def die_positive(stats: DataFrame) -> DataFrame:
    return _faults(stats.where("die_w_um is null or die_h_um is null or isnan(die_w_um) or isnan(die_h_um) or die_w_um <= 0 or die_h_um <= 0"), "design_stats", "die_positive", "the die has no size")


def within_die(rows: DataFrame, stats: DataFrame, file: str, x: str, y: str, slack: float = 1.01) -> DataFrame:
    """Greatest coordinates against the die; a hundred dies away they are told to be nanometres."""
    most = rows.groupBy("design_id").agg(F.max(x).alias("mx"), F.max(y).alias("my")).join(stats.select("design_id", "die_w_um", "die_h_um"), "design_id")
    over = F.greatest(F.col("mx") / F.col("die_w_um"), F.col("my") / F.col("die_h_um"))
    sane = most.where("die_w_um > 0 and die_h_um > 0").withColumn("over", over)
    return _faults(sane.where(F.isnan("over") | (F.col("over") > slack)), file, "within_die", F.when(F.isnan("over"), "a coordinate is NaN").when(F.col("over") > 100, "coordinates look like nanometres").otherwise(F.format_string("coordinates reach %.3f dies", F.col("over"))))


def has_rows(stats: DataFrame, rows: DataFrame, file: str) -> DataFrame:
    return _faults(stats.select("design_id").distinct().join(rows.select("design_id").distinct(), "design_id", "left_anti"), file, "not_empty", "no rows")


def full_grid(rows: DataFrame, file: str, keys: list[str], n: int = FINE) -> DataFrame:
    """Row count, duplicates and index range of a fine map."""
    by = rows.groupBy("design_id", *keys).agg(F.count("*").alias("rows"), F.count_distinct("fy", "fx").alias("cells"), F.count_if(F.expr(f"fy not between 0 and {n - 1} or fx not between 0 and {n - 1}")).alias("outside"))
    wrong = by.where((F.col("rows") != n * n) | (F.col("cells") != F.col("rows")) | (F.col("outside") > 0))
    return _faults(wrong, file, "full_grid", F.format_string("%d rows, %d cells, %d outside", "rows", "cells", "outside"))


def between(rows: DataFrame, file: str, column: str, low: float, high: float) -> DataFrame:
    bad = rows.groupBy("design_id").agg(F.count_if(F.isnan(column) | ~F.col(column).between(low, high)).alias("bad")).where("bad > 0")
    return _faults(bad, file, f"{column}_range", F.format_string("%d values outside", "bad"))


def drop_levels(irmap: DataFrame) -> DataFrame:
    """Units, sign, plausibility and uniformity of each drop map."""
    by = irmap.groupBy("design_id", "scenario").agg(F.max("drop_v").alias("most"), F.min("drop_v").alias("least"), F.stddev_samp("drop_v").alias("spread"))
    kinds = F.array_compact(F.array(F.when(F.isnan("most"), "NaN"), F.when((F.col("most") > 1.0) & ~F.isnan("most"), "units"), F.when(F.col("least") < 0, "negative"), F.when((F.col("most") > 0.2) & (F.col("most") <= 1.0), "large"), F.when(F.coalesce("spread", F.lit(0.0)) <= 1e-4, "uniform")))
    return by.select("design_id", "scenario", F.explode(kinds).alias("kind")).select("design_id", F.lit("irmap").alias("file"), F.concat(F.lit("drop_"), "kind").alias("check"), F.concat(F.lit("scenario "), F.coalesce("scenario", F.lit("null"))).alias("message"))


def mission_weights(activity: DataFrame) -> DataFrame:
    """One weight a scenario; they sum to one."""
    each = activity.groupBy("design_id", "scenario").agg(F.min("mission_weight").alias("w"), F.max("mission_weight").alias("v"))
    by = each.groupBy("design_id").agg(F.sum("w").alias("total"), F.count_if(F.col("w") != F.col("v")).alias("mixed"))
    return _faults(by.where((F.abs(F.col("total") - 1) > 1e-6) | (F.col("mixed") > 0)), "activity", "mission_weights", F.format_string("sum %.6f, %d scenarios with several", "total", "mixed"))


def modules_known(rows: DataFrame, modules: DataFrame, file: str) -> DataFrame:
    lost = rows.where("module is not null").select("design_id", "module").distinct().join(modules.select("design_id", "module").distinct(), ["design_id", "module"], "left_anti")
    return _faults(lost, file, "module_known", F.concat(F.lit("unknown module "), "module"))


def path_members(paths: DataFrame, instances: DataFrame) -> DataFrame:
    """Tokens that are no integers, and integers that are no instances (the first ten per design are named)."""
    tokens = paths.select("design_id", F.explode_outer(id_list(F.col("inst_ids"))).alias("inst_id"), "inst_ids").where("inst_ids is not null and inst_ids <> ''")
    words = _faults(tokens.where("inst_id is null").groupBy("design_id").count(), "paths", "integers", F.format_string("%d tokens are no integers", "count"))
    lost = tokens.where("inst_id is not null").select("design_id", "inst_id").distinct().join(instances.select("design_id", "inst_id").distinct(), ["design_id", "inst_id"], "left_anti")
    ranked = lost.groupBy("design_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("inst_id")), 1, 10).alias("some"))
    return words.unionByName(_faults(ranked, "paths", "members", F.concat(F.format_string("%d unknown instances: ", "n"), F.concat_ws(", ", F.col("some").cast("array<string>")))))


def validate(frames: dict[str, DataFrame]) -> DataFrame:
    """All faults of all designs."""
    f = frames
    faults = [
        one_stats_row(f["design_stats"]),
        die_positive(f["design_stats"]),
        within_die(f["instances"], f["design_stats"], "instances", "x_um", "y_um"),
        within_die(f["macros"], f["design_stats"], "macros", "x1_um", "y1_um"),
        has_rows(f["design_stats"], f["bumps"], "bumps"),
        full_grid(f["strap_planned"], "strap_planned", []),
        between(f["strap_planned"], "strap_planned", "density", 0, 1),
        full_grid(f["irmap"], "irmap", ["scenario"]),
        drop_levels(f["irmap"]),
        mission_weights(f["activity"]),
        between(f["activity"], "activity", "activity", 0, 1),
        *(modules_known(f[t], f["modules"], t) for t in ("activity", "instances", "macros")),
        path_members(f["paths"], f["instances"]),
    ]
    return reduce(DataFrame.unionByName, faults)
