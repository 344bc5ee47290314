"""The 32 features of each tile and scenario, for all designs at once, without any label data.

Input frames are keyed by ``design`` (see :mod:`gridloom.sources.schema`). Their rows are tiled in Spark and meet by
design, where the kernel of :mod:`gridloom.operators.design_features` makes the features in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import clip, ratio, tile
from gridloom.operators import design_features
from gridloom.operators.raster import block_reduce, with_tiles
from gridloom.sources.schema import COARSE, FEATURES, FINE, IDENTITY

PARAMS = ["die_w_um", "die_h_um", "vdd_v", "sheet", "bump"]


class Bundle(NamedTuple):
    """params: design, die_w_um, die_h_um, vdd_v, sheet, bump (conductances), or the same numbers for every design."""

    params: DataFrame | dict[str, float]
    modules: DataFrame
    macros: DataFrame
    instances: DataFrame
    bumps: DataFrame
    straps: DataFrame
    activity: DataFrame


def design_rows(b: Bundle, fine: int, coarse: int) -> DataFrame:
    """All tables of the bundle as rows of one shape: design, k (kind), s, t (names), v (numbers). Places are tiled here.

    instance: module; coarse tile, fine cell, area, capacitance, clock, sequential. macro: module; first and last fine row,
    first and last fine column, likewise coarse, then its half-open span of sub-cells, power. bump: coarse tile, fine cell.
    strap: fine cell (null beyond the grid), density. module: module, clock domain; rated power. activity: scenario, module;
    activity, mission weight. params: die_w_um, die_h_um, vdd_v, sheet, bump."""
    w, h = F.col("die_w_um"), F.col("die_h_um")
    fixed = isinstance(b.params, dict)
    sized = lambda df: df.withColumns({c: F.lit(b.params[c]) for c in ("die_w_um", "die_h_um")}) if fixed else df.join(b.params.select("design", "die_w_um", "die_h_um"), "design")

    def row(df: DataFrame, kind: int, v: list[Column], s: str | None = None, t: str | None = None) -> DataFrame:
        name = lambda c: (F.lit(None) if c is None else F.col(c)).cast("string")
        return df.select("design", F.lit(kind).cast("tinyint").alias("k"), name(s).alias("s"), name(t).alias("t"), F.array(*(F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in v)).alias("v"))

    def placed(df: DataFrame) -> tuple[DataFrame, list[Column]]:
        at = with_tiles(with_tiles(sized(df), "x_um", "y_um", w, h, coarse), "x_um", "y_um", w, h, fine, "fy", "fx")
        return at, [F.col("ty") * coarse + F.col("tx"), F.col("fy") * fine + F.col("fx")]

    def span(low: str, high: str, size: Column) -> list[Column]:
        return [c for n in (fine, coarse) for c in (tile(F.col(low), size, n), F.greatest(tile(F.col(high), size, n), tile(F.col(low), size, n)))]

    ys, xs = span("y0_um", "y1_um", h), span("x0_um", "x1_um", w)
    sub = coarse * design_features.SUB
    at = lambda c, size, f: clip(f(F.col(c) / (size / sub)).cast("int"), 0, sub)
    under = [at("y0_um", h, F.floor), at("y1_um", h, F.ceil), at("x0_um", w, F.floor), at("x1_um", w, F.ceil)]
    instances, i_at = placed(b.instances)
    bumps, b_at = placed(b.bumps)
    inside = F.when(F.expr(f"fy between 0 and {fine - 1} and fx between 0 and {fine - 1}"), F.col("fy") * fine + F.col("fx"))
    rows = row(instances, design_features.INSTANCE, [*i_at, "area_um2", "cap_ff", "is_clk", "is_seq"], "module")
    for part in (
        row(sized(b.macros), design_features.MACRO, [*ys[:2], *xs[:2], *ys[2:], *xs[2:], *under, "power_mw"], "module"),
        row(bumps, design_features.BUMP, b_at),
        row(b.straps, design_features.STRAP, [inside, "density"]),
        row(b.modules, design_features.MODULE, ["rated_power_mw"], "module", "clock_domain"),
        row(b.activity, design_features.ACTIVITY, ["activity", "mission_weight"], "scenario", "module"),
        *([] if fixed else [row(b.params, design_features.PARAMS, [*PARAMS])]),
    ):
        rows = rows.unionByName(part)
    return rows


def feature_table(b: Bundle, fine: int = FINE, coarse: int = COARSE, needs: tuple[int, ...] = (), digits: int | None = None) -> DataFrame:
    """design, scenario, ty, tx and the 32 features, one row per coarse tile of every design and scenario. Designs without
    bumps, or without rows of one of the kinds that ``needs`` names, have none. The rows of a design are shuffled to one
    place once, and what they make is not shuffled at all: it is hundreds of times as much as they are. ``digits``: rounds."""
    fixed = [float(b.params[c]) for c in PARAMS] if isinstance(b.params, dict) else None
    rows = design_rows(b, fine, coarse)
    schema = T.StructType([T.StructField(c, kind) for c, kind in ((IDENTITY[0], T.StringType()), (IDENTITY[1], T.StringType()), (IDENTITY[2], T.IntegerType()), (IDENTITY[3], T.IntegerType()), *((c, T.DoubleType()) for c in FEATURES))])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = design_features.Design(fine, coarse, fixed)
        for batch in batches:
            held.add(batch)
        if held.seen.issuperset(needs):
            yield from held.features(key[0].as_py(), digits)

    # the number of partitions is given, since what is small here gives large results
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.where("design is not null").repartition(parts, "design").groupBy("design").applyInArrow(run, schema)


def with_labels(features: DataFrame, irmap: DataFrame, r: int = FINE // COARSE) -> DataFrame:
    """Attaches the label: the greatest fine drop of the tile, never the mean. Tiles without cells get null."""
    worst = block_reduce(irmap, ["design", "scenario"], "drop_v", r).select("design", "scenario", "ty", "tx", F.col("v_max").alias("label_v"))
    return features.join(worst, ["design", "scenario", "ty", "tx"], "left")


def effective_slack(paths: DataFrame, drop: str = "drop_v", slack: str = "slack_ns", delay: str = "delay_ns", vdd: float = 0.9, threshold: float = 0.3, alpha: float = 1.3) -> DataFrame:
    """Slack after the supply drop, by the alpha-power law of delay; null where the drop leaves no overdrive."""
    full = vdd / (vdd - threshold) ** alpha
    left = F.lit(vdd) - F.col(drop)
    slower = F.when(left > threshold, left / F.pow(F.when(left > threshold, left - threshold), F.lit(alpha)) / full)
    return paths.withColumn("slack_eff_ns", F.col(slack) - F.col(delay) * (slower - 1))


def rollup(df: DataFrame, levels: list[str], value: str, weight: str) -> DataFrame:
    """Expected value and worst value at every level of a hierarchy (design, domain, module, ...)."""
    by = df.rollup(*levels).agg(F.sum(F.col(value) * F.col(weight)).alias("_s"), F.sum(weight).alias("_w"), F.max(value).alias("worst"), F.grouping_id().alias("level"))
    return by.select(*levels, "level", ratio(F.col("_s"), F.col("_w")).alias("expected"), "worst")
