"""Rasters, joins, shares and neighbourhoods over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import clean_name, trimmed
from gridloom.functions.numeric import finite
from gridloom.functions.text import has_token, id_list, module_of, short_hash
from gridloom.operators import raster, reshape, shares, spatial
from gridloom.operators.ranking import average_rank, demeaned, order_statistic
from gridloom.plans.base import DIE, VDD_V, N, Register, Views, sql_tile
from gridloom.plans.data_problems import _VALUES, path_values
from gridloom.session import table
from gridloom.sources.schema import FEATURE_GROUPS, FEATURES, SCENARIOS

query = Register()
T = lambda c, n=N: sql_tile(c, DIE, n)
GROUP = ["design", "scenario"]
_BLOCK = "SELECT design, scenario, fy // 4 AS ty, fx // 4 AS tx, avg(drop_v) AS v_mean, min(drop_v) AS v_min, max(drop_v) AS v_max, count(*) AS n_cells FROM r GROUP BY 1, 2, 3, 4"


def _placed(v: Views, n: int = N) -> DataFrame:
    return raster.with_tiles(v.i, "x_um", "y_um", DIE, DIE, n)


@query("design ty tx n_cells", "area", f"SELECT design, {T('y_um')} AS ty, {T('x_um')} AS tx, count(*) AS n_cells, sum(area_um2) AS area FROM i GROUP BY 1, 2, 3")
def q_raster_sum(v: Views) -> DataFrame:
    return raster.scatter_add(_placed(v).withColumn("_one", F.lit(1)), ["design", "ty", "tx"], {"n_cells": F.col("_one"), "area": F.col("area_um2")})


@query("design inst_id tile_id ty tx", "", f"SELECT design, inst_id, t AS tile_id, t // 24 AS ty, t % 24 AS tx FROM (SELECT design, inst_id, {T('y_um')} * 24 + {T('x_um')} AS t FROM i)")
def q_tile_inverse(v: Views) -> DataFrame:
    ty, tx = raster.tile_of_id(F.col("tile_id"), N)
    return _placed(v).select("design", "inst_id", raster.tile_id(F.col("ty"), F.col("tx"), N).alias("tile_id")).select("*", ty.alias("ty"), tx.alias("tx"))


@query("design scenario ty tx n_cells", "v_mean v_min v_max", _BLOCK)
def q_block_reduce(v: Views) -> DataFrame:
    return raster.block_reduce(v.rt, GROUP, "drop_v", 4, tiled=True)


@query("design scenario ty tx", "label_v other_v", "SELECT f.design, f.scenario, f.ty, f.tx, w.v_max AS label_v, f.label_v AS other_v FROM f JOIN w ON f.design = w.design AND f.scenario = w.scenario AND f.ty = w.ty AND f.tx = w.tx", f"w AS ({_BLOCK})")
def q_label_max(v: Views) -> DataFrame:
    worst = raster.block_reduce(v.rt, GROUP, "drop_v", 4, tiled=True).select(*GROUP, "ty", "tx", F.col("v_max").alias("w"))
    return v.f.join(worst, [*GROUP, "ty", "tx"]).select(*GROUP, "ty", "tx", F.col("w").alias("label_v"), F.col("label_v").alias("other_v"))


@query("design ty tx cells", "util capden clkden seqden", f"SELECT design, {T('y_um')} AS ty, {T('x_um')} AS tx, count(*) AS cells, sum(area_um2) / {(DIE / N) ** 2!r} AS util, sum(cap_ff) / {(DIE / N) ** 2!r} AS capden, sum(is_clk) / count(*) AS clkden, sum(is_seq) / count(*) AS seqden FROM i GROUP BY 1, 2, 3")
def q_tile_density(v: Views) -> DataFrame:
    return raster.densities(_placed(v), ["design", "ty", "tx"], (DIE / N) ** 2)


@query("design ty tx n_cells", "", f"SELECT d.design, (g.k // 24) AS ty, (g.k % 24) AS tx, count(i.inst_id) AS n_cells FROM (SELECT DISTINCT design FROM c) d CROSS JOIN (SELECT unnest(range(576)) AS k) g LEFT JOIN i ON i.design = d.design AND {T('i.y_um')} = g.k // 24 AND {T('i.x_um')} = g.k % 24 GROUP BY 1, 2, 3")
def q_full_grid(v: Views) -> DataFrame:
    """Cell counts of every tile, empty ones included, of designs with macros."""
    grid = raster.full_grid(v.c.select("design").distinct(), N)
    return raster.densify(_placed(v).groupBy("design", "ty", "tx").agg(F.count("*").alias("n_cells")), grid, ["design", "ty", "tx"], 0)


@query("design macro_id ty tx n_tiles", "power", f"SELECT design, macro_id, ty, tx, (y1 - y0 + 1) * (x1 - x0 + 1) AS n_tiles, power_mw / ((y1 - y0 + 1) * (x1 - x0 + 1)) AS power FROM (SELECT *, unnest(range(y0, y1 + 1)) AS ty FROM (SELECT design, macro_id, power_mw, {T('y0_um')} AS y0, {T('y1_um')} AS y1, {T('x0_um')} AS x0, {T('x1_um')} AS x1 FROM c)), unnest(range(x0, x1 + 1)) AS u(tx)")
def q_macro_tiles(v: Views) -> DataFrame:
    out = raster.covered_tiles(v.c, DIE, DIE, N)
    return out.select("design", "macro_id", "ty", "tx", "n_tiles", (F.col("power_mw") / F.col("n_tiles")).alias("power"))


_SUB = N * 16
_edge = lambda fn, c: f"least(greatest(cast({fn}({c} / ({DIE!r} / {_SUB})) AS integer), 0), {_SUB})"


@query("design ty tx", "covered", f"SELECT design, y // 16 AS ty, x // 16 AS tx, count(*) / 256.0 AS covered FROM (SELECT DISTINCT design, y, x FROM (SELECT design, c0, d0, unnest(range(a0, b0)) AS y FROM (SELECT design, {_edge('floor', 'y0_um')} AS a0, {_edge('ceil', 'y1_um')} AS b0, {_edge('floor', 'x0_um')} AS c0, {_edge('ceil', 'x1_um')} AS d0 FROM c)), unnest(range(c0, d0)) AS u(x)) GROUP BY 1, 2, 3")
def q_macro_cover(v: Views) -> DataFrame:
    return raster.coverage(v.c, ["design"], DIE, DIE, N)


@query("design ty tx edge_distance", "", "SELECT DISTINCT design, ty, tx, least(ty, tx, 23 - ty, 23 - tx) AS edge_distance FROM f")
def q_edge_dist(v: Views) -> DataFrame:
    return v.f.select("design", "ty", "tx").distinct().withColumn("edge_distance", raster.edge_distance(F.col("ty"), F.col("tx"), N))


_UNIT = "u AS (SELECT i.design, i.module, count(*) AS n FROM i GROUP BY 1, 2), per AS (SELECT u.design, u.module, m.clock_domain, coalesce(m.rated_power_mw, 0) * 0.001 / (0.9 * u.n) AS unit_a FROM u LEFT JOIN m ON u.design = m.design AND u.module = m.module)"


@query("design inst_id scenario", "current_a", "SELECT i.design, i.inst_id, s.scenario, per.unit_a * coalesce(a.activity, 0) AS current_a FROM i JOIN per ON i.design = per.design AND i.module IS NOT DISTINCT FROM per.module JOIN (SELECT DISTINCT design, scenario FROM a) s ON s.design = i.design LEFT JOIN a ON a.design = i.design AND a.scenario = s.scenario AND a.module = i.module", _UNIT, 9)
def q_instance_currents(v: Views) -> DataFrame:
    return shares.instance_currents(v.i, v.m, v.a, VDD_V).select("design", "inst_id", "scenario", "current_a")


@query("design ty tx module", "unit_a", f"SELECT i.design, {T('y_um')} AS ty, {T('x_um')} AS tx, i.module, sum(per.unit_a) AS unit_a FROM i JOIN per ON i.design = per.design AND i.module = per.module GROUP BY 1, 2, 3, 4", _UNIT, 9)
def q_tile_module(v: Views) -> DataFrame:
    cur = shares.instance_currents(v.i, v.m, None, VDD_V).where("unit_a is not null")
    return raster.with_tiles(cur, "x_um", "y_um", DIE, DIE, N).groupBy("design", "ty", "tx", "module").agg(F.sum("unit_a").alias("unit_a"))


@query("design ty tx", "hhi topshare", "SELECT design, ty, tx, CASE WHEN sum(s) > 0 THEN sum(s * s) / (sum(s) * sum(s)) ELSE 0 END AS hhi, CASE WHEN sum(s) > 0 THEN max(s) / sum(s) ELSE 0 END AS topshare FROM d GROUP BY 1, 2, 3", f"{_UNIT}, d AS (SELECT i.design, {T('y_um')} AS ty, {T('x_um')} AS tx, per.clock_domain, sum(per.unit_a) AS s FROM i JOIN per ON i.design = per.design AND i.module = per.module GROUP BY 1, 2, 3, 4)")
def q_domain_shares(v: Views) -> DataFrame:
    cur = shares.instance_currents(v.i, v.m, None, VDD_V).where("unit_a is not null")
    return shares.domain_concentration(raster.with_tiles(cur, "x_um", "y_um", DIE, DIE, N), ["design", "ty", "tx"], "clock_domain", "unit_a")


_LISTS = "SELECT design, scenario, fy // 4 AS ty, fx // 4 AS tx, list(drop_v ORDER BY drop_v DESC) AS l, sum(drop_v) AS s, max(drop_v) AS mx FROM r GROUP BY 1, 2, 3, 4"


@query("design scenario ty tx", "conc_ratio conc_top", f"SELECT design, scenario, ty, tx, CASE WHEN s > 0 THEN mx / (s / 16) ELSE 1 END AS conc_ratio, CASE WHEN s > 0 THEN list_sum(l[1:4]) / s ELSE 0.25 END AS conc_top FROM ({_LISTS})")
def q_conc_ratio(v: Views) -> DataFrame:
    return shares.concentration(v.rt, [*GROUP, "ty", "tx"], "drop_v")


@query("design scenario", "power_frac", "SELECT a.design, a.scenario, CASE WHEN sum(rated_power_mw) > 0 THEN coalesce(sum(rated_power_mw * activity), 0) / sum(rated_power_mw) ELSE 0 END AS power_frac FROM a JOIN m ON a.design = m.design AND a.module = m.module GROUP BY 1, 2")
def q_power_frac(v: Views) -> DataFrame:
    return shares.power_fraction(v.a, v.m).withColumn("power_frac", F.coalesce("power_frac", F.lit(0.0)))


@query("design scenario module", "relative", "SELECT design, scenario, module, least(greatest(activity / pk, 0), 1) AS relative FROM (SELECT *, max(activity) OVER (PARTITION BY design, module) AS pk FROM a) WHERE pk > 0")
def q_peak_norm(v: Views) -> DataFrame:
    return shares.peak_normalised(v.a, ["design", "module"], "activity").select("design", "scenario", "module", "relative")


@query("design module n", "", "SELECT design, module, count(*) AS n FROM i GROUP BY 1, 2")
def q_module_counts(v: Views) -> DataFrame:
    return v.i.groupBy("design", "module").agg(F.count("*").alias("n"))


@query("design scenario n_values", "weight", "SELECT design, scenario, count(DISTINCT mission_weight) AS n_values, min(mission_weight) AS weight FROM a GROUP BY 1, 2")
def q_scenario_weight(v: Views) -> DataFrame:
    return v.a.groupBy("design", "scenario").agg(F.count_distinct("mission_weight").alias("n_values"), F.min("mission_weight").alias("weight"))


@query("design scenario n n_tiles", "mean sd", "SELECT design, scenario, count(label_v) AS n, count(DISTINCT ty * 24 + tx) AS n_tiles, avg(label_v) AS mean, CASE WHEN count(label_v) > 1 THEN stddev_samp(label_v) END AS sd FROM f GROUP BY 1, 2")
def q_group_stats(v: Views) -> DataFrame:
    return v.f.groupBy(*GROUP).agg(F.count("label_v").alias("n"), F.count_distinct(F.col("ty") * 24 + F.col("tx")).alias("n_tiles"), F.avg("label_v").alias("mean"), F.stddev_samp("label_v").alias("sd"))


@query("design", "density_p95", "SELECT design, quantile_cont(area_um2, 0.95) AS density_p95 FROM i WHERE area_um2 > 0 GROUP BY 1")
def q_percentile95(v: Views) -> DataFrame:
    return v.i.where("area_um2 > 0").groupBy("design").agg(F.percentile("area_um2", 0.95).alias("density_p95"))


@query("design ty tx", "density", f"SELECT t.design, ty, tx, least(greatest(CASE WHEN q > 0 THEN s / q ELSE 0 END, 0.15), 1) AS density FROM (SELECT design, {T('y_um')} AS ty, {T('x_um')} AS tx, sum(area_um2) AS s FROM i GROUP BY 1, 2, 3) t LEFT JOIN (SELECT design, quantile_cont(s, 0.95) AS q FROM (SELECT design, sum(area_um2) AS s FROM i GROUP BY design, {T('y_um')}, {T('x_um')}) WHERE s > 0 GROUP BY 1) q ON t.design = q.design")
def q_strap_raster(v: Views) -> DataFrame:
    """Area per tile against the 95th percentile of its design, floored."""
    sums = _placed(v).groupBy("design", "ty", "tx").agg(F.sum("area_um2").alias("s"))
    return shares.normalised_density(sums, ["design"], "s").select("design", "ty", "tx", "density")


@query("design scenario ty tx", "drop_v", "SELECT design, scenario, fy // 4 AS ty, fx // 4 AS tx, avg(greatest(drop_v - 0.01, 0)) AS drop_v FROM r GROUP BY 1, 2, 3, 4")
def q_mean_samples(v: Views) -> DataFrame:
    shifted = v.r.withColumn("d", F.greatest(F.col("drop_v") - 0.01, F.lit(0.0)))
    return raster.block_reduce(shifted, GROUP, "d", 4).select(*GROUP, "ty", "tx", F.col("v_mean").alias("drop_v"))


@query("design inst_id", "part", "SELECT i.design, inst_id, CASE WHEN sum(w) OVER g > 0 THEN coalesce(m.rated_power_mw, 0) * w / sum(w) OVER g ELSE 0 END AS part FROM (SELECT *, area_um2 * CASE WHEN is_clk = 1 THEN 2.0 WHEN is_seq = 1 THEN 1.5 ELSE 1.0 END AS w FROM i) i JOIN m ON i.design = m.design AND i.module = m.module WINDOW g AS (PARTITION BY i.design, i.module)")
def q_power_split(v: Views) -> DataFrame:
    joined = v.i.join(v.m.select("design", "module", "rated_power_mw"), ["design", "module"])
    out = shares.weighted_split(joined, ["design", "module"], F.coalesce("rated_power_mw", F.lit(0.0)), shares.cell_weight(F.col("area_um2"), F.col("is_clk"), F.col("is_seq")))
    return out.select("design", "inst_id", "part")


@query("design scenario ty tx", "drop_v", "SELECT design, scenario, (((fy + 1) * 24 + 95) // 96) - 1 AS ty, (((fx + 1) * 24 + 95) // 96) - 1 AS tx, avg(drop_v) AS drop_v FROM r WHERE fy < 96 AND fx < 96 GROUP BY 1, 2, 3, 4")
def q_downsample(v: Views) -> DataFrame:
    maps = v.r.where("fy < 96 and fx < 96").withColumnsRenamed({"fy": "y", "fx": "x"})
    return raster.area_downsample(maps, GROUP, "drop_v", 96, N)


@query("design scenario", "total greatest mean least", "SELECT design, scenario, sum(drop_v * 1000) AS total, max(drop_v * 1000) AS greatest, avg(drop_v * 1000) AS mean, min(drop_v * 1000) AS least FROM r GROUP BY 1, 2")
def q_matrix_kpi(v: Views) -> DataFrame:
    from gridloom.sources.adapters import matrix_figures

    return matrix_figures(v.r, GROUP, "drop_v", 1000.0)


@query("scenario bin n", "share", "SELECT scenario, bin, n, n / (sum(n) OVER (PARTITION BY scenario) * 0.004) AS share FROM (SELECT scenario, least(cast(floor(drop_v / 0.004) AS integer), 49) AS bin, count(*) AS n FROM r GROUP BY 1, 2)")
def q_histogram(v: Views) -> DataFrame:
    return shares.histogram(v.r, ["scenario"], "drop_v", 0.0, 0.2, 50)


@query("design scenario ty tx", "rank", "SELECT design, scenario, ty, tx, (rank() OVER g + (count(*) OVER t - 1) / 2) / count(*) OVER e AS rank FROM f WHERE phys_base_v IS NOT NULL WINDOW g AS (PARTITION BY design, scenario ORDER BY phys_base_v), t AS (PARTITION BY design, scenario, phys_base_v), e AS (PARTITION BY design, scenario)")
def q_rank_avg(v: Views) -> DataFrame:
    return average_rank(v.f.where("phys_base_v is not null"), GROUP, "phys_base_v", "rank", True).select(*GROUP, "ty", "tx", "rank")


@query("design scenario ty tx", "centred", "SELECT design, scenario, ty, tx, label_v - avg(label_v) OVER (PARTITION BY design, scenario) AS centred FROM f")
def q_group_demean(v: Views) -> DataFrame:
    return demeaned(v.f, GROUP, "label_v").select(*GROUP, "ty", "tx", "centred")


@query("design scenario n", "q", "SELECT design, scenario, n, drop_v AS q FROM (SELECT *, row_number() OVER (PARTITION BY design, scenario ORDER BY drop_v) AS k, count(*) OVER (PARTITION BY design, scenario) AS n FROM r) WHERE k = ceil(round((n - 1) * 0.8, 9)) + 1")
def q_order_statistic(v: Views) -> DataFrame:
    return order_statistic(v.r, GROUP, "drop_v", 0.8)


_KERNEL = lambda s: "k AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-0.5 * (d / {0}) * (d / {0})) AS w FROM (SELECT unnest(range(-{1}, {1} + 1)) AS d)))".format(float(s), int(4 * s + 0.5))
_MAP = "g AS (SELECT d.design, t // 24 AS ty, t % 24 AS tx, coalesce(n, 0) AS c FROM (SELECT DISTINCT design FROM c) d CROSS JOIN (SELECT unnest(range(576)) AS t) LEFT JOIN (SELECT design, {0} AS ty, {1} AS tx, count(*) AS n FROM i GROUP BY 1, 2, 3) x ON x.design = d.design AND x.ty = t // 24 AND x.tx = t % 24)".format(T("y_um"), T("x_um"))
_MIRROR = lambda a, d: f"(CASE WHEN ((({a} + {d}) % 48) + 48) % 48 < 24 THEN ((({a} + {d}) % 48) + 48) % 48 ELSE 47 - ((({a} + {d}) % 48) + 48) % 48 END)"


def _blur(sigma: float):
    ctes = f"{_KERNEL(sigma)}, {_MAP}, h AS (SELECT t.design, t.ty, t.tx, sum(k.w * g.c) AS c FROM g t CROSS JOIN k JOIN g ON g.design = t.design AND g.tx = t.tx AND g.ty = {_MIRROR('t.ty', 'k.d')} GROUP BY 1, 2, 3)"
    return ctes, f"SELECT t.design, t.ty, t.tx, sum(k.w * h.c) AS blurred FROM h t CROSS JOIN k JOIN h ON h.design = t.design AND h.ty = t.ty AND h.tx = {_MIRROR('t.tx', 'k.d')} GROUP BY 1, 2, 3"


def _blurred(v: Views, sigma: float) -> DataFrame:
    grid = raster.full_grid(v.c.select("design").distinct(), N)
    counts = raster.densify(_placed(v).groupBy("design", "ty", "tx").agg(F.count("*").cast("double").alias("blurred")), grid, ["design", "ty", "tx"])
    return spatial.gaussian_blur(counts, ["design"], "blurred", sigma, N)


@query("design ty tx", "blurred", _blur(1.0)[1], _blur(1.0)[0])
def q_gauss_s1(v: Views) -> DataFrame:
    return _blurred(v, 1.0)


@query("design ty tx", "blurred", _blur(2.0)[1], _blur(2.0)[0])
def q_gauss_s2(v: Views) -> DataFrame:
    return _blurred(v, 2.0)


@query("design ty tx", "blurred", _blur(4.0)[1], _blur(4.0)[0])
def q_gauss_s4(v: Views) -> DataFrame:
    return _blurred(v, 4.0)


_PTS = f"b AS (SELECT DISTINCT design, {T('(y0_um + y1_um) / 2')} AS py, {T('(x0_um + x1_um) / 2')} AS px FROM c), g AS (SELECT DISTINCT design, ty, tx FROM f)"


def _centres(v: Views) -> DataFrame:
    mid = v.c.withColumn("x_um", (F.col("x0_um") + F.col("x1_um")) / 2).withColumn("y_um", (F.col("y0_um") + F.col("y1_um")) / 2)
    return raster.with_tiles(mid, "x_um", "y_um", DIE, DIE, N, "py", "px").select("design", "py", "px").distinct()


@query("design ty tx", "distance", f"SELECT g.design, ty, tx, coalesce(min(sqrt((ty - py) ** 2 + (tx - px) ** 2)), {(2 * N * N) ** 0.5!r}) AS distance FROM g LEFT JOIN b ON b.design = g.design GROUP BY 1, 2, 3", _PTS)
def q_nearest_point(v: Views) -> DataFrame:
    return spatial.nearest_distance(v.f.select("design", "ty", "tx").distinct(), _centres(v), ["design"], spatial.euclidean(), (2 * N * N) ** 0.5)


@query("design ty tx", "distance", "SELECT g.design, ty, tx, coalesce(min(2.0 * abs(ty - py) + abs(tx - px)), 24.0) AS distance FROM g LEFT JOIN b ON b.design = g.design GROUP BY 1, 2, 3", _PTS)
def q_manhattan_aniso(v: Views) -> DataFrame:
    return spatial.nearest_distance(v.f.select("design", "ty", "tx").distinct(), _centres(v), ["design"], spatial.manhattan(2.0, 1.0), float(N))


_INMAC = f"mt AS (SELECT DISTINCT design, ty AS py, tx AS px FROM (SELECT *, unnest(range(y0, y1 + 1)) AS ty FROM (SELECT design, {T('y0_um')} AS y0, {T('y1_um')} AS y1, {T('x0_um')} AS x0, {T('x1_um')} AS x1 FROM c)), unnest(range(x0, x1 + 1)) AS u(tx)), g AS (SELECT DISTINCT design, ty, tx FROM f)"


def _macro_cells(v: Views) -> DataFrame:
    return raster.covered_tiles(v.c, DIE, DIE, N).select("design", "ty", "tx").distinct()


@query("design ty tx", "pdn", "SELECT design, ty, tx, CASE WHEN d = 0 THEN 0.0 WHEN d <= 1 THEN 1.5 ELSE 3.0 END AS pdn FROM (SELECT g.design, ty, tx, coalesce(min(greatest(abs(ty - py), abs(tx - px))), 24) AS d FROM g LEFT JOIN mt ON mt.design = g.design GROUP BY 1, 2, 3)", _INMAC)
def q_halo_density(v: Views) -> DataFrame:
    held = _macro_cells(v).withColumnsRenamed({"ty": "py", "tx": "px"})
    return spatial.halo_density(spatial.nearest_distance(v.f.select("design", "ty", "tx").distinct(), held, ["design"], spatial.chebyshev(), float(N)), "distance").select("design", "ty", "tx", "pdn")


@query("design ty tx", "", "SELECT DISTINCT m.design, m.py + y.d AS ty, m.px + x.d AS tx FROM mt m CROSS JOIN (SELECT unnest(range(-2, 3)) AS d) y CROSS JOIN (SELECT unnest(range(-2, 3)) AS d) x WHERE m.py + y.d BETWEEN 0 AND 23 AND m.px + x.d BETWEEN 0 AND 23 AND NOT EXISTS (SELECT 1 FROM mt o WHERE o.design = m.design AND o.py = m.py + y.d AND o.px = m.px + x.d)", _INMAC)
def q_macro_ring(v: Views) -> DataFrame:
    return spatial.ring(_macro_cells(v), ["design"], 2, N)


@query("design scenario fy fx", "residual", "SELECT r.design, r.scenario, r.fy, r.fx, r.drop_v - f.phys_base_v AS residual FROM r JOIN f ON f.design = r.design AND f.scenario = r.scenario AND f.ty = r.fy // 4 AND f.tx = r.fx // 4")
def q_upsample_diff(v: Views) -> DataFrame:
    """Fine drops against the coarse physics map, each coarse value at its 16 fine cells."""
    # fine cells look their tile up, so that no coarse row is repeated; the hint keeps the coarse map off the driver
    coarse = v.f.select(*GROUP, "ty", "tx", "phys_base_v").hint("merge")
    return v.rt.join(coarse, [*GROUP, "ty", "tx"]).select(*GROUP, "fy", "fx", (F.col("drop_v") - F.col("phys_base_v")).alias("residual"))


@query("design ty tx", "v", "SELECT design, ty, tx, v FROM (SELECT g.design, g.ty, g.tx, o.v, row_number() OVER (PARTITION BY g.design, g.ty, g.tx ORDER BY round(sqrt((g.ty - o.ty) ** 2 + (g.tx - o.tx) ** 2), 9), o.ty, o.tx) AS k FROM (SELECT DISTINCT design, ty, tx FROM f) g JOIN (SELECT design, {0} AS ty, {1} AS tx, sum(area_um2) AS v FROM i GROUP BY 1, 2, 3) o ON o.design = g.design) WHERE k = 1".format(T("y_um"), T("x_um")))
def q_nn_fill(v: Views) -> DataFrame:
    filled = _placed(v).groupBy("design", "ty", "tx").agg(F.sum("area_um2").alias("v"))
    return spatial.fill_nearest(v.f.select("design", "ty", "tx").distinct(), filled, ["design"], "v")


@query("design inst_id donor module", "distance", "SELECT design, inst_id, donor, module, distance FROM (SELECT u.design, u.inst_id, t.inst_id AS donor, t.module, sqrt((u.x_um - t.x_um) ** 2 + (u.y_um - t.y_um) ** 2) AS distance, row_number() OVER (PARTITION BY u.design, u.inst_id ORDER BY sqrt((u.x_um - t.x_um) ** 2 + (u.y_um - t.y_um) ** 2), t.inst_id) AS k FROM (SELECT * FROM i WHERE is_seq = 0) u JOIN (SELECT * FROM i WHERE is_seq = 1) t ON t.design = u.design) WHERE k = 1")
def q_nearest_donor(v: Views) -> DataFrame:
    """The module of the nearest sequential cell for every other cell."""
    return spatial.nearest_row(v.i.where("is_seq = 0").drop("module"), v.i.where("is_seq = 1"), ["design"], None, "module", "inst_id", "inst_id")


@query("design", "pitch", "SELECT design, quantile_cont(d, 0.5) AS pitch FROM (SELECT x.design, x.macro_id, min(sqrt((x.x0_um - y.x0_um) ** 2 + (x.y0_um - y.y0_um) ** 2)) AS d FROM c x JOIN c y ON x.design = y.design AND sqrt((x.x0_um - y.x0_um) ** 2 + (x.y0_um - y.y0_um) ** 2) > 0 GROUP BY 1, 2) GROUP BY 1")
def q_median_pitch(v: Views) -> DataFrame:
    return spatial.pitch(v.c, ["design"], "macro_id", "x0_um", "y0_um").where("pitch is not null")


@query("design ty tx direction", "g", "SELECT a.design, a.ty, a.tx, 'right' AS direction, 2.0 * 0.5 * (a.c + b.c) AS g FROM g a JOIN g b ON a.design = b.design AND a.ty = b.ty AND a.tx + 1 = b.tx UNION ALL SELECT a.design, a.ty, a.tx, 'down', 2.0 * 0.5 * (a.c + b.c) FROM g a JOIN g b ON a.design = b.design AND a.ty + 1 = b.ty AND a.tx = b.tx", _MAP)
def q_mesh_edges(v: Views) -> DataFrame:
    counts = _placed(v).groupBy("design", "ty", "tx").agg(F.count("*").cast("double").alias("c"))
    return spatial.mesh_edges(raster.gathered(counts, v.c.select("design").distinct(), ["design"], N, ["c"]), ["design"], "c", 2.0, N)


@query("ty tx", "ramp", "SELECT t // 24 AS ty, t % 24 AS tx, abs(t // 24 - 12.0) / 24 + abs(t % 24 - 12.0) / 24 AS ramp FROM (SELECT unnest(range(576)) AS t)")
def q_ramp(v: Views) -> DataFrame:
    cells = raster.full_grid(v.spark.range(1), N)
    return cells.select("ty", "tx", spatial.ramp(F.col("ty"), F.col("tx"), N).alias("ramp"))


@query("design scenario module origin", "activity", "SELECT a.design, a.scenario, a.module, CASE WHEN x.activity IS NULL THEN 'assumed' ELSE 'measured' END AS origin, coalesce(x.activity, a.activity) AS activity FROM a LEFT JOIN (SELECT design, module, max(activity) AS activity FROM a WHERE scenario = 'seq_read' GROUP BY 1, 2) x ON x.design = a.design AND x.module = a.module")
def q_prefer_measured(v: Views) -> DataFrame:
    """Measured activity (here: that of the reading scenario) over the assumed one."""
    measured = v.a.where("scenario = 'seq_read'").groupBy("design", "module").agg(F.max("activity").alias("activity"))
    return shares.prefer_measured(v.a, measured, ["design", "module"], "activity").select("design", "scenario", "module", "origin", "activity")


@query("row_id n_known n_unknown", "", "SELECT row_id, count(i.inst_id) AS n_known, count(*) - count(i.inst_id) AS n_unknown FROM (SELECT row_id, d, unnest(list_filter(list_transform(string_split(inst_ids, ';'), lambda x: TRY_CAST(trim(x) AS integer)), lambda x: x IS NOT NULL)) AS id FROM (SELECT row_id, inst_ids, lower(regexp_replace(design_id, '^\\s+|\\s+$', '', 'g')) AS d FROM paths WHERE regexp_full_match(inst_ids, '[0-9]{1,9}(;[0-9]{1,9})*'))) t LEFT JOIN i ON i.design = t.d AND i.inst_id = t.id GROUP BY 1")
def q_path_members(v: Views) -> DataFrame:
    """Membership of well-written instance lists."""
    from gridloom.functions.names import clean_name

    lists = table(v.spark, v.sf, "paths").where(F.col("inst_ids").rlike(r"^[0-9]{1,9}(;[0-9]{1,9})*\z"))
    ids = lists.select("row_id", clean_name("design_id").alias("design"), F.explode(id_list(F.col("inst_ids"))).alias("inst_id"))
    hit = ids.join(v.i.select("design", "inst_id", F.lit(1).alias("hit")), ["design", "inst_id"], "left")
    return hit.groupBy("row_id").agg(F.count("hit").alias("n_known"), (F.count("*") - F.count("hit")).alias("n_unknown"))


@query("row_id n_known n_unknown", "", "SELECT p.row_id, count(i.inst_id) AS n_known, count(t.v) - count(i.inst_id) AS n_unknown FROM paths p LEFT JOIN (SELECT row_id, d, v FROM (SELECT row_id, v, lower(regexp_replace(design_id, '^\\s+|\\s+$', '', 'g')) AS d FROM ({}) WHERE regexp_full_match(v, '[0-9]+'))) t ON t.row_id = p.row_id LEFT JOIN i ON i.design = t.d AND i.inst_id = TRY_CAST(t.v AS integer) GROUP BY 1".format(_VALUES.format(keys="row_id, design_id")))
def q_path_members_all(v: Views) -> DataFrame:
    """Membership of the instance numbers of every path, however they are packed: each row_id has its counts, zero where the field
    holds no number. Names are no numbers and are not counted."""
    digits = path_values(v.spark, v.sf, ["row_id", "design_id"]).where(F.col("inst_value").rlike(r"^[0-9]+\z"))
    ids = digits.select("row_id", clean_name("design_id").alias("design"), F.col("inst_value").try_cast("int").alias("inst_id"))
    hit = ids.join(v.i.select("design", "inst_id", F.lit(1).alias("hit")), ["design", "inst_id"], "left")
    counts = hit.groupBy("row_id").agg(F.count("hit").alias("n_known"), (F.count("*") - F.count("hit")).alias("n_unknown"))
    return table(v.spark, v.sf, "paths").select("row_id").join(counts, "row_id", "left").fillna(0, ["n_known", "n_unknown"])


@query("design place module", "", "SELECT design, row_number() OVER (PARTITION BY design ORDER BY first) AS place, module FROM (SELECT design, module, min(inst_id) AS first FROM i WHERE module IS NOT NULL GROUP BY 1, 2)")
def q_first_appearance(v: Views) -> DataFrame:
    from pyspark.sql import Window as W

    found = reshape.first_appearances(v.i.where("module is not null"), ["design"], "module", ["inst_id"])
    return found.select("design", F.row_number().over(W.partitionBy("design").orderBy("inst_id")).cast("bigint").alias("place"), "module")


@query("design module side", "", "SELECT design, module, CASE WHEN x AND y THEN 'both' WHEN x THEN 'activity' ELSE 'modules' END AS side FROM (SELECT design, module, bool_or(t = 'a') AS x, bool_or(t = 'm') AS y FROM (SELECT design, module, 'a' AS t FROM a UNION SELECT design, module, 'm' FROM m) GROUP BY 1, 2)")
def q_setops(v: Views) -> DataFrame:
    """Intersection and differences of the module sets of two tables."""
    k = ["design", "module"]
    a, m = v.a.select(*k).distinct(), v.m.select(*k)
    both = a.intersect(m).withColumn("side", F.lit("both"))
    only = reshape.missing_keys(a, m, k).withColumn("side", F.lit("activity")).unionByName(reshape.missing_keys(m, a, k).withColumn("side", F.lit("modules")))
    return both.unionByName(only)


@query("design module", "rated_power_mw", "SELECT design, module, rated_power_mw FROM m WHERE (design, module) NOT IN (SELECT (design, module) FROM c WHERE module IS NOT NULL) UNION ALL SELECT design, module, sum(power_mw) FROM c WHERE module IS NOT NULL GROUP BY 1, 2")
def q_upsert(v: Views) -> DataFrame:
    """Ratings of modules replaced by the power of their macros where they have any."""
    new = v.c.where("module is not null").groupBy("design", "module").agg(F.sum("power_mw").alias("rated_power_mw"))
    return reshape.upsert(v.m.select("design", "module", "rated_power_mw"), new, ["design", "module"])


@query("design inst_id n", "", "SELECT lower(regexp_replace(design_id, '^\\s+|\\s+$', '', 'g')) AS design, inst_id, count(*) AS n FROM instances WHERE design_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(v: Views) -> DataFrame:
    from gridloom.functions.names import clean_name

    return reshape.duplicate_keys(table(v.spark, v.sf, "instances").withColumn("design", clean_name("design_id")).where("design is not null"), ["design", "inst_id"])


_SC = list(SCENARIOS)


@query("design", " ".join(_SC), "SELECT design, {} FROM f GROUP BY 1".format(", ".join(f"max(CASE WHEN scenario = '{s}' THEN label_v END) AS {s}" for s in _SC)))
def q_pivot(v: Views) -> DataFrame:
    worst = v.f.groupBy(*GROUP).agg(F.max("label_v").alias("w"))
    return reshape.wide_metrics(worst, ["design"], "scenario", "w", _SC)


@query("design scenario metric", "value", "SELECT design, scenario, metric, value FROM (SELECT design, scenario, max(label_v) AS worst, avg(label_v) AS mean, avg(phys_base_v) AS physics FROM f GROUP BY 1, 2) UNPIVOT INCLUDE NULLS (value FOR metric IN (worst, mean, physics))")
def q_long_metrics(v: Views) -> DataFrame:
    wide = v.f.groupBy(*GROUP).agg(F.max("label_v").alias("worst"), F.avg("label_v").alias("mean"), F.avg("phys_base_v").alias("physics"))
    return reshape.long_metrics(wide, GROUP, ["worst", "mean", "physics"])


@query("variant picp mpiw_mv", "", "SELECT variant, coalesce(printf('%.4f', avg(picp)), 'n/a') AS picp, coalesce(printf('%.4f', avg(mpiw_mv)), 'n/a') AS mpiw_mv FROM p GROUP BY 1")
def q_formatted(v: Views) -> DataFrame:
    means = v.p.groupBy("variant").agg(F.avg("picp").alias("picp"), F.avg("mpiw_mv").alias("mpiw_mv"))
    return reshape.formatted(means, ["picp", "mpiw_mv"])


@query("design scenario ty tx", "cur_x_weak cur_s2_x_weak conc_x_weak", "SELECT design, scenario, ty, tx, cur_sum * grid_weak AS cur_x_weak, cur_s2 * grid_weak AS cur_s2_x_weak, conc_ratio * grid_weak AS conc_x_weak FROM f")
def q_interactions(v: Views) -> DataFrame:
    w = F.col("grid_weak")
    return v.f.select(*GROUP, "ty", "tx", (F.col("cur_sum") * w).alias("cur_x_weak"), (F.col("cur_s2") * w).alias("cur_s2_x_weak"), (F.col("conc_ratio") * w).alias("conc_x_weak"))


@query("feature_group n_rows", "mean", "SELECT feature_group, count(v) AS n_rows, avg(v) AS mean FROM ({}) GROUP BY 1".format(" UNION ALL ".join(f"SELECT '{g}' AS feature_group, {c} AS v FROM f" for g, cols in FEATURE_GROUPS.items() for c in cols)))
def q_feature_groups(v: Views) -> DataFrame:
    pairs = [F.struct(F.lit(g).alias("feature_group"), F.col(c).alias("v")) for g, cols in FEATURE_GROUPS.items() for c in cols]
    return v.f.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.feature_group").agg(F.count("p.v").alias("n_rows"), F.avg("p.v").alias("mean"))


def _non_finite(v: Views, cols: list[str]) -> DataFrame:
    raw = table(v.spark, v.sf, "features")
    return raw.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in cols)).unpivot([], cols, "column_name", "n_bad")


@query("column_name n_bad", "", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR cast({c} AS varchar) IN ('nan', 'inf', '-inf')) AS n_bad FROM features" for c in ("phys_base_v", "grid_strap_mean", "cur_sum", "conc_ratio", "label_v")))
def q_non_finite(v: Views) -> DataFrame:
    return _non_finite(v, ["phys_base_v", "grid_strap_mean", "cur_sum", "conc_ratio", "label_v"])


@query("column_name n_bad", "", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR cast({c} AS varchar) IN ('nan', 'inf', '-inf')) AS n_bad FROM features" for c in (*FEATURES, "label_v")))
def q_non_finite_all(v: Views) -> DataFrame:
    """Null, NaN and infinite values of every feature and of the label."""
    return _non_finite(v, [*FEATURES, "label_v"])


@query("row_id owner seq_like digest", "", "SELECT row_id, CASE WHEN endpoint LIKE 'dpath.%' THEN 'dpath' ELSE '' END AS owner, regexp_matches(upper(endpoint), 'DFF|CLKBUF') AS seq_like, substring(sha256(endpoint), 1, 16) AS digest FROM paths WHERE endpoint IS NOT NULL")
def q_module_parse(v: Views) -> DataFrame:
    """Owner module, kind and digest of endpoint names."""
    e = F.col("endpoint")
    return table(v.spark, v.sf, "paths").where("endpoint is not null").select("row_id", module_of(e, ["dpath"], {}).alias("owner"), has_token(e, "DFF", "CLKBUF").alias("seq_like"), short_hash(e).alias("digest"))


@query("design scenario ty tx severity", "", "SELECT design, scenario, ty, tx, CASE WHEN label_v > 0.045 THEN 'violation' WHEN label_v > 0.036 THEN 'near' WHEN label_v - phys_base_v > 0.003 THEN 'biased' ELSE 'ok' END AS severity FROM f WHERE label_v IS NOT NULL")
def q_severity(v: Views) -> DataFrame:
    y = F.col("label_v")
    kind = F.when(y > 0.045, "violation").when(y > 0.036, "near").when(y - F.col("phys_base_v") > 0.003, "biased").otherwise("ok")
    return v.f.where("label_v is not null").select(*GROUP, "ty", "tx", kind.alias("severity"))


@query("clock_domain n_paths", "mean_slack share_negative", "SELECT trim(clock_domain) AS clock_domain, count(*) AS n_paths, avg(CASE WHEN cast(slack_ns AS varchar) <> 'nan' THEN slack_ns END) AS mean_slack, avg(CASE WHEN slack_ns < 0 THEN 1.0 WHEN cast(slack_ns AS varchar) <> 'nan' THEN 0.0 END) AS share_negative FROM paths WHERE clock_domain IS NOT NULL GROUP BY 1")
def q_path_slack(v: Views) -> DataFrame:
    s = finite("slack_ns")
    return table(v.spark, v.sf, "paths").where("clock_domain is not null").groupBy(trimmed("clock_domain").alias("clock_domain")).agg(F.count("*").alias("n_paths"), F.avg(s).alias("mean_slack"), F.avg(F.when(s < 0, 1.0).when(s.isNotNull(), 0.0)).alias("share_negative"))


QUERIES, ORACLE = query.queries, query.oracle
