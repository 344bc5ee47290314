"""The features of a design are made where its rows meet: as the operators make them by joins, and nothing is moved after."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import design_features, generator, mesh, ranking, raster, shares, spatial
from gridloom.operators.features import PARAMS, Bundle, design_rows, feature_table
from gridloom.plans import registry
from gridloom.sources.schema import COARSE, FEATURES, FINE, IDENTITY

DATA = "/root/testdata/sf0.001"
DIE = 800.0


def test_features_are_neither_moved_nor_staged(spark):
    df = registry.queries()["q_feature_table"](spark, DATA)
    above, made, below = df._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")
    assert made and "FlatMap" not in below and not any(x in above for x in ("Join", "Aggregate", "Sort", "Repartition"))
    assert df.inputFiles() and all(f"{DATA}/" in f for f in df.inputFiles())
    assert df.groupBy("design", "scenario").count().where("count <> 576").count() == 0


@pytest.fixture(scope="module")
def bundle(spark):
    """Odd designs: missing and negative ratings, modules that nobody knows, nulls, straps beyond the grid, a design without bumps."""
    f = {n: df.withColumnRenamed("design_id", "design") for n, df in generator.corpus(spark, [0, 1, 2], (DIE, DIE)).items()}
    nth = lambda c, k, m: F.abs(F.hash(c)) % m == k
    unrated, negative, still = sorted({r.module for r in f["instances"].select("module").distinct().collect()})[:3]
    modules = f["modules"].withColumn("rated_power_mw", F.when(F.col("module") == unrated, None).when(F.col("module") == negative, -2 * F.col("rated_power_mw")).otherwise(F.col("rated_power_mw")))
    instances = f["instances"].withColumn("module", F.when(nth("inst_id", 0, 9), None).when(nth("inst_id", 1, 9), "stranger").otherwise(F.col("module"))).withColumn("area_um2", F.when(~nth("inst_id", 2, 9), F.col("area_um2")))
    activity = f["activity"].withColumn("activity", F.when((F.col("module") != still) & (F.col("scenario") != "gc_compact"), F.col("activity")))
    activity = activity.unionByName(activity.where("scenario = 'idle'").withColumn("module", F.lit("stranger")).withColumn("activity", F.lit(0.5)).dropDuplicates(["design"]))
    macros = f["macros"].withColumn("power_mw", F.when(~nth("macro_id", 0, 3), F.col("power_mw"))).withColumn("module", F.when(nth("macro_id", 1, 3), "stranger").otherwise(F.col("module")))
    straps = f["strap_planned"].where("(fy + fx) % 7 > 0").withColumn("density", F.when((F.col("fy") + F.col("fx")) % 5 > 0, F.col("density"))).withColumn("fx", F.when(F.col("fx") == 3, 200).otherwise(F.col("fx")))
    params = modules.select("design").distinct().select("design", *(F.lit(x).alias(c) for c, x in zip(PARAMS, (DIE, DIE, 0.9, 0.4, 4.0), strict=True)))
    return Bundle(params, modules, macros, instances, f["bumps"].where("design <> 'syn_001'"), straps, activity)._replace(**{n: v.cache() for n, v in {"modules": modules, "macros": macros, "instances": instances, "straps": straps, "activity": activity}.items()})


def by_joins(b, n=COARSE, fine=FINE):
    """The same features from the operators of the library, joined tile by tile."""
    r, group, tile, key = fine // n, ["design", "scenario"], ["design", "ty", "tx"], ["design", "scenario", "ty", "tx"]
    tiled = lambda df, k, ty="ty", tx="tx": raster.with_tiles(df, "x_um", "y_um", DIE, DIE, k, ty, tx)
    act = b.activity.where("activity is not null").select(*group, "module", "activity")

    def currents(k, ty, tx):
        inst = tiled(shares.instance_currents(b.instances, b.modules, None, 0.9), k, ty, tx).select("design", ty, tx, "module", "clock_domain", "unit_a")
        rects = raster.covered_tiles(b.macros, DIE, DIE, k).join(b.modules.select("design", "module", "clock_domain"), ["design", "module"], "left")
        mac = rects.select("design", F.col("ty").alias(ty), F.col("tx").alias(tx), "module", "clock_domain", (F.coalesce("power_mw", F.lit(0.0)) * 1e-3 / 0.9 / F.col("n_tiles")).alias("unit_a"))
        return inst.unionByName(mac).join(act, ["design", "module"]).groupBy(*group, ty, tx, "clock_domain").agg(F.sum(F.col("unit_a") * F.col("activity")).alias("current_a"))

    domains = currents(n, "ty", "tx").cache()
    scenarios = b.activity.groupBy(*group).agg(F.min("mission_weight").alias("scn_weight"))
    cur = raster.densify(domains.groupBy(*key).agg(F.sum("current_a").alias("current_a")), raster.full_grid(scenarios.select(*group), n), key).cache()
    cells = currents(fine, "fy", "fx").groupBy(*group, "fy", "fx").agg(F.sum("current_a").alias("current_a")).selectExpr("*", f"cast(fy div {r} as int) ty", f"cast(fx div {r} as int) tx").cache()
    bumps = tiled(b.bumps, n).groupBy(*tile).agg(F.count("*").cast("double").alias("grid_bumps"))
    grid = raster.full_grid(b.params.select("design"), fine, "fy", "fx").join(b.straps, ["design", "fy", "fx"], "left").fillna(0.0, ["density"])
    strap = raster.block_reduce(grid, ["design"], "density", r).selectExpr(*tile, "v_mean grid_strap_mean", "v_min grid_strap_min").cache()
    held = raster.covered_tiles(b.macros, DIE, DIE, fine).select("design", F.col("ty").alias("py"), F.col("tx").alias("px"))
    away = lambda p: raster.block_reduce(spatial.distance_transform(p, ["design"], fine, 0.0), ["design"], "d", r)
    to_bump = away(tiled(b.bumps, fine, "py", "px")).selectExpr(*tile, "v_min grid_dbump_min", "v_max grid_dbump_max")
    top = raster.coverage(b.macros, ["design"], DIE, DIE, n).selectExpr(*tile, "covered top_macro_frac")
    dens = raster.densities(tiled(b.instances, n), tile, (DIE / n) ** 2).selectExpr(*tile, "util top_util", "cells top_cells", "capden top_capden", "clkden top_clkden", "seqden top_seqden")
    supplied = strap.join(bumps, tile, "left").selectExpr(*tile, "grid_strap_mean strap", "0.4D sheet", "coalesce(grid_bumps, 0) * 4 supply")
    solved = mesh.solve_designs(supplied, cur, n, weak=True).cache()
    phys = solved.where("scenario <> '__weak__'").withColumnRenamed("drop_v", "phys_base_v")
    out = ranking.average_rank(phys, group, "phys_base_v", "phys_base_rank", relative=True)
    for part in (spatial.gaussian_blurs(phys, group, "phys_base_v", {"phys_base_s1": 1.0, "phys_base_s2": 2.0}, n), cur.withColumnRenamed("current_a", "cur_sum"), spatial.gaussian_blurs(cur, group, "current_a", {"cur_s1": 1.0, "cur_s2": 2.0, "cur_s4": 4.0}, n), cells.groupBy(*key).agg(F.max("current_a").alias("cur_max_fine")), shares.concentration(cells, key, "current_a", r * r, 4), shares.domain_concentration(domains, key, "clock_domain", "current_a").withColumnsRenamed({"hhi": "sw_hhi", "topshare": "sw_topshare"})):
        out = out.join(part, key, "left")
    for part in (solved.where("scenario = '__weak__'").selectExpr(*tile, "drop_v grid_weak"), strap, bumps, to_bump, away(held).selectExpr(*tile, "v_min top_dmacro"), top, dens):
        out = out.join(part, tile, "left")
    out = out.join(scenarios, group).join(shares.power_fraction(b.activity, b.modules).withColumnRenamed("power_frac", "scn_power_frac"), group, "left")
    out = out.withColumn("conc_ratio", F.coalesce("conc_ratio", F.lit(1.0))).withColumn("conc_top4", F.coalesce("conc_top", F.lit(0.25))).withColumn("top_edge_dist", raster.edge_distance(F.col("ty"), F.col("tx"), n))
    out = out.selectExpr("*", "cur_sum * grid_weak cur_x_weak", "cur_s2 * grid_weak cur_s2_x_weak", "conc_ratio * grid_weak conc_x_weak")
    return out.fillna(0.0, [c for c in FEATURES if c != "scn_weight"]).select(*IDENTITY, *(F.col(c).cast("double") for c in FEATURES))


def numbers(df):
    got = df.toPandas().sort_values(IDENTITY).reset_index(drop=True)
    return got[IDENTITY], got[FEATURES].to_numpy(float)


def test_features_equal_those_by_joins(bundle):
    (at, got), (there, want) = numbers(feature_table(bundle)), numbers(by_joins(bundle))
    assert at.equals(there) and set(at.design) == {"syn_000", "syn_002"} and len(at) == 2 * 6 * 576
    ranks = FEATURES.index("phys_base_rank")
    close = np.isclose(got, want, rtol=1e-7, atol=1e-12, equal_nan=True)
    close[:, ranks] = np.abs(got[:, ranks] - want[:, ranks]) < 3 / 576  # near ties
    assert close.all(), [c for c, ok in zip(FEATURES, close.all(axis=0), strict=True) if not ok]
    assert (want[:, FEATURES.index("cur_sum")] < 0).any()


def test_features_are_the_same_in_parts(bundle, monkeypatch):
    """However the rows of a design are parted into batches and its scenarios into blocks."""
    rows = design_rows(bundle, FINE, COARSE).where("design = 'syn_000'").toArrow()

    def made(size):
        d = design_features.Design(FINE, COARSE, None)
        for batch in rows.combine_chunks().to_batches(size):
            d.add(batch)
        return [x.to_pandas() for x in d.features("syn_000")]

    (whole,) = made(len(rows))
    monkeypatch.setattr(design_features, "BLOCK", 4)
    parts = made(11)
    assert [len(p) for p in parts] == [4 * 576, 2 * 576]
    both = np.concatenate([p[FEATURES].to_numpy() for p in parts])
    assert np.allclose(np.delete(both, 3, axis=1), np.delete(whole[FEATURES].to_numpy(), 3, axis=1), rtol=1e-9, atol=1e-12)


def test_needs_and_rounding(bundle):
    params = dict(zip(PARAMS, (DIE, DIE, 0.9, 0.4, 4.0), strict=True))
    some = bundle._replace(params=params, straps=bundle.straps.where("design <> 'syn_002'"))
    assert set(numbers(feature_table(some))[0].design) == {"syn_000", "syn_002"}
    at, got = numbers(feature_table(some, needs=(design_features.STRAP, design_features.MACRO), digits=6))
    assert set(at.design) == {"syn_000"} and np.array_equal(got, np.round(got, 6))
