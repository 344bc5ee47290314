"""Queries that must cover every row, column, group or design."""

from datetime import datetime

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.operators import mesh, models
from gridloom.plans import registry
from gridloom.plans.base import BUDGET_V, N, Views
from gridloom.sources.schema import FEATURE_GROUPS, FEATURES

DATA = "/root/testdata/sf0.001"


def written(spark, directory, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{directory}/{name}.parquet")


def test_every_path_has_its_members(spark, tmp_path):
    at = datetime(2024, 1, 1)
    lists = ["7;8", "7|8/9", "[7, '8']", "007 -> 99999999999", "u_a/b", "", None]
    written(spark, tmp_path, "paths", [(i, " D1", x, at) for i, x in enumerate(lists)], "row_id long, design_id string, inst_ids string, loaded_at timestamp")
    inst = [("d1", k, f"u{k}", "m", 1.0, 1.0, 1.0, 1.0, 0, 0, 0, None) for k in (7, 8)]
    written(spark, tmp_path, "instances", inst, "design_id string, inst_id int, inst_name string, module string, x_um double, y_um double, area_um2 double, cap_ff double, is_seq int, is_clk int, is_macro int, deleted_at timestamp")
    got = sorted(tuple(r) for r in registry.queries()["q_path_members_all"](spark, str(tmp_path)).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (2, 2, 0), (3, 1, 1), (4, 0, 0), (5, 0, 0), (6, 0, 0)]


def test_tiles_with_nulls_or_without_label_are_scored(spark):
    part = Views(spark, DATA).f.where("pmod(xxhash64(design), 5) = 0")
    assert part.where("label_v is null or " + " or ".join(f"{c} is null" for c in FEATURES)).count() > 0
    got = registry.queries()["q_gbt_score"](spark, DATA)
    assert got.count() == part.count()
    assert got.where("pred_v is null or q_low_v is null or q_high_v is null or isnan(pred_v)").count() == 0


def test_null_is_told_from_its_median(spark):
    rows = [(*[0.01 * (i % 7)] * 32, 0.03 if i % 10 else 0.09) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", label_v double")
    df = df.withColumn("cur_sum", F.when(F.col("label_v") < 0.05, F.col("cur_sum")))  # null just where the label is great
    fitted = models.fit_variant(df.withColumn("cur_max_fine", F.lit(float("nan"))), "learned_only", iterations=10, depth=3)
    got = models.predict_variant(df.withColumn("cur_max_fine", F.lit(None).cast("double")), fitted)
    assert got.count() == 400 and got.where("abs(pred_v - label_v) > 0.02").count() == 0


def test_importance_has_all_groups_and_finds_the_one_that_counts(spark):
    rng = np.random.RandomState(3)
    rows = [(f"r{i}", *map(float, x), float(x[0] + 0.5 * x[30])) for i, x in enumerate(rng.rand(600, 32) * 0.1)]
    df = spark.createDataFrame(rows, "rid string, " + ", ".join(f"{c} double" for c in FEATURES) + ", label_v double").withColumn("top_util", F.when(F.col("cur_sum") > 0.01, F.col("top_util")))
    fitted = models.fit_variant(df, "hybrid", iterations=5, depth=3)
    each = models.permutation_importance(df, fitted, FEATURE_GROUPS, "rid", block_rows=250).collect()
    assert sorted((r.feature_group, r.repeat) for r in each) == sorted((g, k) for g in FEATURE_GROUPS for k in range(10))
    mean = {g: np.mean([r.increase for r in each if r.feature_group == g]) for g in FEATURE_GROUPS}
    assert max(mean, key=mean.get) == "scn" and mean["scn"] > 0.005 and abs(mean["sw"]) < 0.001
    # the arrays predict as the model does
    trees, x = models.trees_of(fitted.median), models._assembled(df, "hybrid", fitted.fills).select("rid", vector_to_array("_x").alias("x")).orderBy("rid").collect()
    got = sum(trees.predict(np.array([r.x for r in x]), t) for t in range(len(trees.value)))
    want = [r.w for r in models.predict_variant(df, fitted).orderBy("rid").select((F.col("pred_v") - F.col("phys_base_v")).alias("w")).collect()]
    assert np.abs(got - want).max() < 1e-12


def test_importance_query_has_all_groups(spark):
    got = registry.queries()["q_perm_importance"](spark, DATA).collect()
    assert {r.feature_group for r in got} == set(FEATURE_GROUPS) and all(r.increase_mv is not None for r in got)


def test_mesh_queries_solve_the_production_mesh(spark, monkeypatch):
    sizes, solve = [], mesh.solve_designs
    monkeypatch.setattr(mesh, "solve_designs", lambda cells, currents, n, *a, **k: sizes.append(n) or solve(cells, currents, n, *a, **k))
    run = lambda q: registry.queries()[q](spark, DATA)
    peak = {r.design: r.peak for r in run("q_mesh_solve").where("scenario <> '__weak__'").groupBy("design").agg(F.max("drop_v").alias("peak")).collect()}
    scale = {r.design: r.scale for r in run("q_calibration").collect()}
    assert scale.keys() == peak.keys() and all(abs(scale[d] - peak[d] / (BUDGET_V * 0.9)) < 1e-4 for d in peak)
    swept = {r.design: r.peak_v for r in run("q_ratio_sweep").where("ratio = 10").collect()}
    assert swept.keys() == peak.keys() and all(abs(swept[d] - peak[d]) < 1e-5 for d in peak)
    for q in ("q_mesh_residual", "q_influence_solve"):
        assert run(q).count() > 0
    assert set(sizes) == {N}


def test_non_finite_counts_every_measure(spark, tmp_path):
    rows = [(*[bad] * 32, 1.0) for bad in (None, float("nan"), float("inf"), -float("inf"), 0.5)]
    written(spark, tmp_path, "features", rows, ", ".join(f"{c} double" for c in FEATURES) + ", label_v double")
    got = {r.column_name: r.n_bad for r in registry.queries()["q_non_finite_all"](spark, str(tmp_path)).collect()}
    assert got == {c: 4 for c in FEATURES} | {"label_v": 0}


def test_splits_hold_every_design(spark):
    designs = {r[0] for r in Views(spark, DATA).f.select("design").distinct().collect()}
    part = {r.design: r.part for r in registry.queries()["q_split_holdout_all"](spark, DATA).collect()}
    pool = {d for d, p in part.items() if p == "pool"}
    assert part.keys() == designs and len(designs - pool) == 3
    runs = {}
    for r in registry.queries()["q_split_runs_all"](spark, DATA).collect():
        runs.setdefault((r.seed, r.fold), {})[r.design] = r.partition
    assert len(runs) == 25 and all(x.keys() == pool and list(x.values()).count("calib") == 3 for x in runs.values())
