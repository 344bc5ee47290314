"""Operators on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.numeric import tile
from gridloom.functions.text import id_list, module_of
from gridloom.operators import conformal, fits, governance, mesh, metrics, ranking, raster, reshape, shares, spatial, splits
from gridloom.sources.schema import FEATURES, SCENARIOS, guard_features


def grid(spark, n):
    return raster.full_grid(spark.createDataFrame([("d",)], "design string"), n)


def test_registry():
    assert len(FEATURES) == len(set(FEATURES)) == 32
    assert abs(sum(SCENARIOS.values()) - 1) < 1e-12
    assert guard_features(FEATURES) == FEATURES
    with pytest.raises(ValueError):
        guard_features(FEATURES[1:])


def test_tile_clips(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (9.99,), (10.0,), (99.0,)], "x double")
    assert [r.t for r in df.select(tile(F.col("x"), 10.0, 4).alias("t")).collect()] == [0, 0, 3, 3, 3]


def test_blur_keeps_the_sum_and_mirrors(spark):
    point = grid(spark, 6).withColumn("v", F.when((F.col("ty") == 0) & (F.col("tx") == 0), 1.0).otherwise(0.0))
    got = spatial.gaussian_blur(point, ["design"], "v", 1.0, 6).collect()
    m = spatial.blur_matrix(1.0, 6)
    assert abs(sum(r.v for r in got) - 1) < 1e-12
    for r in got:
        assert abs(r.v - m[r.ty, 0] * m[r.tx, 0]) < 1e-15
    w = spatial.gaussian_weights(1.0)
    assert abs(m[0, 0] - (w[4] + w[3])) < 1e-15  # the cell itself and its image


def test_distance_transform_is_exact(spark):
    pts = spark.createDataFrame([("a", 1, 2), ("a", 4, 4), ("b", None, None)], "design string, py int, px int")
    got = {(r.design, r.fy, r.fx): r.d for r in spatial.distance_transform(pts, ["design"], 6, 99.0).collect()}
    for y in range(6):
        for x in range(6):
            assert abs(got["a", y, x] - min(math.hypot(y - 1, x - 2), math.hypot(y - 4, x - 4))) < 1e-12
            assert got["b", y, x] == 99.0


def test_anisotropic_distance_and_halo(spark):
    pts = spark.createDataFrame([("d", 6, 6), ("d", 18, 18)], "design string, py int, px int")
    d = {(r.ty, r.tx): r.distance for r in spatial.nearest_distance(grid(spark, 24), pts, ["design"], spatial.manhattan(2.0, 1.0), 24.0).collect()}
    assert (d[7, 6], d[6, 7]) == (2.0, 1.0)
    mac = grid(spark, 24).where("ty between 8 and 15 and tx between 8 and 15").select("design", F.col("ty").alias("py"), F.col("tx").alias("px"))
    p = {(r.ty, r.tx): r.pdn for r in spatial.halo_density(spatial.nearest_distance(grid(spark, 24), mac, ["design"], spatial.chebyshev(), 24.0), "distance").collect()}
    assert (p[12, 12], p[0, 0], p[7, 12]) == (0.0, 3.0, 1.5)


def test_nearest_row_falls_back_beyond_its_buckets(spark):
    rows = spark.createDataFrame([("d", 1, 0.0, 0.0), ("d", 2, 500.0, 500.0)], "design string, id int, x_um double, y_um double")
    donors = spark.createDataFrame([("d", 7, 1.0, 0.0, "a"), ("d", 8, 0.0, 1.0, "b")], "design string, id int, x_um double, y_um double, module string")
    got = {r.id: (r.donor, r.module) for r in spatial.nearest_row(rows, donors, ["design"], 10.0, "module", "id", "id").collect()}
    assert got == {1: (7, "a"), 2: (7, "a")}


def test_nearest_rows_by_density_equal_brute_force(spark):
    rng = np.random.RandomState(4)
    spots = lambda n, scale: [(k, i, float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.choice(["d", "d", "e"], n).tolist(), rng.rand(n) * scale, rng.rand(n) ** 4 * scale))]
    donors, rows = spots(150, 300.0), [*spots(120, 900.0), ("f", 900, 1.0, 1.0)]
    donors += [("e", 500, 3.0, 3.0), ("e", 501, 3.0, 3.0)]
    df = lambda r: spark.createDataFrame(r, "design string, id int, x_um double, y_um double")
    far = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    got = {r.id: (r.donor, r.module) for r in spatial.nearest_row(df(rows), df(donors).withColumn("module", F.col("id") + 1), ["design"], None, "module", "id", "id").collect()}
    best = {a[1]: min((far(a, b), b[1]) for b in donors if b[0] == a[0])[1] for a in rows if a[0] != "f"}
    assert got == {i: (b, b + 1) for i, b in best.items()}
    near = {k: [min(far(a, b) for b in donors if b[0] == k and far(a, b) > 0) for a in donors if a[0] == k] for k in "de"}
    pitches = {r.design: r.pitch for r in spatial.pitch(df([*donors, ("g", 1, 2.0, 2.0), ("g", 2, 2.0, 2.0)]), ["design"], "id").collect()}
    assert pitches == {"d": pytest.approx(np.median(near["d"])), "e": pytest.approx(np.median(near["e"])), "g": None}


def test_label_is_the_greatest(spark):
    fine = spark.createDataFrame([("d", 0, 0, 0.1), ("d", 0, 3, 0.3), ("d", 3, 3, 0.2), ("d", 4, 0, 0.9)], "design string, fy int, fx int, v double")
    got = {(r.ty, r.tx): (r.v_max, r.n_cells) for r in raster.block_reduce(fine, ["design"], "v", 4).collect()}
    assert got == {(0, 0): (0.3, 3), (1, 0): (0.9, 1)}


def test_overlapping_macros_count_once(spark):
    rects = spark.createDataFrame([("d", 0.0, 0.0, 5.0, 10.0), ("d", 0.0, 0.0, 10.0, 5.0)], "design string, x0_um double, y0_um double, x1_um double, y1_um double")
    assert [r.covered for r in raster.coverage(rects, ["design"], 10.0, 10.0, 1).collect()] == [0.75]


def test_idle_limits(spark):
    fine = spark.createDataFrame([("d", 0.0), ("d", 0.0), ("e", 4.0), ("e", 0.0)], "t string, v double")
    got = {r.t: (r.conc_ratio, r.conc_top) for r in shares.concentration(fine, ["t"], "v").collect()}
    assert got == {"d": (1.0, 0.25), "e": (16.0, 1.0)}


def mesh_of(n, sheet=1.0, bump=10.0):
    supply = np.zeros((n, n))
    supply[n // 2, n // 2] = bump
    return mesh.Mesh.of_straps(np.ones((n, n)), sheet, supply)


def test_mesh_is_linear_symmetric_and_exact():
    a, i = mesh_of(31), np.full((31, 31), 1e-3)
    u = a.solve(i)
    assert a.residual(u, i) < 1e-12
    assert np.allclose(u, u.T) and np.allclose(u, u[::-1, ::-1])
    assert u[15, 15] == u.min()
    assert np.allclose(a.solve(2 * i), 2 * u)
    assert np.allclose(mesh_of(31, 2.0, 20.0).solve(i), u / 2)
    parts = np.random.RandomState(0).rand(31, 31, 3)
    assert np.abs(a.solve(parts).sum(axis=2) - a.solve(parts.sum(axis=2))).max() < 1e-10
    s = a.scaled_to(i, 0.045)
    assert abs(mesh_of(31, s, 10 * s).solve(i).max() - 0.045) < 1e-12
    with pytest.raises(ValueError):
        mesh.Mesh.of_straps(np.ones((3, 3)), 1.0, np.zeros((3, 3)))
    with pytest.raises(ValueError):
        a.solve(np.zeros(5))


def test_conformal_covers_its_calibration_set(spark):
    y = np.random.RandomState(0).randn(2000)
    df = spark.createDataFrame([("r", float(v), -0.2, 0.2) for v in y], "run string, y double, lo double, hi double")
    q = conformal.conformal_shift(df, ["run"], "y", "lo", "hi").first()["shift"]
    assert np.mean((y >= -0.2 - q) & (y <= 0.2 + q)) >= 0.8
    e = np.maximum(-0.2 - y, y - 0.2)
    assert q == np.quantile(e, min(1.0, math.ceil(2001 * 0.8) / 2000), method="higher")
    assert conformal.conformal_shift(df.where("y > 99"), ["run"], "y", "lo", "hi").count() == 0


def test_measures(spark):
    df = spark.createDataFrame([("a", 0.010, 0.011)] * 100, "g string, y double, p double")
    c = df.groupBy("g").agg(*(m.alias(n) for n, m in metrics.confusion(F.col("y"), F.col("p"), 0.045).items()))
    r = c.select(metrics.f_beta(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), metrics.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 1.5, None).alias("f15")).first()
    assert (r.f1, r.f15) == (0.0, None)
    assert metrics.spearman(df, ["g"], "p", "y").first()["spearman"] is None
    counts = spark.createDataFrame([(726, 174, 88, 673, 42, 141)], "a int, b int, c int, d int, e int, f int")
    beta = counts.select(metrics.crossover(*(F.col(x) for x in "abcdef")).alias("b")).first()["b"]
    assert abs(beta - 1.41688) < 1e-4


def test_an_affine_map_keeps_ranks(spark):
    rng = np.random.RandomState(1)
    x = rng.rand(200)
    df = spark.createDataFrame([("g", float(a), float(1.3 * a + b), float(0.003 + 1.38 * a)) for a, b in zip(x, rng.rand(200) / 10)], "g string, p double, y double, q double")
    one, two = (metrics.spearman(df, ["g"], c, "y").first()["spearman"] for c in ("p", "q"))
    assert abs(one - two) < 1e-12


def test_average_ranks_and_curves(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 5.0)], "k string, v double")
    assert sorted(r["rank"] for r in ranking.average_rank(df, ["k"], "v").collect()) == [1.0, 2.5, 2.5, 4.0]
    hit = spark.createDataFrame([("g", True, 0.9), ("g", False, 0.8), ("g", True, 0.7)], "k string, h boolean, s double")
    assert abs(ranking.average_precision(hit, ["k"], "h", "s").first()["average_precision"] - (0.5 + 0.5 * 2 / 3)) < 1e-12
    assert ranking.average_precision(hit.where("h"), ["k"], "h", "s").first()["average_precision"] is None


def test_splits():
    names = [f"syn_{i:03d}" for i in range(14)]
    hold, pool = splits.holdout(names, 3)
    assert len(hold) == 3 and not set(hold) & set(pool)
    made = list(splits.runs(pool, 3, 5, [0, 1, 2, 3, 4]))
    assert len({tuple(c) for _, _, _, c in made}) == len(made) == 25
    assert made[0][3] == ["syn_002", "syn_005", "syn_012"]
    with pytest.raises(RuntimeError):
        list(splits.runs(["a", "b"], 1, 5, [0]))


def test_fits(spark):
    df = spark.createDataFrame([("g", float(x), 3.0 * x**2) for x in range(1, 9)], "k string, x double, y double")
    r = fits.loglog(df, ["k"], "x", "y").first()
    assert abs(r.slope - 2) < 1e-9 and abs(r.intercept - math.log(3)) < 1e-9
    flat = df.withColumn("x", F.lit(1.0)).groupBy("k").agg(*(c.alias(n) for n, c in fits.line("x", "y").items())).first()
    assert flat.slope is None


def test_text_functions(spark):
    df = spark.createDataFrame([("top.u_core[3]/x", "1; 2;;x"), ("a/b", "")], "n string, p string")
    got = df.select(module_of(F.col("n"), ["core"], {"b": "core_b"}).alias("m"), id_list(F.col("p")).alias("i")).collect()
    assert [r.m for r in got] == ["core", "core_b"]
    assert [r.i for r in got] == [[1, 2, None], []]


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 2), (None, 3)], [("b", 9)]))
    assert sorted(((r.k or ""), r.v) for r in reshape.upsert(old, new, ["k"]).collect()) == [("", 3), ("a", 1), ("b", 9)]


def test_leakage_is_found(spark):
    bad = spark.read.parquet("/root/testdata/sf0.001/irmap.parquet").select("design_id", "fy")
    with pytest.raises(governance.LeakageError):
        governance.assert_no_leakage(bad.select("fy"))
    good = spark.read.parquet("/root/testdata/sf0.001/modules.parquet").select("module")
    assert governance.assert_no_leakage(good) is good


def test_spread_ranks_equal_plain_ones(spark):
    rng = np.random.RandomState(2)
    rows = [(k, float(v), float(y), i) for i, (k, v, y) in enumerate(zip(rng.choice(["a", "a", "a", "b"], 900).tolist(), np.where(rng.rand(900) < 0.4, 3.0, rng.randint(0, 60, 900)), rng.randint(0, 9, 900) / 8.0))]
    rows += [("c", 1.0, 0.5, 900), (None, 1.0, 0.5, 901), (None, 2.0, 0.5, 902), ("b", None, 0.1, 903), ("b", float("nan"), 0.1, 904)]
    df = spark.createDataFrame(rows, "k string, v double, y double, i int")
    plain = lambda d: sorted(map(str, d.collect()))
    assert ranking.Ranges(df, ["k"], "v", 8).frequent
    for n in (8, 50):
        assert plain(ranking.average_rank(df, ["k"], "v", relative=True, spread=True, ranges=n)) == plain(ranking.average_rank(df, ["k"], "v", relative=True))
        known = df.where("v is not null and not isnan(v)")
        assert plain(metrics.spearman(known, ["k"], "v", "y", True, n).withColumn("spearman", F.round("spearman", 9))) == plain(metrics.spearman(known, ["k"], "v", "y").withColumn("spearman", F.round("spearman", 9)))
        for level in (0.0, 0.3, 0.5, 0.97, 1.0):
            assert plain(ranking.order_statistic(known, ["k"], "v", level, spread=True, ranges=n)) == plain(ranking.order_statistic(known, ["k"], "v", level))
        hit = known.withColumn("h", F.col("y") > 0.6)
        assert plain(ranking.precision_recall(hit, ["k"], "h", "v", True, n)) == plain(ranking.precision_recall(hit, ["k"], "h", "v"))
        by = known.withColumnRenamed("k", "g")  # the result has a column k
        assert plain(ranking.top_share_hit(by, ["g"], "y", "v", ["i"], 0.2, True, n)) == plain(ranking.top_share_hit(by, ["g"], "y", "v", ["i"], 0.2))
    assert ranking.average_rank(df.limit(0), ["k"], "v", spread=True).count() == 0
    with pytest.raises(ValueError):
        ranking.Ranges(spark.range(2000).withColumn("v", F.col("id")), ["id"], "v")


def test_floorplans_follow_weights():
    from gridloom.operators.generator import slices

    weights = np.random.RandomState(1).dirichlet(np.full(9, 2.0))
    rects = np.array(slices(30.0, 20.0, weights))
    area = (rects[:, 2] - rects[:, 0]) * (rects[:, 3] - rects[:, 1])
    assert np.allclose(area, weights * 600)
    assert slices(3.0, 2.0, np.array([1.0])) == [(0.0, 0.0, 3.0, 2.0)] and slices(3.0, 2.0, np.array([])) == []
