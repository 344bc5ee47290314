import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import gates, models, pipeline, resample, splits
from gridloom.sources import bundles
from gridloom.sources.schema import FEATURES


@pytest.fixture(scope="module")
def features(spark):
    rng, rows = np.random.RandomState(0), []
    for d in range(8):
        for t in range(60):
            x = rng.rand(32) * 0.06
            y = 1.3 * x[0] + 0.2 * x[5] + rng.randn() * 0.001
            rows.append((f"d{d}", "idle", t // 24, t % 24, *map(float, x), float(y)))
    schema = "design string, scenario string, ty int, tx int, " + ", ".join(f"{c} double" for c in FEATURES) + ", label_v double"
    return spark.createDataFrame(rows, schema).cache()


def test_runs_validation_and_report(spark, features, tmp_path):
    hold, pool = splits.holdout([f"d{i}" for i in range(8)], 2)
    runs = splits.run_table(spark, pool, 2, 1, [0, 1])
    got = pipeline.train_runs(features, runs, hold, ("physics_only", "physics_affine", "hybrid"), iterations=3, depth=3)
    assert got.count() == 6
    by = {(r.variant, r.seed): r for r in got.collect()}
    assert by["physics_affine", 0].mae < by["physics_only", 0].mae
    assert by["physics_only", 0].picp is None and 0.5 < by["hybrid", 0].picp <= 1
    table = pipeline.validation_table(got)
    text = pipeline.report(table, str(tmp_path / "r.md"))
    assert {r.check: r.ok for r in gates.model_gates(table).collect()}["mae affine minus physics"]
    moved = pipeline.transfer(features, models.fit_variant(features, "physics_affine"), features, [])
    assert {r.pass_name for r in moved.collect()} == {"as_trained", "recalibrated"}
    assert {r.check: r.ok for r in gates.feature_gates(features).collect()}["values not finite"]
    assert "n/a" in text and text.startswith("| variant | mae")


def test_saved_variants_predict_alike(spark, features, tmp_path):
    fitted = models.fit_variant(features, "learned_only", iterations=2, depth=2)
    assert not any(c.startswith("phys_") for c in models.columns_of("learned_only"))
    pipeline.save_variant(fitted, str(tmp_path / "m"), spark)
    again = pipeline.load_variant(str(tmp_path / "m"), spark)
    a, b = (sorted((r.design, r.ty, r.tx, r.pred_v, r.q_low_v) for r in models.predict_variant(features, f).collect()) for f in (fitted, again))
    assert a == b and len(a) == features.count()
    line = models.fit_variant(features, "physics_affine")
    pipeline.save_variant(line, str(tmp_path / "l"), spark)
    assert pipeline.load_variant(str(tmp_path / "l"), spark)[:3] == line[:3]


def test_prediction_table_round_trip(spark, features, tmp_path):
    scored = pipeline.score(features, models.fit_variant(features, "physics_affine"), features)
    parts = spark.createDataFrame([(f"d{i}", "train") for i in range(7)], "design string, partition string")
    table = pipeline.predictions(scored, parts)
    assert models.prediction_faults(table).count() == 0
    assert table.where("partition = 'uploaded'").count() == 60
    bundles.write_predictions(table, str(tmp_path / "p"), "made by a test")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    assert bundles.read_predictions(spark, str(tmp_path / "p"), schema).count() == table.count()
    bad = table.withColumn("lo_v", F.lit(9.0))
    assert [r.check for r in models.prediction_faults(bad).collect()] == ["band without prediction"]


def test_permutation_keeps_values_together(spark, features):
    rows = features.withColumn("rid", F.concat_ws("/", "design", "ty", "tx"))
    moved = resample.permuted(rows, "rid", FEATURES[:2], 1, 0, ["design"])
    pairs = lambda df: sorted((r[0], r[1], r[2]) for r in df.select("design", *FEATURES[:2]).collect())
    assert pairs(moved) == pairs(rows)
    same = moved.join(rows.select("rid", F.col(FEATURES[0]).alias("old")), "rid").where(F.col(FEATURES[0]) == F.col("old")).count()
    assert same < 60
