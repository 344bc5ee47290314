"""Training over many splits, scoring of designs, and the report of a validation."""

from __future__ import annotations

from pathlib import Path

from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import metrics, models
from gridloom.operators.conformal import apply_shift, conformal_shift, monotone
from gridloom.operators.fits import line
from gridloom.operators.raster import tile_id
from gridloom.operators.reshape import long_metrics
from gridloom.session import stage
from gridloom.sources.schema import BUDGET_V, COARSE

MEASURES = ["mae", "rmse", "bias", "r2", "f1", "recall", "precision", "picp", "mpiw"]


def measured(scored: DataFrame, keys: list[str], budget: float = BUDGET_V) -> DataFrame:
    """All measures of scored rows (label_v, pred_v, lo_v, hi_v) in one aggregation."""
    y, p = F.col("label_v"), F.col("pred_v")
    by = scored.groupBy(*keys).agg(
        *(c.alias(n) for n, c in metrics.errors(y, p).items()), metrics.r_squared("label_v", "pred_v").alias("r2"),
        *(c.alias(n) for n, c in metrics.coverage(y, F.col("lo_v"), F.col("hi_v")).items()), *(c.alias(n) for n, c in metrics.confusion(y, p, budget).items()),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by.select(*keys, "mae", "rmse", "bias", "r2", metrics.f_beta(tp, fp, fn).alias("f1"), metrics.recall(tp, fn).alias("recall"), metrics.precision(tp, fp).alias("precision"), "picp", "mpiw")


def score(df: DataFrame, fitted: models.Variant, calibration: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Predictions with a conformal band whose shift comes from the calibration rows alone."""
    out = models.predict_variant(df, fitted)
    if fitted.median is None:
        return out.withColumn("lo_v", F.lit(None).cast("double")).withColumn("hi_v", F.lit(None).cast("double"))
    known = models.predict_variant(calibration, fitted).where("label_v is not null").withColumn("one", F.lit(1))
    row = conformal_shift(known, ["one"], "label_v", "q_low_v", "q_high_v", alpha).first()  # one number
    shift = F.lit(row["shift"] if row else 0.0)
    low, high = apply_shift(F.col("q_low_v"), F.col("q_high_v"), shift)
    low, high = monotone(low, F.col("pred_v"), high)
    return out.withColumn("lo_v", low).withColumn("hi_v", high)


def train_runs(features: DataFrame, runs: DataFrame, holdout: list[str], variants: tuple[str, ...] = models.VARIANTS, **fit: object) -> DataFrame:
    """Measures of every run and variant on the held-out designs: seed, fold, variant and the measures. ``runs``: seed,
    fold, design, partition. Fits follow each other; each is a distributed job. The run list is one row a run."""
    test = features.where(F.col("design").isin(holdout))
    out = None
    for r in runs.select("seed", "fold").distinct().orderBy("seed", "fold").collect():
        of = lambda part: features.join(F.broadcast(runs.where((F.col("seed") == r["seed"]) & (F.col("fold") == r["fold"]) & (F.col("partition") == part)).select("design")), "design", "left_semi")  # noqa: B023, E731
        for variant in variants:
            fitted = models.fit_variant(of("train"), variant, **fit)
            one = measured(score(test, fitted, of("calib")).withColumn("variant", F.lit(variant)), ["variant"]).withColumn("seed", F.lit(r["seed"])).withColumn("fold", F.lit(r["fold"]))
            one = stage(one, "run")  # one row, so that no plan grows with the runs
            out = one if out is None else out.unionByName(one)
    return out


def line_runs(features: DataFrame, runs: DataFrame, holdout: DataFrame, label: str = "label_v") -> DataFrame:
    """Measures of the physics variants over all runs at once: lines are fitted by one aggregation over (run, training
    row), and the held-out rows (of the designs in ``holdout``) meet the few fits. seed, fold, variant and measures."""
    run = ["seed", "fold"]
    train = features.where(F.col(label).isNotNull()).join(runs.where("partition = 'train'").select(*run, "design"), "design")
    fits = train.groupBy(*run).agg(*(c.alias(f"_{n}") for n, c in line(models.PHYSICS, label).items() if n in ("slope", "intercept")))
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), p.alias("pred_v")) for n, p in (("physics_only", F.col(models.PHYSICS)), ("physics_affine", F.col(models.PHYSICS) * F.col("_slope") + F.col("_intercept"))))))
    test = features.join(holdout.select("design"), "design", "left_semi").join(F.broadcast(fits), F.lit(True))  # a row a run
    none = F.lit(None).cast("double")
    scored = test.select(*run, label, both.alias("s")).select(*run, F.col(label).alias("label_v"), "s.*", none.alias("lo_v"), none.alias("hi_v"))
    return measured(scored, [*run, "variant"])


def validation_table(runs: DataFrame) -> DataFrame:
    """variant, metric, split, mean, std over runs, in long form."""
    long = long_metrics(runs, ["variant", "seed", "fold"], MEASURES).where("value is not null")
    return long.groupBy("variant", "metric").agg(F.lit("holdout_runs").alias("split"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_runs"))


def predictions(scored: DataFrame, partitions: DataFrame, n: int = COARSE) -> DataFrame:
    """The table of predictions for exchange: design, scenario, partition, tile_id, pred_v, lo_v, hi_v, label_v, coarse_v.
    Designs without a partition are ``uploaded``."""
    out = scored.join(partitions, "design", "left").withColumn("partition", F.coalesce("partition", F.lit("uploaded"))).withColumn("tile_id", tile_id(F.col("ty"), F.col("tx"), n))
    return out.select("design", "scenario", "partition", "tile_id", "pred_v", F.coalesce("lo_v", "pred_v").alias("lo_v"), F.coalesce("hi_v", "pred_v").alias("hi_v"), "label_v", F.col("phys_base_v").alias("coarse_v"))


def save_variant(fitted: models.Variant, directory: str, spark: SparkSession) -> None:
    """Writes a fitted variant; :func:`load_variant` reads it."""
    spark.createDataFrame([(fitted.name, fitted.slope, fitted.intercept)], "name string, slope double, intercept double").write.mode("overwrite").parquet(f"{directory}/head")
    if fitted.median is not None:
        fitted.median.write().overwrite().save(f"{directory}/median")
        fitted.tree.write().overwrite().save(f"{directory}/tree")
        fitted.bands.write.mode("overwrite").parquet(f"{directory}/bands")
        spark.createDataFrame(list(fitted.fills.items()), "feature string, fill double").write.mode("overwrite").parquet(f"{directory}/fills")


def load_variant(directory: str, spark: SparkSession) -> models.Variant:
    head = spark.read.parquet(f"{directory}/head").first()
    if head["slope"] is not None:
        return models.Variant(head["name"], head["slope"], head["intercept"])
    fills = {r["feature"]: r["fill"] for r in spark.read.parquet(f"{directory}/fills").collect()}  # a row a feature
    return models.Variant(head["name"], None, None, GBTRegressionModel.load(f"{directory}/median"), DecisionTreeRegressionModel.load(f"{directory}/tree"), spark.read.parquet(f"{directory}/bands"), fills)


def report(validation: DataFrame, path: str | None = None) -> str:
    """The validation as a Markdown table, a row a variant; undefined measures are ``n/a``. The table is small: one
    number a variant and metric."""
    rows = {(r["variant"], r["metric"]): r["mean"] for r in validation.collect()}
    variants, names = sorted({v for v, _ in rows}), [m for m in MEASURES if any(k[1] == m for k in rows)]
    cell = lambda v, m: "n/a" if rows.get((v, m)) is None else f"{rows[v, m]:.4f}"
    lines = ["| variant | " + " | ".join(names) + " |", "|-" * (len(names) + 1) + "|", *(f"| {v} | " + " | ".join(cell(v, m) for m in names) + " |" for v in variants)]
    text = "\n".join(lines) + "\n"
    if path:
        Path(path).write_text(text)
    return text


def transfer(features: DataFrame, fitted: models.Variant, calibration: DataFrame, keys: list[str] = ["design"]) -> DataFrame:  # noqa: B006
    """Measures of unseen designs in two passes: ``as_trained``, and ``recalibrated`` with the physics scaled to each
    design's labels by least squares through the origin (a bound, since it uses the labels)."""
    from gridloom.operators.fits import through_origin

    k = features.where("label_v is not null").groupBy("design").agg(through_origin("phys_base_v", "label_v").alias("_k"))
    scaled = ["phys_base_v", "phys_base_s1", "phys_base_s2", "grid_weak", "cur_x_weak", "cur_s2_x_weak", "conc_x_weak"]
    moved = features.join(k, "design").where("_k > 0").withColumns({c: F.col(c) / F.col("_k") for c in scaled}).drop("_k")
    passes = [measured(score(df, fitted, calibration).withColumn("pass_name", F.lit(name)), ["pass_name", *keys]) for name, df in (("as_trained", features), ("recalibrated", moved))]
    return passes[0].unionByName(passes[1])
