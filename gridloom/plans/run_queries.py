"""Training over runs, scoring of unseen designs, the prediction contract, transfer and the bootstrap of designs.

Designs fall into parts by a digest of their names, so that SQL can draw the same parts; the seeded parts of
:mod:`gridloom.operators.splits` are drawn by q_split_runs_all and its like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import conformal, models, pipeline, resample
from gridloom.plans.base import BUDGET_V, Register, Views
from gridloom.session import stage

query = Register()
GROUP = ["design", "scenario"]
_OK = "k AS (SELECT * FROM f WHERE label_v IS NOT NULL AND phys_base_v IS NOT NULL)"


def draw(*parts: Column) -> Column:
    """A number of 32 bits from a digest of text."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("bigint")


def sql_draw(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 8) AS bigint)"


def _known(v: Views) -> DataFrame:
    return stage(v.f.where("label_v is not null and phys_base_v is not null").select(*GROUP, "ty", "tx", "phys_base_v", "label_v"), "known")


def _runs(designs: DataFrame, seeds: int = 5, folds: int = 5) -> DataFrame:
    """Twenty-five runs over the pool: seed, fold, design, partition (a fifth calibrates)."""
    pool = designs.where(draw(F.lit("holdout"), F.col("design")) % 10 > 0)
    each = pool.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    calib = draw(F.col("seed").cast("string"), F.col("fold").cast("string"), F.col("design")) % 5 == 0
    return each.select("seed", "fold", "design", F.when(calib, "calib").otherwise("train").alias("partition"))


_MEASURES = """avg(abs(pred_v - label_v)) * 1000 AS mae, sqrt(avg((pred_v - label_v) ** 2)) * 1000 AS rmse, avg(pred_v - label_v) * 1000 AS bias,
  CASE WHEN var_pop(label_v) * count(*) > 1e-18 THEN 1 - sum((label_v - pred_v) ** 2) / (var_pop(label_v) * count(*)) END AS r2,
  CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision"""
for _name, _test in {"tp": "label_v > 0.045 AND pred_v > 0.045", "fp": "label_v <= 0.045 AND pred_v > 0.045", "fn": "label_v > 0.045 AND pred_v <= 0.045"}.items():
    _MEASURES = _MEASURES.replace(f"* {_name} ", f"* count(*) FILTER ({_test}) ").replace(f" {_name} ", f" count(*) FILTER ({_test}) ").replace(f" {_name})", f" count(*) FILTER ({_test}))").replace(f"({_name} ", f"(count(*) FILTER ({_test}) ")

_FITS = f"""{_OK}, rn AS (SELECT s AS seed, f AS fold, design, CASE WHEN {sql_draw('cast(s AS varchar)', 'cast(f AS varchar)', 'design')} % 5 = 0 THEN 'calib' ELSE 'train' END AS part
    FROM (SELECT DISTINCT design FROM k) d, (SELECT unnest(range(5)) AS s), (SELECT unnest(range(5)) AS f) WHERE {sql_draw("'holdout'", 'design')} % 10 > 0),
  ft AS (SELECT seed, fold, regr_slope(label_v, phys_base_v) AS a, regr_intercept(label_v, phys_base_v) AS b FROM k JOIN rn USING (design) WHERE part = 'train' GROUP BY 1, 2),
  sc AS (SELECT seed, fold, variant, label_v, CASE variant WHEN 'physics_only' THEN phys_base_v ELSE a * phys_base_v + b END AS pred_v
    FROM k, ft, (SELECT unnest(['physics_only', 'physics_affine']) AS variant) WHERE {sql_draw("'holdout'", 'design')} % 10 = 0)"""


@query("seed fold variant", "mae rmse bias r2 f1 recall precision", f"SELECT cast(seed AS integer) AS seed, cast(fold AS integer) AS fold, variant, {_MEASURES} FROM sc GROUP BY 1, 2, 3", _FITS)
def q_train_runs(v: Views) -> DataFrame:
    """Measures of twenty-five runs of the physics variants on the designs held out: all runs in one plan."""
    known = _known(v)
    designs = known.select("design").distinct()
    held = designs.where(draw(F.lit("holdout"), F.col("design")) % 10 == 0)
    return pipeline.line_runs(known, _runs(designs), held).drop("picp", "mpiw")


@query("variant metric split n_runs", "mean std", f"SELECT variant, metric, 'holdout_runs' AS split, count(*) AS n_runs, avg(x) AS mean, stddev_pop(x) AS std FROM (UNPIVOT (SELECT seed, fold, variant, {_MEASURES} FROM sc GROUP BY 1, 2, 3) ON mae, rmse, bias, r2, f1, recall, precision INTO NAME metric VALUE x) GROUP BY 1, 2", _FITS)
def q_validation_runs(v: Views) -> DataFrame:
    """Means and deviations of every measure over the runs."""
    known = _known(v)
    designs = known.select("design").distinct()
    held = designs.where(draw(F.lit("holdout"), F.col("design")) % 10 == 0)
    return pipeline.validation_table(stage(pipeline.line_runs(known, _runs(designs), held), "runs"))


_PART = sql_draw("'unseen'", "design") + " % 5"


@query("design scenario ty tx", "pred_v lo_v hi_v", f"SELECT design, scenario, ty, tx, pred_v, least(pred_v * 0.95 - shift, pred_v) AS lo_v, greatest(pred_v * 1.1 + shift, pred_v) AS hi_v FROM pr, sh WHERE part = 0", f"""{_OK}, li AS (SELECT regr_slope(label_v, phys_base_v) AS a, regr_intercept(label_v, phys_base_v) AS b FROM k WHERE {_PART} > 1),
  pr AS (SELECT k.*, a * phys_base_v + b AS pred_v, {_PART} AS part FROM k, li),
  es AS (SELECT e, row_number() OVER (ORDER BY e) AS rn, count(*) OVER () AS n FROM (SELECT greatest(pred_v * 0.95 - label_v, label_v - pred_v * 1.1) AS e FROM pr WHERE part = 1)),
  sh AS (SELECT e AS shift FROM es WHERE rn = ceil(round((n - 1) * least(1.0, ceil(round((n + 1) * 0.8, 9)) / n), 9)) + 1)""")
def q_score_unseen(v: Views) -> DataFrame:
    """Designs that neither fit nor calibration saw: predictions of the affine variant with a conformal band."""
    known = _known(v).withColumn("part", draw(F.lit("unseen"), F.col("design")) % 5)
    fitted = models.fit_variant(known.where("part > 1"), "physics_affine")
    banded = models.predict_variant(known, fitted).withColumns({"q_low_v": F.col("pred_v") * 0.95, "q_high_v": F.col("pred_v") * 1.1})
    calibration = banded.where("part = 1").withColumn("one", F.lit(1))
    shift = conformal.conformal_shift(calibration, ["one"], "label_v", "q_low_v", "q_high_v").select("shift")
    low, high = conformal.apply_shift(F.col("q_low_v"), F.col("q_high_v"), F.col("shift"))
    low, high = conformal.monotone(low, F.col("pred_v"), high)
    return banded.where("part = 0").join(F.broadcast(shift), F.lit(True)).select(*GROUP, "ty", "tx", "pred_v", low.alias("lo_v"), high.alias("hi_v"))  # one row


_PARTS = f"CASE WHEN {sql_draw(chr(39) + 'part' + chr(39), 'design')} % 10 = 0 THEN NULL WHEN {sql_draw(chr(39) + 'part' + chr(39), 'design')} % 10 < 3 THEN 'calib' ELSE 'train' END"


def _contract(v: Views) -> DataFrame:
    known = _known(v)
    parts = known.select("design").distinct().withColumn("u", draw(F.lit("part"), F.col("design")) % 10).where("u > 0")
    scored = known.withColumns({"pred_v": F.col("phys_base_v") * 1.1, "lo_v": F.col("phys_base_v") * 1.05, "hi_v": F.when(F.col("tx") % 5 > 0, F.col("phys_base_v") * 1.3)})
    return pipeline.predictions(scored, parts.select("design", F.when(F.col("u") < 3, "calib").otherwise("train").alias("partition")))


@query("design scenario partition tile_id", "pred_v lo_v hi_v label_v coarse_v", f"SELECT design, scenario, coalesce({_PARTS}, 'uploaded') AS partition, ty * 24 + tx AS tile_id, phys_base_v * 1.1 AS pred_v, phys_base_v * 1.05 AS lo_v, CASE WHEN tx % 5 > 0 THEN phys_base_v * 1.3 ELSE phys_base_v * 1.1 END AS hi_v, label_v, phys_base_v AS coarse_v FROM k", _OK)
def q_prediction_table(v: Views) -> DataFrame:
    """The table of predictions for exchange."""
    return _contract(v)


@query("check n", "", "SELECT 'band without prediction' AS \"check\", count(*) AS n FROM k WHERE NOT (phys_base_v * 1.2 <= phys_base_v * 1.1) HAVING count(*) > 0", _OK)
def q_prediction_faults(v: Views) -> DataFrame:
    """Breaches of the contract, of a table whose lower bounds were raised."""
    return models.prediction_faults(_contract(v).withColumn("lo_v", F.col("coarse_v") * 1.2))


@query("pass_name design", "mae rmse bias r2 f1 recall precision", f"SELECT pass_name, design, {_MEASURES} FROM (SELECT 'as_trained' AS pass_name, design, label_v, a * phys_base_v + b AS pred_v FROM k, li UNION ALL SELECT 'recalibrated', k.design, label_v, a * (phys_base_v / c) + b FROM k JOIN (SELECT design, sum(phys_base_v * phys_base_v) / sum(phys_base_v * label_v) AS c FROM k GROUP BY 1 HAVING sum(phys_base_v * label_v) > 0) o ON o.design = k.design, li WHERE c > 0) GROUP BY 1, 2", f"{_OK}, li AS (SELECT regr_slope(label_v, phys_base_v) AS a, regr_intercept(label_v, phys_base_v) AS b FROM k)")
def q_transfer(v: Views) -> DataFrame:
    """Measures of each design as trained, and with its physics scaled to its own labels."""
    known = stage(v.f.where("label_v is not null and phys_base_v is not null"), "known")
    return pipeline.transfer(known, models.fit_variant(known, "physics_affine"), known).drop("picp", "mpiw")


_REPS = 1000
_TIMES = " + ".join(f"CASE WHEN u > {int(t)} THEN 1 ELSE 0 END" for t in resample.POISSON_CUTS)
_SUMS = {"n": "1", "ae": "abs({p} - label_v)", "se": "({p} - label_v) * ({p} - label_v)", "e": "{p} - label_v", "y": "label_v", "yy": "label_v * label_v", "tp": "CASE WHEN label_v > 0.045 AND {p} > 0.045 THEN 1 ELSE 0 END", "fp": "CASE WHEN label_v <= 0.045 AND {p} > 0.045 THEN 1 ELSE 0 END", "fn": "CASE WHEN label_v > 0.045 AND {p} <= 0.045 THEN 1 ELSE 0 END", "cov": "CASE WHEN label_v BETWEEN {p} * 0.9 AND {p} * 1.3 THEN 1 ELSE 0 END", "wid": "{p} * 0.4"}
_METRICS = {"mae": "ae{0} / n{0} * 1000", "rmse": "sqrt(se{0} / n{0}) * 1000", "bias": "e{0} / n{0} * 1000", "r2": "1 - se{0} / (yy{0} - y{0} * y{0} / n{0})", "f1": "2 * tp{0} / greatest(2 * tp{0} + fp{0} + fn{0}, 1)", "recall": "tp{0} / greatest(tp{0} + fn{0}, 1)", "precision": "tp{0} / greatest(tp{0} + fp{0}, 1)", "picp": "cov{0} / n{0}", "mpiw": "wid{0} / n{0} * 1000", "over": "(tp{0} + fp{0}) / n{0}"}
_PAIR = {"1": "phys_base_v", "2": "phys_base_v * 1.1"}
_per = ", ".join(f"sum(cast({e.format(p=p)} AS double)) AS {c}{i}" for i, p in _PAIR.items() for c, e in _SUMS.items())
_tot = ", ".join(f"sum(t * {c}{i}) AS {c}{i}" for i in _PAIR for c in _SUMS)
_dif = ", ".join(f"({m.format('2')}) - ({m.format('1')}) AS {name}" for name, m in _METRICS.items())


@query("metric replicates excludes_zero", "mean ci_lo ci_hi", f"SELECT metric, count(*) AS replicates, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero, avg(d) AS mean, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi FROM (UNPIVOT (SELECT rep, {_dif} FROM tt WHERE n1 > 0) ON {', '.join(_METRICS)} INTO NAME metric VALUE d) GROUP BY 1", f"{_OK}, pe AS (SELECT design, {_per} FROM k GROUP BY 1), rp AS (SELECT rep, pe.*, {_TIMES.replace('u >', sql_draw(chr(39) + '42' + chr(39), 'cast(rep AS varchar)', 'design') + ' >')} AS t FROM pe, (SELECT unnest(range({_REPS})) AS rep)), tt AS (SELECT rep, {_tot} FROM rp GROUP BY 1)")
def q_bootstrap_designs(v: Views) -> DataFrame:
    """Paired bootstrap of designs: ten measures of two predictions over a thousand draws."""
    known = _known(v)
    per = known.groupBy("design").agg(*(F.sum(F.expr(e.format(p=p)).cast("double")).alias(f"{c}{i}") for i, p in _PAIR.items() for c, e in _SUMS.items()))
    drawn = resample.drawn_sums(per, "design", [f"{c}{i}" for i in _PAIR for c in _SUMS], _REPS, lambda rep: draw(F.lit("42"), rep.cast("string"), F.col("design")))
    deltas = drawn.where("n1 > 0").select("rep", *(F.expr(f"({m.format('2')}) - ({m.format('1')})").alias(name) for name, m in _METRICS.items()))
    long = deltas.unpivot(["rep"], list(_METRICS), "metric", "d").withColumn("weight", F.lit(1))
    return resample.weighted_interval(long, ["metric"], "d", "weight").select("metric", "replicates", "excludes_zero", "mean", "ci_lo", "ci_hi")


QUERIES, ORACLE = query.queries, query.oracle
