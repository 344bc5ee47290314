"""Measures of predictions: each is a conditional aggregation, so that any set of runs is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import guarded_corr, ratio
from gridloom.operators.ranking import average_rank


def confusion(label: Column, pred: Column, budget: Column | float) -> dict[str, Column]:
    """Counts of violations (strictly over budget) foretold and found."""
    b = budget if isinstance(budget, Column) else F.lit(float(budget))
    y, p = label > b, pred > b
    return {"tp": F.count_if(y & p), "fp": F.count_if(~y & p), "fn": F.count_if(y & ~p), "tn": F.count_if(~y & ~p)}


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp.cast("double"), tp + fp, 0.0)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp.cast("double"), tp + fn, 0.0)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0, undefined: float | None = 0.0) -> Column:
    """F measure; ``undefined`` where there is nothing positive."""
    b2 = beta * beta
    return ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp, undefined)


def crossover(tp1: Column, fp1: Column, fn1: Column, tp2: Column, fp2: Column, fn2: Column) -> Column:
    """The beta at which two F measures are equal; null unless it is positive."""
    num, den = tp2 * fp1 - tp1 * fp2, tp1 * fn2 - tp2 * fn1
    return F.when((den != 0) & (num * F.signum(den.cast("double")) > 0), F.sqrt(num / F.when(den != 0, den)))


def errors(label: Column, pred: Column, scale: float = 1000.0) -> dict[str, Column]:
    """Mean absolute error, root mean square error and bias, in thousandths by default."""
    d = pred - label
    return {"mae": F.avg(F.abs(d)) * scale, "rmse": F.sqrt(F.avg(d * d)) * scale, "bias": F.avg(d) * scale}


def r_squared(label: str, pred: str) -> Column:
    """1 - residual over total sum of squares; null for a constant label."""
    total = F.var_pop(label) * F.count(label)
    return F.when(total > 1e-18, 1 - F.sum((F.col(label) - F.col(pred)) * (F.col(label) - F.col(pred))) / F.when(total > 1e-18, total))


def coverage(label: Column, low: Column, high: Column, scale: float = 1000.0) -> dict[str, Column]:
    """Share of labels within the band, bounds included, and mean width; null without a band."""
    has = low.isNotNull() & high.isNotNull()
    return {"picp": F.avg(F.when(has, F.when(label.between(low, high), 1.0).otherwise(0.0))), "mpiw": F.avg(F.when(has, high - low)) * scale}


def spearman(df: DataFrame, keys: list[str], x: str, y: str, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """Correlation of average ranks; null where either column is constant. ``spread``: for few keys with many rows."""
    rows = df.select(*keys, x, y)
    ranked = average_rank(average_rank(rows, keys, x, "_rx", spread=spread, ranges=ranges), keys, y, "_ry", spread=spread, ranges=ranges, of=rows)
    return ranked.groupBy(*keys).agg(guarded_corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


#: Measures of which less is better; of a bias, the smaller size.
LESS_IS_BETTER = ("mae", "rmse", "bias")


def variant_deltas(long: DataFrame, keys: list[str], variant: str, metric: str, value: str, one: str, other: str) -> DataFrame:
    """Difference of two variants by key and metric, and whether the first is better."""
    side = lambda v, name: long.where(F.col(variant) == v).select(*keys, metric, F.col(value).alias(name))
    both = side(one, "a").join(side(other, "b"), [*keys, metric])
    size = lambda c: F.when(F.col(metric) == "bias", F.abs(c)).otherwise(F.col(c))
    better = F.when(F.col(metric).isin(*LESS_IS_BETTER), size("a") < size("b")).otherwise(F.col("a") > F.col("b"))
    return both.select(*keys, metric, (F.col("a") - F.col("b")).alias("delta"), better.alias("better"))
