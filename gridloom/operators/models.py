"""Predictors of the label: physics alone, physics with a line, learned alone, and physics plus learned residual.

Point models are gradient boosted trees of Spark ML. The 10 % and 90 % bands are exact percentiles of the
training residual within the leaves of one regression tree; the conformal correction makes their coverage hold.
Rows without a label take no part in fitting. A null feature is the median of the fitted rows, and a flag beside it says that
it was null, so that trees can part such rows: every row is fitted, and every row gets a prediction.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import finite
from gridloom.operators.fits import line
from gridloom.sources.schema import FEATURES

VARIANTS = ("physics_only", "physics_affine", "learned_only", "hybrid")
PHYSICS = "phys_base_v"


def columns_of(variant: str) -> list[str]:
    """The features a variant sees."""
    return [f for f in FEATURES if variant != "learned_only" or not f.startswith("phys_")]


class Variant(NamedTuple):
    """A fitted variant: a line for the physics ones, trees and leaf bands for the others."""

    name: str
    slope: float | None = None
    intercept: float | None = None
    median: GBTRegressionModel | None = None
    tree: DecisionTreeRegressionModel | None = None
    bands: DataFrame | None = None  # leaf, q_low, q_high
    fills: dict[str, float] | None = None  # what stands for a null feature


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """What stands for nulls of each column: its median (to a thousandth of the ranks), 0 if it has no value."""
    row = df.agg(*(F.approx_percentile(finite(c), 0.5, 1000).alias(c) for c in columns)).first()  # a number a column
    return {c: 0.0 if row[c] is None else float(row[c]) for c in columns}


def _filled(column: str, fills: dict[str, float]) -> Column:
    return F.coalesce(finite(column), F.lit(fills[column]))


def _base(variant: str, fills: dict[str, float]) -> Column:
    return F.lit(0.0) if variant == "learned_only" else _filled(PHYSICS, fills)


def _assembled(df: DataFrame, variant: str, fills: dict[str, float]) -> DataFrame:
    """The features of a variant with nulls filled, then a flag for each that says whether it was null."""
    columns = columns_of(variant)
    flags = (finite(c).isNull().cast("double") for c in columns)
    return df.withColumn("_x", array_to_vector(F.array(*(_filled(c, fills) for c in columns), *flags)))


def fit_variant(df: DataFrame, variant: str, label: str = "label_v", iterations: int = 20, depth: int = 5, low: float = 0.1, high: float = 0.9, seed: int = 0) -> Variant:
    known = df.where(F.col(label).isNotNull() & ~F.isnan(label))
    if variant == "physics_only":
        return Variant(variant, 1.0, 0.0)
    if variant == "physics_affine":
        fit = known.dropna(subset=[PHYSICS]).agg(*(c.alias(n) for n, c in line(PHYSICS, label).items())).first()  # two numbers
        return Variant(variant, fit["slope"], fit["intercept"])
    fills = medians(known, columns_of(variant))
    train = _assembled(known, variant, fills).withColumn("_y", F.col(label) - _base(variant, fills))
    median = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=iterations, maxDepth=depth, stepSize=0.1, seed=seed).fit(train)
    tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", maxDepth=depth, minInstancesPerNode=20, leafCol="_leaf", seed=seed).fit(train)
    # percentiles by leaf: a leaf count of at most 2 ** depth rows
    bands = tree.transform(train).groupBy(F.col("_leaf").cast("int").alias("_leaf")).agg(F.percentile("_y", low).alias("_low"), F.percentile("_y", high).alias("_high"))
    return Variant(variant, median=median, tree=tree, bands=bands, fills=fills)


def predict_variant(df: DataFrame, fitted: Variant) -> DataFrame:
    """Adds pred_v, q_low_v, q_high_v (bands are null for the physics variants)."""
    if fitted.median is None:
        return df.withColumn("pred_v", F.col(PHYSICS) * fitted.slope + fitted.intercept).withColumn("q_low_v", F.lit(None).cast("double")).withColumn("q_high_v", F.lit(None).cast("double"))
    base = _base(fitted.name, fitted.fills)
    scored = fitted.median.setPredictionCol("_m").transform(_assembled(df, fitted.name, fitted.fills))
    leaves = fitted.tree.setPredictionCol("_t").transform(scored).withColumn("_leaf", F.col("_leaf").cast("int"))
    out = leaves.join(F.broadcast(fitted.bands), "_leaf", "left")  # a row a leaf
    return out.select(*df.columns, (base + F.col("_m")).alias("pred_v"), (base + F.col("_low")).alias("q_low_v"), (base + F.col("_high")).alias("q_high_v"))


class Trees(NamedTuple):
    """The trees of a fitted model as arrays, one row a node; leaves lead to themselves."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]  # times the weight of the tree
    depth: list[int]

    def predict(self, x: np.ndarray, t: int) -> np.ndarray:
        """What tree ``t`` adds for each row of ``x``."""
        rows, at = np.arange(len(x)), np.zeros(len(x), int)
        for _ in range(self.depth[t]):
            at = np.where(x[rows, self.feature[t][at]] <= self.threshold[t][at], self.left[t][at], self.right[t][at])
        return self.value[t][at]


def trees_of(model: GBTRegressionModel) -> Trees:
    """A boosted model's trees (a few hundred nodes) on the driver."""
    out = Trees([], [], [], [], [], [])
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[list[float]] = []

        def walk(node: object, level: int) -> tuple[int, int]:
            at = len(nodes)  # noqa: B023
            nodes.append([0, np.inf, at, at, node.prediction() * weight])  # noqa: B023
            if node.subtreeDepth() == 0:
                return at, level
            split = node.split()
            (left, a), (right, b) = walk(node.leftChild(), level + 1), walk(node.rightChild(), level + 1)
            nodes[at][:4] = [split.featureIndex(), split.threshold(), left, right]  # noqa: B023
            return at, max(a, b)

        depth = walk(tree._java_obj.rootNode(), 0)[1]
        for column, values, kind in zip(out, zip(*nodes, strict=True), (int, float, int, int, float), strict=False):
            column.append(np.array(values, kind))
        out.depth.append(depth)
    return out


def permutation_importance(df: DataFrame, fitted: Variant, groups: dict[str, list[str]], row_id: str, label: str = "label_v", repeats: int = 10, seed: int = 42, block_rows: int = 20_000) -> DataFrame:
    """Increase of the mean absolute error when the features of a group are exchanged together: feature_group, repeat, increase.

    Rows fall into blocks by a hash of their id, so that a block is a random draw of all rows and its size is bounded; within
    each block a repeat has its own seeded permutation, one for all features of a group (with their flags). A tree that sees no
    feature of the group adds the same before and after. The physics the hybrid adds to stays in place, as in the reference."""
    columns, trees, fills = columns_of(fitted.name), trees_of(fitted.median), fitted.fills
    known = df.where(F.col(label).isNotNull() & ~F.isnan(label))
    blocks = max(1, -(-known.count() // block_rows))
    median = np.array([fills[c] for c in columns])
    moves = {g: np.array([k for c in cs if c in columns for k in (columns.index(c), len(columns) + columns.index(c))], int) for g, cs in groups.items()}
    seen = [set(f[left != np.arange(len(left))].tolist()) for f, left in zip(trees.feature, trees.left, strict=True)]

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_id")
        col = lambda c: block.column(c).to_numpy().astype(float)
        raw = np.column_stack([col(c) for c in columns])
        flags = np.isnan(raw)
        x, y = np.hstack([np.where(flags, median, raw), flags.astype(float)]), col("_y")
        parts = [trees.predict(x, t) for t in range(len(trees.value))]
        base, rows = sum(parts), []
        error = np.abs(base - y).sum()
        for i, (g, at) in enumerate(moves.items()):
            hit = [t for t, s in enumerate(seen) if s & set(at.tolist())]
            for k in range(repeats):
                moved, order = x.copy(), np.random.RandomState([seed, i, k, block.column("_block")[0].as_py()]).permutation(len(x))
                moved[:, at] = x[order][:, at]
                changed = base + sum((trees.predict(moved, t) - parts[t] for t in hit), np.zeros(len(x)))
                rows.append((g, k, len(x), float(np.abs(changed - y).sum() - error)))
        names = ["feature_group", "repeat", "n", "more"]
        return pa.table([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=names)

    block = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(blocks)).alias("_block")
    sent = known.select(block, F.col(row_id).alias("_id"), (F.col(label) - _base(fitted.name, fills)).alias("_y"), *(finite(c).alias(c) for c in columns))
    sums = sent.groupBy("_block").applyInArrow(run, "feature_group string, repeat int, n bigint, more double")
    return sums.groupBy("feature_group", "repeat").agg((F.sum("more") / F.sum("n")).alias("increase"))


def feature_array(df: DataFrame, variant: str) -> DataFrame:
    """The features of a variant as one array column."""
    return df.withColumn("x", F.array(*columns_of(variant)))


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def prediction_faults(predictions: DataFrame) -> DataFrame:
    """Breaches of the contract of a prediction table: check, n. Empty if it holds."""
    checks = {
        "not finite": " or ".join(f"{c} is null or isnan({c}) or abs({c}) = double('Infinity')" for c in ("pred_v", "lo_v", "hi_v")),
        "band without prediction": "not (lo_v <= pred_v and pred_v <= hi_v)",
        "no partition": "partition is null",
        "tile out of range": "tile_id < 0 or tile_id >= 576",
    }
    sums = predictions.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in checks.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks)))
    return sums.select(rows.alias("r")).select("r.*").where("n > 0")
