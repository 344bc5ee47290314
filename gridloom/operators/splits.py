"""Design-level splits, bit for bit reproducible from their seeds.

The list of designs is the driver's: one short name a design, counted before it is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MAX_DESIGNS = 1_000_000


def design_list(df: DataFrame, design: str = "design", most: int = MAX_DESIGNS) -> list[str]:
    rows = df.select(design).dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} designs; use a hash split")
    return sorted(r[0] for r in rows)


def holdout(designs: list[str], n_holdout: int, seed: int = 0) -> tuple[list[str], list[str]]:
    """(holdout, pool): the first of a seeded permutation are held out."""
    order = np.random.RandomState(seed).permutation(sorted(designs)).tolist()
    return sorted(order[:n_holdout]), sorted(order[n_holdout:])


def runs(pool: list[str], n_calibration: int, folds: int, seeds: list[int]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(seed, fold, train, calibration): permutations drawn per seed; a partition that was met before, in any
    seed, is drawn again. Raises when eight times the folds do not suffice."""
    names, met = np.array(sorted(pool)), set()
    for seed in seeds:
        draw, fold = np.random.RandomState(seed), 0
        for _ in range(8 * folds):
            order = draw.permutation(len(names))
            chosen = frozenset(order[:n_calibration].tolist())
            if chosen in met:
                continue
            met.add(chosen)
            calibration = sorted(names[sorted(chosen)].tolist())
            yield seed, fold, sorted(set(names.tolist()) - set(calibration)), calibration
            fold += 1
            if fold == folds:
                break
        else:
            raise RuntimeError(f"seed {seed}: only {fold} distinct partitions")


def run_table(spark: SparkSession, pool: list[str], n_calibration: int, folds: int, seeds: list[int]) -> DataFrame:
    """seed, fold, design, partition."""
    rows = [(s, f, d, p) for s, f, train, cal in runs(pool, n_calibration, folds, seeds) for p, ds in (("train", train), ("calib", cal)) for d in ds]
    return spark.createDataFrame(rows, "seed int, fold int, design string, partition string")
