"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import bundle_queries, data_problems, grid_queries, model_queries, run_queries

MODULES = (data_problems, grid_queries, model_queries, bundle_queries, run_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["q_raster_sum"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


#: The data behind each figure: its query.
FIGURE_DATA = {
    "map of drops": "q_label_max",
    "fine map against upsampled coarse map": "q_upsample_diff",
    "histogram of drops": "q_histogram",
    "ablation over runs": "q_validation_runs",
    "precision and recall": "q_pr_curve",
    "crossover of F measures": "q_fbeta_crossover",
    "coverage by design": "q_design_coverage",
    "importance by feature group": "q_perm_importance",
    "rank correlation by feature group": "q_feature_spearman",
    "tiles over budget": "q_over_budget",
    "power law": "q_loglog_ols",
}


def figure(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The data of a figure."""
    return queries()[FIGURE_DATA[name]](spark, sf_dir)
