"""Grids are larger than the names they are made from: what the planner takes for small must not go to the driver."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from gridloom.operators import mesh, raster, spatial
from gridloom.plans import registry

DATA = "/root/testdata/sf0.001"


def broadcast_rows(df):
    """Rows of each broadcast of the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("name", ["q_upsample_diff", "q_mesh_edges", "q_mesh_cells", "q_feature_table"])
def test_no_grid_is_broadcast(spark, name):
    rows = broadcast_rows(registry.queries()[name](spark, DATA))
    assert max(rows, default=0) <= 1000, rows


@pytest.mark.parametrize("name", ["q_mesh_residual", "q_influence_solve"])
def test_solutions_stay_in_their_group(spark, name):
    """Neither the drops (n * n rows a scenario) nor the influences (n * n rows a source) are exchanged or staged."""
    df = registry.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0 and "FlatMapCoGroupsInArrow" in plan and "FlatMapCoGroupsInArrow" not in plan.split("FlatMapCoGroupsInArrow", 1)[1]
    assert "Aggregate" not in plan.split("FlatMapCoGroupsInArrow", 1)[0] and "Join" not in plan.split("FlatMapCoGroupsInArrow", 1)[0]


def test_measures_equal_those_by_joins(spark):
    n, rows = 4, [("d", i, j, 1.0 + i, 2.0, 3.0 if (i, j) == (1, 2) else 0.0) for i in range(4) for j in range(4)]
    cells = spark.createDataFrame([*rows, ("dry", 0, 0, 1.0, 2.0, 0.0)], "design string, ty int, tx int, strap double, sheet double, supply double")
    cur = spark.createDataFrame([("d", "a", 0, 0, 0.5), ("d", "a", 3, 3, 0.25), ("d", "b", 2, 1, 1.0), ("d", "idle", 0, 1, 0.0), ("dry", "a", 0, 0, 1.0)], "design string, scenario string, ty int, tx int, current_a double")
    of = lambda df: {(r[0], r[1]): r[2] for r in df.collect()}
    edges = spatial.mesh_edges(raster.gathered(cells.where("design = 'd'"), cells.where("design = 'd'").select("design"), ["design"], n, ["strap"]), ["design"], "strap", 2.0, n)
    assert edges.count() == 2 * n * (n - 1)
    solved = mesh.solve_designs(cells, cur, n)
    by_joins, within = of(mesh.residuals(solved, cells, cur, edges)), of(mesh.solved_residuals(cells, cur, n))
    assert by_joins.keys() == within.keys() == {("d", "a"), ("d", "b"), ("d", "idle")} and max(*by_joins.values(), *within.values()) < 1e-12
    other = mesh.influence_solve(mesh.influence(cells, n, sources=cur), cur).withColumnRenamed("drop_v", "other")
    joined = solved.join(other, ["design", "scenario", "ty", "tx"]).groupBy("design", "scenario").agg(F.max(F.abs(F.col("drop_v") - F.col("other"))))
    apart = of(mesh.superposed_difference(cells, cur, n))
    assert of(joined).keys() == apart.keys() == within.keys() and max(*of(joined).values(), *apart.values()) < 1e-12
    # a wrong solution shows
    system = mesh.Mesh.of_straps(np.ones((n, n)), 1.0, np.ones((n, n)))
    assert system.residual(np.ones((n, n)), np.zeros((n, n))) == 1.0
