"""Seeded synthetic designs. A design follows from its seed alone, so that each table of a corpus is one pass over
the seeds; executors make the rows, the driver sends nothing but numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.operators.mesh import Mesh
from gridloom.sources.schema import BUDGET_V, BUNDLE, COARSE, FINE, SCENARIOS, VDD_V

#: Activity of each module class by scenario.
CLASSES = ("host_if", "dma_fabric", "ecc_engine", "ch_ctrl", "sram_ctl", "seq_core")
ACTIVITY = {
    "idle": (0.05, 0.02, 0.01, 0.02, 0.05, 0.10),
    "seq_read": (0.85, 0.80, 0.55, 0.70, 0.60, 0.35),
    "seq_write": (0.90, 0.90, 0.95, 0.85, 0.75, 0.40),
    "rand_read_4k": (0.60, 0.55, 0.45, 0.50, 0.90, 0.85),
    "gc_compact": (0.05, 0.85, 0.90, 0.90, 0.70, 0.60),
    "ecc_recover": (0.10, 0.20, 1.00, 0.15, 0.30, 0.25),
}
#: Strap widths and pitches, micrometres.
WIDTHS, PITCHES = (0.4, 0.8, 1.6), (8.0, 12.0, 16.0, 24.0)
#: Mean cell area, square micrometres, and spread of the lognormal noise.
CELL_UM2 = 2.38
SIGMA = 0.6


def slices(w: float, h: float, weights: np.ndarray) -> list[tuple[float, float, float, float]]:
    """A slicing floorplan: the modules of a rectangle are parted where half of their running weight is reached, and the
    rectangle is cut across its longer side in that proportion, so that each module's area follows its weight."""
    rects: list[tuple[float, float, float, float]] = [(0.0, 0.0, w, h)] * len(weights)
    todo = [(0, len(weights))] if len(weights) else []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        x0, y0, x1, y1 = rects[a]
        run = np.cumsum(weights[a:b])
        k = int(np.clip(np.searchsorted(run, run[-1] / 2) + 1, 1, b - a - 1))
        share = float(run[k - 1] / run[-1])
        if x1 - x0 >= y1 - y0:
            c = x0 + share * (x1 - x0)
            first, second = (x0, y0, c, y1), (c, y0, x1, y1)
        else:
            c = y0 + share * (y1 - y0)
            first, second = (x0, y0, x1, c), (x0, c, x1, y1)
        rects[a : a + k], rects[a + k : b] = [first] * k, [second] * (b - a - k)
        todo += [(a, a + k), (a + k, b)]
    return rects


def place(rng: np.random.RandomState, n: int, rect: tuple, avoid: np.ndarray, tries: int = 6) -> np.ndarray:
    """Points in a rectangle; points in macros are drawn again up to ``tries`` times."""
    draw = lambda k: np.c_[rng.uniform(rect[0], rect[2], k), rng.uniform(rect[1], rect[3], k)]
    p = draw(n)
    for _ in range(tries):
        if not len(avoid):
            break
        bad = ((p[:, None, 0] > avoid[:, 0]) & (p[:, None, 0] < avoid[:, 2]) & (p[:, None, 1] > avoid[:, 1]) & (p[:, None, 1] < avoid[:, 3])).any(axis=1)
        if not bad.any():
            break
        p[bad] = draw(int(bad.sum()))
    return p


def layout(seed: int, cells: tuple[float, float] = (2.5e4, 7e5)) -> dict[str, pd.DataFrame]:
    """All tables of one design but its drop map."""
    rng = np.random.RandomState(seed)
    n = int(np.exp(rng.uniform(np.log(cells[0]), np.log(cells[1]))))
    util, aspect = rng.uniform(0.55, 0.85), rng.uniform(0.8, 1.25)
    area = n * CELL_UM2 / util
    w, h = round(float(np.sqrt(area * aspect)), 3), round(float(np.sqrt(area / aspect)), 3)
    pitch, width, space = rng.choice([150.0, 200.0, 300.0]), rng.choice(WIDTHS), rng.choice(PITCHES)
    pitch = round(float(min(pitch, w / 3, h / 3)), 3)  # small dies have bumps, too
    m = rng.randint(6, 11)
    names = [f"{CLASSES[i % 6]}_{i}" for i in range(m)]
    weights = rng.dirichlet(np.full(m, 4.0))
    rects = slices(w, h, weights)
    rated = np.round(rng.uniform(3, 25, m), 3)
    modules = pd.DataFrame({"module": names, "clock_domain": rng.choice(["clk_core", "clk_host", "clk_nand"], m), "power_domain": rng.choice(["vdd_core", "vdd_io"], m), "rated_power_mw": rated})
    k = rng.randint(2, 6)
    mw, mh = rng.uniform(0.06, 0.18, k) * w, rng.uniform(0.06, 0.18, k) * h
    mx, my = rng.uniform(0, w - mw), rng.uniform(0, h - mh)
    macros = pd.DataFrame({"macro_id": np.arange(k), "module": rng.choice(names, k), "x0_um": mx.round(3), "y0_um": my.round(3), "x1_um": (mx + mw).round(3), "y1_um": (my + mh).round(3), "power_mw": rng.uniform(1, 5, k).round(3)})
    box = macros[["x0_um", "y0_um", "x1_um", "y1_um"]].to_numpy()
    of = rng.choice(m, n, p=weights)
    xy = np.empty((n, 2))
    for i in range(m):
        xy[of == i] = place(rng, int((of == i).sum()), rects[i], box)
    seq = (rng.rand(n) < rng.normal(0.58, 0.02)).astype(int)
    clk = ((rng.rand(n) < 0.03) & (seq == 0)).astype(int)
    size = np.where(seq == 1, 5.3, np.where(clk == 1, 2.1, 1.0)) * rng.uniform(0.8, 1.2, n)
    instances = pd.DataFrame({"inst_id": np.arange(n), "inst_name": [f"u_{i}" for i in range(n)], "module": np.array(names)[of], "cell_type": np.where(seq == 1, "DFFR_X1", np.where(clk == 1, "CLKBUF_X2", "NAND2_X1")), "x_um": xy[:, 0].round(3), "y_um": xy[:, 1].round(3), "area_um2": size.round(3), "cap_ff": np.maximum(0.3, size * 0.9).round(3), "is_seq": seq, "is_clk": clk, "is_macro": 0})
    bx, by = np.meshgrid(np.arange(pitch / 2, w, pitch), np.arange(pitch / 2, h, pitch))
    bumps = pd.DataFrame({"bump_id": np.arange(bx.size), "x_um": bx.ravel(), "y_um": by.ravel()})
    planned = np.clip(width / space * 8 * rng.uniform(0.9, 1.1, (FINE, FINE)), 0.01, 1).round(6)
    fy, fx = np.divmod(np.arange(FINE * FINE), FINE)
    straps = pd.DataFrame({"fy": fy, "fx": fx, "density": planned.ravel()})
    act = [(s, name, float(np.clip(ACTIVITY[s][i % 6] * rng.uniform(0.9, 1.1), 0, 1).round(4)), SCENARIOS[s]) for s in SCENARIOS for i, name in enumerate(names)]
    activity = pd.DataFrame(act, columns=["scenario", "module", "activity", "mission_weight"])
    rows = []
    for i in range(rng.randint(51, 101)):
        ids = np.sort(rng.choice(n, min(n, rng.randint(2, 14)), replace=False))
        delay = round(float(rng.uniform(0.3, 3.5)), 3)
        rows.append((i, f"u_{ids[-1]}", "clk_core", round(3.5 - delay - float(rng.uniform(0, 1)), 3), delay, ";".join(map(str, ids))))
    paths = pd.DataFrame(rows, columns=["path_id", "endpoint", "clock_domain", "slack_ns", "delay_ns", "inst_ids"])
    stats = pd.DataFrame([("", f"cfg_syn_{seed}", f"{seed:012x}", n, int(seq.sum()), 0, float(size.sum()), float(size[seq == 1].sum()), float(100 * seq.mean()), 0, "", w, h, VDD_V, 3.5, util, pitch, space, width, "M4-M7")], columns=[f.name for f in BUNDLE["design_stats"]])
    return {"design_stats": stats, "modules": modules, "macros": macros, "instances": instances, "bumps": bumps, "strap_planned": straps, "activity": activity, "paths": paths}


def as_built(planned: np.ndarray, instances_per_cell: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Straps as they come out: thinned where cells are dense and around macros."""
    dense = instances_per_cell / max(1.0, instances_per_cell.max())
    return np.clip(planned * (1 - 0.25 * dense) * np.where(ring, 0.78, 1.0), 0.01, 1.0)


def truth(seed: int, t: dict[str, pd.DataFrame], k_sheet: float) -> pd.DataFrame:
    """The drop map of a design on its as-built fine mesh, all scenarios by one factorisation."""
    st = t["design_stats"].iloc[0]
    at = lambda v, size: np.clip((np.asarray(v) / (size / FINE)).astype(int), 0, FINE - 1)
    inst = t["instances"]
    iy, ix = at(inst.y_um, st.die_h_um), at(inst.x_um, st.die_w_um)
    count = np.zeros((FINE, FINE))
    np.add.at(count, (iy, ix), 1.0)
    inside = np.zeros((FINE, FINE), bool)
    near = np.zeros((FINE, FINE), bool)
    for r in t["macros"].itertuples():
        a, b, c, d = at(r.y0_um, st.die_h_um), at(r.y1_um, st.die_h_um), at(r.x0_um, st.die_w_um), at(r.x1_um, st.die_w_um)
        inside[a : b + 1, c : d + 1] = True
        near[max(0, a - 2) : b + 3, max(0, c - 2) : d + 3] = True
    straps = as_built(t["strap_planned"].density.to_numpy().reshape(FINE, FINE), count, near & ~inside)
    fill = st.strap_width_um / st.strap_pitch_um
    supply = np.zeros((FINE, FINE))
    np.add.at(supply, (at(t["bumps"].y_um, st.die_h_um), at(t["bumps"].x_um, st.die_w_um)), 10 * k_sheet * fill)
    rated = t["modules"].set_index("module").rated_power_mw
    share = inst.groupby("module").inst_id.transform("size").to_numpy()
    rhs = np.zeros((FINE, FINE, len(SCENARIOS)))
    for j, s in enumerate(SCENARIOS):
        act = t["activity"][t["activity"].scenario == s].set_index("module").activity
        rng = np.random.RandomState(1000003 * seed + j)
        noise = rng.lognormal(0.0, SIGMA, len(inst)) / np.exp(SIGMA**2 / 2)
        amps = inst.module.map(rated).to_numpy() * 1e-3 * inst.module.map(act).to_numpy() / (VDD_V * share) * noise
        np.add.at(rhs[:, :, j], (iy, ix), amps)
    u = Mesh.of_straps(straps, k_sheet * fill, supply).solve(rhs)
    fy, fx, j = (x.ravel() for x in np.meshgrid(np.arange(FINE), np.arange(FINE), np.arange(len(SCENARIOS)), indexing="ij"))
    return pd.DataFrame({"scenario": np.array(list(SCENARIOS))[j], "fy": fy, "fx": fx, "drop_v": u.ravel().round(8)})


def _struct(table: str) -> T.StructType:
    return T.StructType([T.StructField("design_id", T.StringType()), *(f for f in BUNDLE[table] if f.name != "design_id")])


def corpus(spark: SparkSession, seeds: list[int], cells: tuple[float, float] = (2.5e4, 7e5)) -> dict[str, DataFrame]:
    """All nine tables of a corpus. First pass: each design's peak at unit conductance against its target, of which
    the median sets the conductance; second pass: the tables, one task a few seeds."""
    ids = spark.createDataFrame([(int(s),) for s in seeds], "seed int").repartition(max(1, len(seeds)), "seed")

    def table(name: str, k: float = 1.0) -> DataFrame:
        schema = to_arrow_schema(_struct(name))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for seed in batch.column(0).to_pylist():
                    t = layout(seed, cells)
                    df = truth(seed, t, k) if name == "irmap" else t[name]
                    columns = [pa.array([f"syn_{seed:03d}"] * len(df)) if f.name == "design_id" else pa.array(df[f.name].to_numpy(), from_pandas=True) for f in schema]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return ids.mapInArrow(run, _struct(name))

    peak = table("irmap").groupBy("design_id").agg(F.max("drop_v").alias("peak"))
    scale = peak.select(F.percentile(F.col("peak") / F.lit(BUDGET_V * 0.9), 0.5).alias("k")).first()["k"]  # one number
    return {n: table(n, float(scale or 1.0)) for n in BUNDLE}


GRIDS = (COARSE, FINE)
