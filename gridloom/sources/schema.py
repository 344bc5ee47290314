"""Columns of the tables of a design bundle, and the constants that are part of their meaning."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(text: str) -> T.StructType:
    """The type of a list of columns in DDL. (Spark's own reader of DDL needs a session, which imports have not.)"""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in text.split(","))])


#: The tables of a bundle, their columns and types in order.
BUNDLE: dict[str, T.StructType] = {
    "design_stats": struct("design_id string, config string, hash string, cells bigint, flops bigint, xor_cells bigint, chip_area_um2 double, seq_area_um2 double, seq_pct double, lint_rc int, ts_utc string, die_w_um double, die_h_um double, vdd_v double, clock_period_ns double, core_util double, bump_pitch_um double, strap_pitch_um double, strap_width_um double, pdn_layers string"),
    "modules": struct("module string, clock_domain string, power_domain string, rated_power_mw double"),
    "macros": struct("macro_id int, module string, x0_um double, y0_um double, x1_um double, y1_um double, power_mw double"),
    "instances": struct("inst_id int, inst_name string, module string, cell_type string, x_um double, y_um double, area_um2 double, cap_ff double, is_seq int, is_clk int, is_macro int"),
    "bumps": struct("bump_id int, x_um double, y_um double"),
    "strap_planned": struct("fy int, fx int, density double"),
    "activity": struct("scenario string, module string, activity double, mission_weight double"),
    "paths": struct("path_id int, endpoint string, clock_domain string, slack_ns double, delay_ns double, inst_ids string"),
    "irmap": struct("scenario string, fy int, fx int, drop_v double"),
}
#: A table that may be absent, and the manifest.
OPTIONAL = {"toggle": struct("scenario string, inst_id int, toggle_rate double")}
MANIFEST = struct("design_id string, corpus string, path string, n_scenarios int, n_instances bigint, source string")

#: The 32 features by group, in their order.
FEATURE_GROUPS: dict[str, list[str]] = {
    "phys": ["phys_base_v", "phys_base_s1", "phys_base_s2", "phys_base_rank"],
    "grid": ["grid_weak", "grid_strap_mean", "grid_strap_min", "grid_bumps", "grid_dbump_min", "grid_dbump_max"],
    "cur": ["cur_sum", "cur_max_fine", "cur_s1", "cur_s2", "cur_s4", "cur_x_weak", "cur_s2_x_weak"],
    "conc": ["conc_ratio", "conc_top4", "conc_x_weak"],
    "top": ["top_macro_frac", "top_dmacro", "top_edge_dist", "top_util", "top_cells", "top_capden", "top_clkden", "top_seqden"],
    "sw": ["sw_hhi", "sw_topshare"],
    "scn": ["scn_power_frac", "scn_weight"],
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]
IDENTITY = ["design", "scenario", "ty", "tx"]
#: Columns that must never become features.
BANNED = ["hash", "config", "design_id", "ts_utc", "lint_rc"]

#: Scenarios with their share of a mission.
SCENARIOS = {"idle": 0.30, "seq_read": 0.25, "seq_write": 0.15, "rand_read_4k": 0.15, "gc_compact": 0.10, "ecc_recover": 0.05}

#: Both grids, the supply and the share of it that may be lost.
FINE, COARSE = 96, 24
VDD_V, BUDGET_FRAC = 0.9, 0.05
BUDGET_V = VDD_V * BUDGET_FRAC


def guard_features(columns: list[str]) -> list[str]:
    """The feature columns among ``columns``; raises if the registry is incomplete or holds a banned name."""
    if banned := set(FEATURES) & set(BANNED):
        raise ValueError(f"banned features: {sorted(banned)}")
    if missing := [f for f in FEATURES if f not in columns]:
        raise ValueError(f"missing features: {missing}")
    return FEATURES
