"""Checks of bundles, files written and read again, splits by count, and changes of shape."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.names import clean_name
from gridloom.operators import checks, gates, governance, mesh, raster, reshape, shares, spatial, splits
from gridloom.plans.base import BUDGET_V, DIE, N, Register, Views, sql_tile
from gridloom.plans.data_problems import _NAME, _RECORDS
from gridloom.session import shared_dir, stage, table
from gridloom.sources import adapters, bundles
from gridloom.sources.schema import FEATURES, guard_features

query = Register()
GROUP = ["design", "scenario"]
T = lambda c, n=N: sql_tile(c, DIE, n)
_FAULT = "design_id file check message"

#: The raw records of straps and bumps as views of SQL.
_RAW = f"""{_RECORDS.strip().removeprefix("WITH ")},
  rec AS (SELECT {_NAME.format("w.design_id")} AS design, j.file_name, j.v FROM judged j JOIN raw_lines w ON w.line_id = j.line_id WHERE j.reason IS NULL),
  b AS (SELECT design, cast(v[1] AS bigint) AS bump_id, max(v[2]) AS x_um, max(v[3]) AS y_um FROM rec WHERE file_name = 'bumps' GROUP BY 1, 2),
  s AS (SELECT design, cast(v[1] AS integer) AS fy, cast(v[2] AS integer) AS fx, max(v[3]) AS density FROM rec WHERE file_name = 'strap_planned' GROUP BY 1, 2, 3)"""


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("design", "design_id")


def _folder(v: Views, label: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(v.spark)}/{v.spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


# checks


@query(_FAULT, "", f"SELECT {_NAME.format('design')} AS design_id, 'design_stats' AS file, 'one_row' AS \"check\", printf('%d rows', count(*)) AS message FROM design_sources GROUP BY 1 HAVING count(*) <> 1")
def q_check_one_row(v: Views) -> DataFrame:
    """Designs of several rows where one is due (here: of their sources)."""
    return checks.one_stats_row(table(v.spark, v.sf, "design_sources").select(clean_name("design").alias("design_id")))



@query(_FAULT, "", f"SELECT {_NAME.format('design_id')} AS design_id, 'design_stats' AS file, 'die_positive' AS \"check\", 'the die has no size' AS message FROM macros WHERE x0_um IS NULL OR x1_um IS NULL OR y0_um IS NULL OR y1_um IS NULL OR NOT (x1_um - x0_um > 0 AND cast(x1_um - x0_um AS varchar) <> 'nan') OR NOT (y1_um - y0_um > 0 AND cast(y1_um - y0_um AS varchar) <> 'nan')")
def q_check_size(v: Views) -> DataFrame:
    """Rectangles without size (here: of macros), by the check of dies."""
    rows = table(v.spark, v.sf, "macros").select(clean_name("design_id").alias("design_id"), (F.col("x1_um") - F.col("x0_um")).alias("die_w_um"), (F.col("y1_um") - F.col("y0_um")).alias("die_h_um"))
    return checks.die_positive(rows)


@query(_FAULT, "", f"SELECT design AS design_id, 'macros' AS file, 'within_die' AS \"check\", printf('coordinates reach %.3f dies', greatest(max(x1_um), max(y1_um)) / {DIE!r}) AS message FROM c WHERE design IS NOT NULL GROUP BY 1 HAVING greatest(max(x1_um), max(y1_um)) / {DIE!r} > 1.01")
def q_check_macros_die(v: Views) -> DataFrame:
    macros = _keyed(v.c)
    stats = macros.select("design_id").distinct().select("design_id", F.lit(DIE).alias("die_w_um"), F.lit(DIE).alias("die_h_um"))
    return checks.within_die(macros, stats, "macros", "x1_um", "y1_um")


@query(_FAULT, "", "SELECT design AS design_id, 'strap_planned' AS file, 'full_grid' AS \"check\", printf('%d rows, %d cells, %d outside', count(*), count(DISTINCT (fy, fx)), count(*) FILTER (fy NOT BETWEEN 0 AND 95 OR fx NOT BETWEEN 0 AND 95)) AS message FROM s GROUP BY 1 HAVING count(*) <> 9216 OR count(DISTINCT (fy, fx)) <> count(*)", _RAW)
def q_check_straps(v: Views) -> DataFrame:
    """Planned straps that are no full grid, or denser than possible."""
    straps = _keyed(stage(v.s, "straps"))
    return checks.full_grid(straps, "strap_planned", []).unionByName(checks.between(straps, "strap_planned", "density", 0, 1))


@query(_FAULT, "", f"SELECT {_NAME.format('design_id')} AS design_id, 'activity' AS file, 'activity_range' AS \"check\", printf('%d values outside', count(*)) AS message FROM activity WHERE cast(activity AS varchar) = 'nan' OR activity NOT BETWEEN 0 AND 1 GROUP BY 1")
def q_check_activity(v: Views) -> DataFrame:
    return checks.between(table(v.spark, v.sf, "activity").withColumn("design_id", clean_name("design_id")), "activity", "activity", 0, 1)


_TOKENS = f"""tok AS (SELECT design, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN try_cast(t AS integer) END AS inst_id FROM (
    SELECT {_NAME.format("design_id")} AS design, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS t FROM (SELECT design_id, list_filter(list_transform(string_split(inst_ids, ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM paths WHERE inst_ids <> ''))),
  lost AS (SELECT DISTINCT t.design, t.inst_id FROM tok t LEFT JOIN i ON i.design = t.design AND i.inst_id = t.inst_id WHERE t.inst_id IS NOT NULL AND i.inst_id IS NULL)"""


@query(_FAULT, "", "SELECT design AS design_id, 'paths' AS file, 'integers' AS \"check\", printf('%d tokens are no integers', count(*)) AS message FROM tok WHERE inst_id IS NULL GROUP BY 1 UNION ALL SELECT design, 'paths', 'members', printf('%d unknown instances: ', count(*)) || array_to_string(list(inst_id ORDER BY inst_id)[1:10], ', ') FROM lost GROUP BY 1", _TOKENS)
def q_check_members(v: Views) -> DataFrame:
    """Members of paths (lists parted by semicolons) that are no integers or no instances."""
    paths = table(v.spark, v.sf, "paths").withColumn("design_id", clean_name("design_id"))
    return checks.path_members(paths, _keyed(v.i))


@query("feature n", "", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n FROM features WHERE {c} IS NULL OR NOT isfinite({c}) HAVING count(*) > 0" for c in FEATURES))
def q_feature_faults(v: Views) -> DataFrame:
    """Values of the 32 features as delivered that are null, NaN or infinite."""
    return governance.feature_faults(table(v.spark, v.sf, "features"))


@query("feature", "", "SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM features) WHERE column_name NOT IN ('design', 'scenario', 'ty', 'tx', 'label_v')")
def q_feature_names(v: Views) -> DataFrame:
    """The columns that may be features, by the guard."""
    return v.spark.createDataFrame([(c,) for c in guard_features(table(v.spark, v.sf, "features").columns)], "feature string")


_BAD = " + ".join(f"CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 1 ELSE 0 END" for c in FEATURES)


@query("check ok", "value", f"SELECT 'values not finite' AS \"check\", sum({_BAD}) = 0 AS ok, sum({_BAD}) AS value FROM f UNION ALL SELECT 'groups without a full grid', count(*) FILTER (n <> 576) = 0, count(*) FILTER (n <> 576) FROM (SELECT count(DISTINCT (ty, tx)) AS n FROM f GROUP BY design, scenario) UNION ALL SELECT 'greatest rank', coalesce(max(phys_base_rank) > 0 AND max(phys_base_rank) <= 1, false), max(phys_base_rank) FROM f UNION ALL SELECT 'spread of weakness over scenarios', coalesce(max(d) = 0, false), max(d) FROM (SELECT max(grid_weak) - min(grid_weak) AS d FROM f GROUP BY design, ty, tx)")
def q_feature_gates(v: Views) -> DataFrame:
    return gates.feature_gates(stage(v.f, "features"))


# supply and meshes

_TOP = float((2 * N * N) ** 0.5)


@query("design ty tx", "d", f"SELECT design, g // {N} AS ty, g % {N} AS tx, min(sqrt((g // {N} - py) ** 2 + (g % {N} - px) ** 2)) AS d FROM (SELECT DISTINCT design, {T('y_um')} AS py, {T('x_um')} AS px FROM b WHERE design IS NOT NULL) p CROSS JOIN (SELECT unnest(range({N * N})) AS g) GROUP BY 1, 2, 3", _RAW)
def q_bump_distance(v: Views) -> DataFrame:
    """Distance of every tile to the nearest bump, by the exact distance transform."""
    points = raster.with_tiles(v.b.where("design is not null"), "x_um", "y_um", DIE, DIE, N, "py", "px").select("design", "py", "px")
    return spatial.distance_transform(points, ["design"], N, _TOP, "ty", "tx")


@query("design ty tx", "strap supply", f"SELECT d.design, g // {N} AS ty, g % {N} AS tx, coalesce(any_value(st.strap), 0) AS strap, coalesce(any_value(bp.n), 0) * 4.0 AS supply FROM (SELECT DISTINCT design FROM b WHERE design IS NOT NULL) d CROSS JOIN (SELECT unnest(range({N * N})) AS g) LEFT JOIN (SELECT design, fy // 4 AS ty, fx // 4 AS tx, sum(density) / 16 AS strap FROM s GROUP BY 1, 2, 3) st ON st.design = d.design AND st.ty = g // {N} AND st.tx = g % {N} LEFT JOIN (SELECT design, {T('y_um')} AS ty, {T('x_um')} AS tx, count(*) AS n FROM b GROUP BY 1, 2, 3) bp ON bp.design = d.design AND bp.ty = g // {N} AND bp.tx = g % {N} GROUP BY 1, 2, 3", _RAW)
def q_mesh_cells(v: Views) -> DataFrame:
    """Cells of the coarse mesh of designs with bumps: mean planned strap and bumps by their number."""
    bumps = stage(v.b.where("design is not null"), "bumps")
    designs = bumps.select("design").distinct()
    tile = ["design", "ty", "tx"]
    strap = v.s.where("design is not null").select("design", F.expr("cast(fy div 4 as int)").alias("ty"), F.expr("cast(fx div 4 as int)").alias("tx"), (F.col("density") / 16).alias("strap"), F.lit(0.0).alias("supply"))
    supply = raster.with_tiles(bumps, "x_um", "y_um", DIE, DIE, N).select(*tile, F.lit(0.0).alias("strap"), F.lit(4.0).alias("supply"))
    held = strap.unionByName(supply).groupBy(*tile).agg(F.sum("strap").alias("strap"), F.sum("supply").alias("supply"))
    return raster.tiles_of(raster.gathered(held, designs, ["design"], N, ["strap", "supply"]), ["design"], N, ["strap", "supply"])


@query("design", "scale median", f"SELECT design, scale, quantile_cont(scale, 0.5) OVER () AS median FROM (SELECT design, max(drop_v) / {BUDGET_V * 0.9!r} AS scale FROM r GROUP BY 1)")
def q_scale_to_target(v: Views) -> DataFrame:
    """Scale of each design's conductances for its target peak, from measured drops, with the corpus median."""
    scale = stage(v.r.groupBy("design").agg(mesh.calibration("drop_v", BUDGET_V * 0.9).alias("scale")), "scale")
    return scale.join(F.broadcast(scale.agg(F.percentile("scale", 0.5).alias("median"))), F.lit(True))  # one row


_PITCH = "pt AS (SELECT design, quantile_cont(d, 0.5) AS pitch FROM (SELECT x.design, x.bump_id, min(sqrt((x.x_um - y.x_um) ** 2 + (x.y_um - y.y_um) ** 2)) AS d FROM b x JOIN b y ON x.design = y.design AND sqrt((x.x_um - y.x_um) ** 2 + (x.y_um - y.y_um) ** 2) > 0 GROUP BY 1, 2) GROUP BY 1)"


@query("design code", "vdd_v budget_v bump_pitch_um", "SELECT d.design, unnest(['vdd_default', CASE WHEN pt.pitch IS NULL THEN 'pitch_default' ELSE 'pitch_measured' END]) AS code, 0.9 AS vdd_v, 0.9 * 0.05 AS budget_v, coalesce(pt.pitch, 200.0) AS bump_pitch_um FROM (SELECT DISTINCT design FROM m) d LEFT JOIN pt ON pt.design = d.design", f"{_RAW}, {_PITCH}")
def q_resolved_params(v: Views) -> DataFrame:
    """Supply, budget and bump pitch of each design, with the assumptions made for them."""
    stats = v.m.select(F.col("design").alias("design_id")).distinct()
    for c in ("die_w_um", "die_h_um", "vdd_v", "bump_pitch_um"):
        stats = stats.withColumn(c, F.lit(None).cast("double"))
    pitch = _keyed(spatial.pitch(v.b.where("design is not null"), ["design"], "bump_id"))
    params, assumed = bundles.resolve_params(stage(stats, "stats"), stage(pitch, "pitch"))
    return params.join(assumed, "design_id").select(F.col("design_id").alias("design"), "code", "vdd_v", "budget_v", "bump_pitch_um")


# files


@query("design scenario ty tx", "pred_v label_v", "SELECT design, scenario, ty, tx, phys_base_v AS pred_v, label_v FROM f WHERE phys_base_v IS NOT NULL")
def q_predictions_file(v: Views) -> DataFrame:
    """Predictions written as CSV under a comment and read again."""
    path = _folder(v, "predictions")
    bundles.write_predictions(v.f.where("phys_base_v is not null").select(*GROUP, "ty", "tx", F.col("phys_base_v").alias("pred_v"), "label_v"), path, "coarse predictions")
    return bundles.read_predictions(v.spark, path, "design string, scenario string, ty int, tx int, pred_v double, label_v double")


@query("design_id scenario module", "activity mission_weight", "SELECT design AS design_id, scenario, module, activity, mission_weight FROM a WHERE design IS NOT NULL")
def q_bundle_files(v: Views) -> DataFrame:
    """A table of all bundles written by design as CSV and read again with its declared types."""
    path = _folder(v, "bundles")
    bundles.write_bundles({"activity": _keyed(v.a.where("design is not null")).select("design_id", "scenario", "module", "activity", "mission_weight")}, path)
    return v.spark.read.schema(f"{bundles.ddl('activity')}, design_id string").csv(f"{path}/activity", header=True, nanValue="nan", pathGlobFilter="*.csv").select("design_id", "scenario", "module", "activity", "mission_weight")


@query("x_um y_um", "drop_v", "SELECT fx * 7.5 AS x_um, fy * 7.5 AS y_um, drop_v FROM r", digits=9)
def q_voltage_file(v: Views) -> DataFrame:
    """Drops written as absolute node voltages and read as drops again."""
    path = _folder(v, "voltages")
    v.r.select((F.col("fx") * 7.5).alias("X location"), (F.col("fy") * 7.5).alias("Y location"), (0.9 - F.col("drop_v")).alias("Voltage")).write.csv(path, header=True)
    return adapters.voltages(v.spark, path, 0.9)


@query("design json", "", "SELECT design, cast(to_json({design: design, module: module, n: count(*)}) AS varchar) AS json FROM i WHERE module IS NOT NULL AND design IS NOT NULL GROUP BY design, module")
def q_json_rows(v: Views) -> DataFrame:
    """Counts as lines of JSON."""
    counts = v.i.where("module is not null and design is not null").groupBy("design", "module").agg(F.count("*").alias("n"))
    return counts.select("design", F.to_json(F.struct("design", "module", "n")).alias("json"))


# splits

_CLEAN = f"(SELECT DISTINCT {_NAME.format('design')} AS design FROM features WHERE design IS NOT NULL AND scenario IS NOT NULL)"


@query("design n_parts", "", f"SELECT design, 1 AS n_parts FROM {_CLEAN}")
def q_split_once(v: Views) -> DataFrame:
    """How many parts of the fixed holdout each design is in: one."""
    hold, pool = splits.holdout(splits.design_list(v.f), 3)
    parts = v.spark.createDataFrame([(d, p) for p, ds in (("holdout", hold), ("pool", pool)) for d in ds], "design string, part string")
    return parts.groupBy("design").agg(F.count("*").alias("n_parts"))


@query("seed fold n_train n_calib n_both n_alike", "", f"SELECT cast(s AS integer) AS seed, cast(f AS integer) AS fold, (SELECT count(*) FROM {_CLEAN}) - 6 AS n_train, 3 AS n_calib, 0 AS n_both, 1 AS n_alike FROM (SELECT unnest(range(5)) AS s), (SELECT unnest(range(5)) AS f)")
def q_split_sizes(v: Views) -> DataFrame:
    """Sizes of the twenty-five runs; designs both in train and calibration; runs with the same calibration set."""
    runs = stage(splits.run_table(v.spark, splits.holdout(splits.design_list(v.f), 3)[1], 3, 5, [0, 1, 2, 3, 4]), "runs")
    run = ["seed", "fold"]
    each = runs.groupBy(*run, "design").agg(F.count_if(F.col("partition") == "train").alias("t"), F.count_if(F.col("partition") == "calib").alias("c"))
    sizes = each.groupBy(*run).agg(F.sum("t").alias("n_train"), F.sum("c").alias("n_calib"), F.count_if((F.col("t") > 0) & (F.col("c") > 0)).alias("n_both"), F.array_sort(F.collect_list(F.when(F.col("c") > 0, F.col("design")))).alias("chosen"))  # three names
    alike = sizes.groupBy("chosen").agg(F.count("*").alias("n_alike"))
    return sizes.join(alike, "chosen").select(*run, "n_train", "n_calib", "n_both", "n_alike")


# order and shape


@query("design n place", "worst", "SELECT design, count(*) AS n, row_number() OVER (ORDER BY max(drop_v) DESC, design) AS place, max(drop_v) AS worst FROM r WHERE design IS NOT NULL GROUP BY 1")
def q_sorted_designs(v: Views) -> DataFrame:
    """Designs by their worst drop, in order, with their place: the sort is by range over all partitions, and the place
    is the rows of the partitions before and the place within."""
    worst = v.r.where("design is not null").groupBy("design").agg(F.count("*").alias("n"), F.max("drop_v").alias("worst"))
    ordered = stage(worst.sort(F.desc("worst"), "design").withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "sorted")
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return ordered.join(F.broadcast(before), "part").select("design", "n", (F.col("before") + F.col("id") - F.col("first") + 1).alias("place"), "worst").sort("place")


@query("design inst_id", "x_um", "SELECT design, inst_id, x_um FROM (SELECT *, row_number() OVER (PARTITION BY design ORDER BY x_um DESC, inst_id) AS k FROM i WHERE is_seq = 1) WHERE k = 1 AND design IS NOT NULL")
def q_first_match(v: Views) -> DataFrame:
    """The first sequential cell of each design from the right: one row a group, without sorting groups."""
    cells = v.i.where("is_seq = 1 and design is not null")
    first = cells.groupBy("design").agg(F.min(F.struct((-F.col("x_um")).alias("o"), "inst_id", "x_um")).alias("b"))
    return first.select("design", "b.inst_id", "b.x_um")


@query("design scenario ty line", "", f"SELECT design, scenario, t AS ty, string_agg(printf('%.4f', coalesce(v, 0)), ' ' ORDER BY x) AS line FROM (SELECT d.design, d.scenario, y.t, x.x, any_value(f.grid_bumps) AS v FROM (SELECT DISTINCT design, scenario FROM f) d CROSS JOIN (SELECT unnest(range({N})) AS t) y CROSS JOIN (SELECT unnest(range({N})) AS x) x LEFT JOIN f ON f.design = d.design AND f.scenario = d.scenario AND f.ty = y.t AND f.tx = x.x GROUP BY ALL) GROUP BY 1, 2, 3")
def q_dense_map(v: Views) -> DataFrame:
    """Maps of 24 by 24 tiles, a line a row: absent tiles are 0."""
    tiles = v.f.select(*GROUP, "ty", "tx", F.coalesce("grid_bumps", F.lit(0.0)).alias("v")).where(f"ty between 0 and {N - 1} and tx between 0 and {N - 1}")
    return reshape.dense_lines(tiles, GROUP, "v", N).select(*GROUP, "ty", F.array_join(F.transform("line", lambda x: F.format_string("%.4f", x)), " ").alias("line"))


@query("day month n", "", "SELECT strftime(loaded_at, '%Y-%m-%d') AS day, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n FROM irmap WHERE loaded_at IS NOT NULL GROUP BY 1, 2")
def q_load_days(v: Views) -> DataFrame:
    """Rows loaded by day, with date stamps as text."""
    at = table(v.spark, v.sf, "irmap").where("loaded_at is not null")
    return at.groupBy(F.date_format("loaded_at", "yyyy-MM-dd").alias("day"), F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("design module side", "", "SELECT design, module, CASE WHEN run * 2 <= total THEN 'first' ELSE 'second' END AS side FROM (SELECT design, module, sum(w) OVER (PARTITION BY design ORDER BY module ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY design) AS total FROM (SELECT design, module, round(coalesce(rated_power_mw, 0) * 1000)::bigint AS w FROM m))")
def q_weighted_cut(v: Views) -> DataFrame:
    """Modules of each design parted where half of the rated power (in microwatts) is reached, in order of their names."""
    rows = v.m.withColumn("w", F.round(F.coalesce("rated_power_mw", F.lit(0.0)) * 1000).cast("bigint"))
    return shares.weighted_cut(rows, ["design"], ["module"], "w", [0.5]).select("design", "module", F.when(F.col("part") == 0, "first").otherwise("second").alias("side"))


@query("design n_scenarios n_known", "", "SELECT design, count(DISTINCT scenario) AS n_scenarios, count(DISTINCT scenario) FILTER (scenario IN ({0})) AS n_known FROM f WHERE scenario IN ({0}) OR design IN (SELECT design FROM m) GROUP BY 1".format(", ".join(f"'{s}'" for s in ("idle", "seq_read"))))
def q_membership(v: Views) -> DataFrame:
    """Rows of chosen scenarios or of designs with modules."""
    chosen = F.col("scenario").isin("idle", "seq_read")
    known = v.m.select("design").distinct().withColumn("known", F.lit(True))
    rows = v.f.select(*GROUP).distinct().join(known, "design", "left").where(chosen | F.col("known"))
    return rows.groupBy("design").agg(F.count_distinct("scenario").alias("n_scenarios"), F.count_distinct(F.when(chosen, F.col("scenario"))).alias("n_known"))


QUERIES, ORACLE = query.queries, query.oracle
