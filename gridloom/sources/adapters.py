"""Other inputs: headerless matrices, geometry in JSON, timing reports, node voltages."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import first_number
from gridloom.session import exists

CHANNELS = ("current", "eff_dist", "pdn_density", "ir_drop")
#: File of each channel.
FILES = {"current": "current_map.csv", "eff_dist": "eff_dist_map.csv", "pdn_density": "pdn_density.csv", "ir_drop": "ir_drop_map.csv"}


def list_testcases(root: str) -> list[str]:
    """Directories below ``root`` that hold all four matrices."""
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and all((p / f).exists() for f in FILES.values())) if Path(root).is_dir() else []


def matrices(spark: SparkSession, root: str, testcase: str) -> DataFrame:
    """channel, y, x, value. Lines are numbered within their file by their place, which Spark keeps for files of one
    split; matrix files are small. Raises if the shapes differ."""
    frames = []
    for channel, file in FILES.items():
        text = spark.read.text(str(Path(root, testcase, file)), wholetext=True)
        lines = text.select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("y", "line"))
        frames.append(lines.select(F.lit(channel).alias("channel"), "y", F.posexplode(F.split("line", ",")).alias("x", "cell")).select("channel", "y", "x", F.trim("cell").try_cast("double").alias("value")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    shapes = out.groupBy("channel").agg(F.max("y").alias("y"), F.max("x").alias("x"), F.count("*").alias("n")).collect()  # four rows
    if len({(r["y"], r["x"], r["n"]) for r in shapes}) != 1 or len(shapes) != len(FILES):
        raise ValueError(f"the matrices of {testcase} differ in shape")
    return out


def matrix_figures(df: DataFrame, keys: list[str], value: str = "value", scale: float = 1.0) -> DataFrame:
    """Sum, greatest, mean and least value of each matrix."""
    v = F.col(value) * scale
    return df.groupBy(*keys).agg(F.sum(v).alias("total"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.min(v).alias("least"))


_BOX = "struct<name:string,master:string,x0:double,y0:double,x1:double,y1:double>"
GEOMETRY = f"die_um array<double>, dbu int, insts array<{_BOX}>, macros array<{_BOX}>, straps array<{_BOX}>, pads array<struct<name:string,x:double,y:double>>"


def geometry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(GEOMETRY).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def exploded(geo: DataFrame, part: str) -> DataFrame:
    """One row per instance, macro, strap or pad of each geometry."""
    return geo.select("file", F.posexplode(part).alias("place", "p")).select("file", "place", "p.*")


def timing_paths(text: DataFrame, names: DataFrame, begin: str, end: str) -> DataFrame:
    """Paths of timing reports. ``text``: file, value (a whole report). ``names``: file, inst_name, inst_id. ``begin`` and
    ``end``: the marks between which the report's paths stand; a report without them raises. Result: file, path_no,
    endpoint, slack_ns, delay_ns, inst_ids (distinct, ascending; that of the endpoint if a path has none).

    A report is read by its columns: a line is parted at its blanks. Fixed values: a path begins with ``Startpoint:``;
    ``Endpoint:`` is followed by its pin; the lines that end in ``slack (MET)`` or ``slack (VIOLATED)`` and in ``data
    arrival time`` begin with their number; a line of two numbers, perhaps an edge, a pin and a cell in brackets is a
    stage of the path."""
    marked = F.when(F.col("value").contains(begin) & F.col("value").contains(end), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no marked paths in "), "file")))
    body = F.split_part(F.split_part(marked, F.lit(begin), F.lit(2)), F.lit(end), F.lit(1))
    pieces = F.split(body, "Startpoint:")
    each = text.select("file", F.posexplode(F.slice(pieces, 2, F.size(pieces))).alias("path_no", "piece"))
    lines = F.filter(F.transform(F.split("piece", "\n"), lambda row: F.split(F.trim(F.translate(row, "\t\r", "  ")), " +")), lambda w: F.size(w) > 1)
    each = each.select("file", "path_no", lines.alias("lines"))
    word = lambda w, i: F.get(w, F.lit(i))
    first = lambda keep, take: F.get(F.transform(F.filter("lines", keep), take), 0)
    number = lambda w, i=0: word(w, i).try_cast("double")
    endpoint = first(lambda w: word(w, 0) == "Endpoint:", lambda w: word(w, 1))
    slack = first(lambda w: (word(w, 1) == "slack") & word(w, 2).isin("(MET)", "(VIOLATED)"), number)
    arrival = first(lambda w: F.array_join(F.slice(w, 2, 3), " ") == "data arrival time", number)
    edge = lambda w: word(w, 2).isin("v", "^", "r", "f", "&")
    cell = lambda w: F.when(edge(w), word(w, 4)).otherwise(word(w, 3))
    stages = F.filter("lines", lambda w: number(w, 0).isNotNull() & number(w, 1).isNotNull() & F.coalesce(cell(w).startswith("("), F.lit(False)))
    instance = lambda pin: F.array_join(F.slice(F.split(pin, "/"), 1, F.greatest(F.size(F.split(pin, "/")) - 1, F.lit(1))), "/")
    pins = F.transform(stages, lambda w: instance(F.when(edge(w), word(w, 3)).otherwise(word(w, 2))))
    zero = F.lit(0.0)
    paths = each.select("file", "path_no", F.coalesce(endpoint, F.lit("n/a")).alias("endpoint"), F.coalesce(slack, zero).alias("slack_ns"), F.coalesce(arrival, zero).alias("delay_ns"), pins.alias("pins"))
    paths = paths.withColumn("at_end", instance(F.col("endpoint")))
    pins = paths.select("file", "path_no", F.explode("pins").alias("inst_name"))
    hit = pins.join(names, ["file", "inst_name"]).groupBy("file", "path_no").agg(F.array_sort(F.collect_set("inst_id")).alias("ids"))  # those of one path
    last = names.select("file", F.col("inst_name").alias("at_end"), F.col("inst_id").alias("end_id"))
    joined = paths.join(hit, ["file", "path_no"], "left").join(last, ["file", "at_end"], "left")
    ids = F.coalesce("ids", F.when(F.col("end_id").isNotNull(), F.array("end_id")), F.array().cast("array<int>"))
    return joined.select("file", "path_no", "endpoint", "slack_ns", "delay_ns", ids.alias("inst_ids"))


def report_scalar(report: Column, names: list[str], default: float) -> Column:
    """The first of the named fields of a JSON report that reads as a number other than zero."""
    return F.coalesce(first_number(*(F.get_json_object(report, f"$['{n}']") for n in names)), F.lit(default))


def voltages(spark: SparkSession, path: str, vdd: float) -> DataFrame:
    """Node drops: x_um, y_um, drop_v. Columns are found by what their names hold; rows that are no numbers are left
    out; absolute voltages become drops; negative drops become 0. Raises without the file or its columns."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.csv(path, header=True)
    pick = lambda *parts: next((c for c in df.columns if any(p in c.lower() for p in parts)), None)
    x, y, v = pick("x location", "x_", "x"), pick("y location", "y_", "y"), pick("volt", "drop", "ir")
    if not (x and y and v):
        raise ValueError(f"no position and voltage among {df.columns}")
    rows = df.select(*(F.col(c).try_cast("double").alias(n) for c, n in ((x, "x_um"), (y, "y_um"), (v, "v")))).dropna()
    absolute = rows.agg(F.percentile_approx("v", 0.5).alias("m")).first()["m"]  # one number
    drop = F.lit(vdd) - F.col("v") if absolute is not None and absolute > 0.5 * vdd else F.col("v")
    return rows.select("x_um", "y_um", F.greatest(drop, F.lit(0.0)).alias("drop_v"))


def scenario_maps(measured: DataFrame, activity: DataFrame, reference: str = "seq_read", floor: float = 0.06, most: float = 0.199) -> DataFrame:
    """A measured map scaled to each scenario by its mean activity against the reference scenario's. The column
    ``synthetic`` tells scaled maps from the measured one; nothing is invented for uniform maps."""
    means = activity.groupBy("design", "scenario").agg(F.avg("activity").alias("m"))
    ref = means.where(F.col("scenario") == reference).select("design", F.col("m").alias("r"))
    factor = F.greatest(F.lit(floor), F.when(F.col("r") > 0, F.col("m") / F.when(F.col("r") > 0, F.col("r"))).otherwise(F.lit(floor)))
    scaled = measured.join(means.join(ref, "design"), "design").withColumn("drop_v", F.least(F.greatest(F.col("drop_v") * factor, F.lit(0.0)), F.lit(most)))
    return scaled.withColumn("synthetic", F.col("scenario") != reference).drop("m", "r")
