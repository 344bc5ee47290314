"""Design bundles: directories of CSV files, one per table, in a corpus with a manifest."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.numeric import finite
from gridloom.operators.reshape import upsert
from gridloom.session import exists
from gridloom.sources.schema import BUDGET_FRAC, BUNDLE, MANIFEST, OPTIONAL, VDD_V


def load_config(path: str) -> dict:
    """A YAML file; raises if the fine grid is no multiple of the coarse one."""
    config = yaml.safe_load(Path(path).read_text()) or {}
    grid = config.get("grid", {})
    for axis in ("nx", "ny"):
        if grid.get(f"{axis}_fine", 0) % (grid.get(f"{axis}_coarse") or 1):
            raise ValueError(f"{axis}_fine must be a multiple of {axis}_coarse")
    return config


def find_csv(directory: str, base: str) -> str | None:
    """``base.csv``, else ``base.csv.gz``, else nothing."""
    return next((str(p) for ext in ("csv", "csv.gz") if (p := Path(directory, f"{base}.{ext}")).exists()), None)


def read_csv(spark: SparkSession, paths: str | list[str], table: str, mode: str = "FAILFAST") -> DataFrame:
    """One table with its declared types; the text ``nan`` is NaN. Extra columns are dropped."""
    return spark.read.schema((BUNDLE | OPTIONAL | {"manifest": MANIFEST})[table]).csv(paths, header=True, mode=mode, nanValue="nan", enforceSchema=False)


def ddl(table: str) -> str:
    """The declared columns of a table, as text."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (BUNDLE | OPTIONAL)[table])


def _design_of(path: str):
    return F.element_at(F.split(F.col(path), "/"), -2)


def load_corpus(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """All designs of the manifest as one frame a table, keyed by ``design_id`` (the directory's name): one scan per
    table whatever the number of designs. Raises if the manifest or a required file is missing."""
    at = find_csv(directory, "manifest")
    if not at:
        raise FileNotFoundError(f"{directory} has no manifest")
    manifest = read_csv(spark, at, "manifest")
    rows = manifest.select("design_id", "path").collect()  # one short row a design
    if any(r["path"] is None for r in rows):
        raise ValueError("a manifest row has no path")
    homes = [r["path"] if os.path.isabs(r["path"]) else str(Path(directory, r["path"])) for r in rows]
    frames: dict[str, DataFrame] = {"manifest": manifest}
    for name in BUNDLE | OPTIONAL:
        files = [find_csv(h, name) for h in homes]
        if name in BUNDLE and (absent := [h for h, f in zip(homes, files, strict=True) if not f]):
            raise FileNotFoundError(f"{name}.csv is missing in {absent[:5]}")
        if found := [f for f in files if f]:
            df = read_csv(spark, found, name)
            frames[name] = df if "design_id" in df.columns else df.withColumn("design_id", _design_of("_metadata.file_path"))
    return frames


def load_design(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """One validated bundle; raises ValueError with every failure."""
    from gridloom.operators.checks import validate

    frames = {n: read_csv(spark, f, n) for n in BUNDLE | OPTIONAL if (f := find_csv(directory, n))}
    missing = [n for n in BUNDLE if n not in frames]
    if missing:
        raise ValueError(f"missing files: {missing}")
    keyed = {n: df if "design_id" in df.columns else df.withColumn("design_id", F.lit(Path(directory).name)) for n, df in frames.items()}
    faults = validate(keyed).orderBy("check", "file", "message").collect()  # a few a check: of one design
    if faults:
        raise ValueError("; ".join(f"{r['file']}: {r['message']}" for r in faults))
    return keyed


def write_bundles(frames: dict[str, DataFrame], directory: str, form: str = "csv") -> None:
    """Every table, partitioned by design; CSV for exchange, Parquet for use."""
    for name, df in frames.items():
        keyed = "design_id" in df.columns and name != "manifest"
        # rows of a design meet in one file each, or in several where they are many
        writer = (df.hint("rebalance", "design_id") if keyed else df).write.mode("overwrite")
        writer = writer.partitionBy("design_id") if keyed else writer
        (writer.option("header", True).csv if form == "csv" else writer.parquet)(f"{directory}/{name}")


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["design_id"])


def resolve_params(stats: DataFrame, bumps_pitch: DataFrame, vdd: float = VDD_V, fraction: float = BUDGET_FRAC, pitch: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """(parameters of each design, assumptions made): supply, budget and bump pitch, from the design's own figures,
    else measured from its bumps, else the defaults."""
    joined = stats.join(bumps_pitch, "design_id", "left")
    own_vdd, own_pitch = finite("vdd_v"), finite("bump_pitch_um")
    params = joined.select("design_id", "die_w_um", "die_h_um", F.coalesce(own_vdd, F.lit(vdd)).alias("vdd_v"), (F.coalesce(own_vdd, F.lit(vdd)) * fraction).alias("budget_v"), F.coalesce(own_pitch, F.col("pitch"), F.lit(pitch)).alias("bump_pitch_um"))
    codes = F.array_compact(F.array(F.when(own_vdd.isNull(), "vdd_default"), F.when(own_pitch.isNull() & F.col("pitch").isNotNull(), "pitch_measured"), F.when(own_pitch.isNull() & F.col("pitch").isNull(), "pitch_default")))
    return params, joined.select("design_id", F.explode(codes).alias("code")).dropDuplicates(["design_id", "code"])


def toggle_rates(spark: SparkSession, path: str | None) -> DataFrame:
    """Measured rates by scenario and module; an empty frame without the file or its columns."""
    schema = "scenario string, module string, rate double"
    if not path or not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.csv(path, header=True)
    if not {"scenario", "module", "toggles_per_bit_per_us"} <= set(df.columns):
        return spark.createDataFrame([], schema)
    return df.select("scenario", "module", F.col("toggles_per_bit_per_us").try_cast("double").alias("rate")).dropna()


def write_predictions(df: DataFrame, path: str, comment: str) -> None:
    """A prediction table as CSV; each file of it begins with a comment line and the names of the columns."""
    text = df.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))
    head = f"# {comment}\n{','.join(df.columns)}"

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        yield from (pa.RecordBatch.from_arrays(b.columns, names=["value"]) for b in batches)

    text.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, comment="#", enforceSchema=False)


def write_json(path: str, content: dict) -> None:
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def unpack_upload(archive: str, directory: str) -> list[str]:
    """The files of a zip, flattened to their names; hidden and system entries are skipped, equal names are an error."""
    names: list[str] = []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            name = Path(info.filename).name
            if info.is_dir() or name.startswith(".") or "__MACOSX" in info.filename:
                continue
            if name in names:
                raise ValueError(f"two files are named {name}")
            names.append(name)
            Path(directory, name).write_bytes(z.read(info))
    return names


def upload_mode(columns: dict[str, list[str]]) -> str:
    """``bundle`` if statistics and instances are there, ``predictions`` if a table has the five required columns."""
    if {"design_stats", "instances"} <= set(columns):
        return "bundle"
    if any({"design", "scenario", "tile_id", "pred_v", "label_v"} <= set(c) for c in columns.values()):
        return "predictions"
    raise ValueError("neither a bundle nor predictions")


def complete_predictions(df: DataFrame) -> DataFrame:
    """Uploaded predictions with the columns they may lack."""
    for c in ("coarse_v", "lo_v", "hi_v"):
        df = df if c in df.columns else df.withColumn(c, F.col("pred_v"))
    return df if "partition" in df.columns else df.withColumn("partition", F.lit("uploaded"))
