import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators import checks, generator
from gridloom.operators.features import Bundle, feature_table, with_labels
from gridloom.sources import adapters, bundles
from gridloom.sources.schema import BUNDLE, FEATURES


@pytest.fixture(scope="module")
def corpus(spark):
    frames = generator.corpus(spark, [0, 1], (800.0, 1500.0))
    return {n: df.cache() for n, df in frames.items()}


def test_generated_designs_are_valid(corpus):
    assert checks.columns_present(corpus) == []
    assert checks.validate(corpus).collect() == []


def test_generator_is_seeded(spark, corpus):
    again = generator.corpus(spark, [1], (800.0, 1500.0))["instances"]
    assert corpus["instances"].where("design_id = 'syn_001'").exceptAll(again).count() == 0


def test_faults_are_found(corpus):
    bad = dict(corpus)
    bad["activity"] = corpus["activity"].withColumn("activity", F.lit(2.0)).withColumn("mission_weight", F.lit(0.5))
    bad["irmap"] = corpus["irmap"].where("fy > 0").withColumn("drop_v", F.lit(3.0))
    bad["instances"] = corpus["instances"].withColumn("x_um", F.col("x_um") * 1000)
    bad["paths"] = corpus["paths"].withColumn("inst_ids", F.lit("0;x;99999999"))
    found = {r["check"] for r in checks.validate(bad).collect()}
    assert {"activity_range", "mission_weights", "full_grid", "drop_units", "drop_uniform", "within_die", "integers", "members"} <= found


def test_features_of_a_generated_corpus(spark, corpus):
    keyed = {n: df.withColumnRenamed("design_id", "design") for n, df in corpus.items()}
    params = keyed["design_stats"].select("design", "die_w_um", "die_h_um", "vdd_v", F.lit(0.4).alias("sheet"), F.lit(4.0).alias("bump"))
    table = feature_table(Bundle(params, keyed["modules"], keyed["macros"], keyed["instances"], keyed["bumps"], keyed["strap_planned"], keyed["activity"])).cache()
    assert table.columns[4:] == FEATURES
    assert table.count() == 2 * 6 * 576
    assert table.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in FEATURES)).first().asDict() == dict.fromkeys(FEATURES, 0)
    weak = table.groupBy("design", "ty", "tx").agg((F.max("grid_weak") - F.min("grid_weak")).alias("d"))
    assert weak.where("d > 0").count() == 0
    assert table.where("phys_base_rank > 1 or phys_base_rank <= 0").count() == 0
    cells = table.groupBy("design", "scenario").agg(F.sum("top_cells").alias("n")).join(keyed["instances"].groupBy("design").count(), "design")
    assert cells.where("n <> count").count() == 0
    labelled = with_labels(table, keyed["irmap"])
    assert labelled.where("label_v is null").count() == 0


def test_bundles_round_trip(spark, corpus, tmp_path):
    for d in ("syn_000", "syn_001"):
        (tmp_path / d).mkdir()
        for name in BUNDLE:
            rows = corpus[name].where(F.col("design_id") == d)
            text = rows.select([f.name for f in BUNDLE[name]]).toPandas().to_csv(index=False)
            if name == "bumps":
                (tmp_path / d / f"{name}.csv.gz").write_bytes(gzip.compress(text.encode()))
            else:
                (tmp_path / d / f"{name}.csv").write_text(text)
    (tmp_path / "manifest.csv").write_text("design_id,corpus,path,n_scenarios,n_instances,source\nsyn_000,c,syn_000,6,1,synthetic\nsyn_001,c,syn_001,6,1,synthetic\n")
    loaded = bundles.load_corpus(spark, str(tmp_path))
    assert loaded["bumps"].groupBy("design_id").count().count() == 2
    assert loaded["irmap"].count() == corpus["irmap"].count()
    assert set(bundles.load_design(spark, str(tmp_path / "syn_000"))) == set(BUNDLE)
    (tmp_path / "syn_001" / "paths.csv").unlink()
    with pytest.raises(FileNotFoundError):
        bundles.load_corpus(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        bundles.load_corpus(spark, str(tmp_path / "nowhere"))


def test_parameters_and_assumptions(spark):
    stats = spark.createDataFrame([("a", 1.0, 1.0, 1.1, float("nan")), ("b", 1.0, 1.0, None, 150.0)], "design_id string, die_w_um double, die_h_um double, vdd_v double, bump_pitch_um double")
    pitch = spark.createDataFrame([("a", 30.0)], "design_id string, pitch double")
    params, log = bundles.resolve_params(stats, pitch)
    assert {r.design_id: (r.vdd_v, r.bump_pitch_um) for r in params.collect()} == {"a": (1.1, 30.0), "b": (0.9, 150.0)}
    assert {(r.design_id, r.code) for r in log.collect()} == {("a", "pitch_measured"), ("b", "vdd_default")}


def test_matrices(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    for f in adapters.FILES.values():
        (tmp_path / "t1" / f).write_text("1,2\n3,4\n")
    assert adapters.list_testcases(str(tmp_path)) == ["t1"]
    m = adapters.matrices(spark, str(tmp_path), "t1")
    assert {(r.y, r.x): r.value for r in m.where("channel = 'current'").collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}
    (tmp_path / "t1" / "current_map.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        adapters.matrices(spark, str(tmp_path), "t1")


def test_timing_report(spark):
    report = """>>>PATHS_BEGIN<<<
Startpoint: a (rising)
Endpoint: u2/D (setup)
   0.10    0.10 ^ u1/Q (DFF_X1)
   0.20    0.30 v u2/D (DFF_X1)
           1.30   data arrival time
           -0.14   slack (VIOLATED)
Startpoint: b
Endpoint: u3
           0.50   data arrival time
>>>PATHS_END<<<"""
    names = spark.createDataFrame([("r", "u1", 5), ("r", "u2", 4), ("r", "u3", 9)], "file string, inst_name string, inst_id int")
    got = adapters.timing_paths(spark.createDataFrame([("r", report)], "file string, value string"), names, ">>>PATHS_BEGIN<<<", ">>>PATHS_END<<<").orderBy("path_no").collect()
    assert [(r.endpoint, r.slack_ns, r.delay_ns, r.inst_ids) for r in got] == [("u2/D", -0.14, 1.3, [4, 5]), ("u3", 0.0, 0.5, [9])]
    with pytest.raises(Exception, match="no marked paths"):
        adapters.timing_paths(spark.createDataFrame([("r", report)], "file string, value string"), names, "BEGIN OF PATHS", "END").collect()


def test_voltages_and_uploads(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Instance,X location,Y location,Voltage\na,1,2,1.05\nb,3,4,bad\nc,5,6,1.2\n")
    got = sorted((r.x_um, round(r.drop_v, 3)) for r in adapters.voltages(spark, str(tmp_path / "v.csv"), 1.1).collect())
    assert got == [(1.0, 0.05), (5.0, 0.0)]
    with pytest.raises(FileNotFoundError):
        adapters.voltages(spark, str(tmp_path / "none.csv"), 1.1)
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("x/modules.csv", "a")
        z.writestr("__MACOSX/modules.csv", "b")
    assert bundles.unpack_upload(str(tmp_path / "u.zip"), str(tmp_path)) == ["modules.csv"]
    assert bundles.upload_mode({"design_stats": [], "instances": []}) == "bundle"
    with pytest.raises(ValueError):
        bundles.upload_mode({"x": ["a"]})
