from datetime import datetime

from gridloom.streaming.file_drop import RAW, ingest, raw_stream


def test_dropped_files_are_loaded_once(spark, tmp_path):
    rows = [(1, "d", "bumps", 1, "1,2,3", datetime(2024, 1, 1)), (2, "d", "bumps", 2, "1,2", datetime(2024, 1, 1))]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = ingest(raw_stream(spark, str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["column_count"]
