"""Files that arrive in a folder, as a stream (an extension; the batch operators do not need it).

Valid records of dropped files become typed rows; bad ones keep their reason. Both are the batch operators applied
to each micro-batch. Windowed counts wait for late files up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.record_errors import bad_records, loaded_records

RAW = "line_id bigint, design_id string, file_name string, line_no int, raw_line string, loaded_at timestamp"


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def bad_per_hour(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Bad records per file kind, reason and hour."""
    bad = bad_records(stream, ["line_id", "file_name", "loaded_at"], "raw_line", "file_name")
    return bad.withWatermark("loaded_at", lateness).groupBy(F.window("loaded_at", "1 hour"), "file_name", "reason").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch once: loaded rows below ``good``, bad ones below ``bad``, by batch number, so that a
    batch that is repeated after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        keys = ["line_id", "design_id", "file_name"]
        loaded_records(batch, keys, "raw_line", "file_name").write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad_records(batch, keys, "raw_line", "file_name").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
