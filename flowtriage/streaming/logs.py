"""Triage of logs as they arrive.

Every triage operator works within one run's row and keeps no state, so the
batch operators run on a stream as they are; there is nothing to watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtriage.operators.classification import classify
from flowtriage.sources.files import ingest_logs

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log files of a folder as they appear, named by ``run_id``."""
    files = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).option("pathGlobFilter", "*.{log,txt}").load(folder)
    )
    return ingest_logs(files).withColumnRenamed("filename", "run_id")


def triage_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the verdict of every new log to a Parquet folder."""
    verdicts = classify(stream_logs(spark, folder)).select(
        "run_id", "run_health", "critical", "high", "medium", F.col("primary.id").alias("primary_id"), "triage_summary"
    )
    return (
        verdicts.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
