"""Log files, label indexes and corpus folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtriage.functions.joins import lookup
from flowtriage.functions.ranking import hash_position

INDEX_SCHEMA = "filename string, label string, pipeline string, executor string"
LOG_SUFFIXES = (".log", ".txt")
_MALFORMED = "_malformed"


def ingest_logs(files: DataFrame) -> DataFrame:
    """``filename`` and ``text`` of log files given as path and content bytes.

    Only log suffixes are kept; bytes that are not UTF-8 become U+FFFD.
    """
    is_log = F.col("path").endswith(LOG_SUFFIXES[0]) | F.col("path").endswith(LOG_SUFFIXES[1])
    return files.where(is_log).select(
        F.substring_index("path", "/", -1).alias("filename"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All log files of a folder, one row each."""
    return ingest_logs(spark.read.format("binaryFile").option("pathGlobFilter", "*.{log,txt}").load(folder))


def _index_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{INDEX_SCHEMA}, {_MALFORMED} string"
    return spark.read.csv(path, header=True, schema=schema, columnNameOfCorruptRecord=_MALFORMED, enforceSchema=True)


def read_label_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an index file or folder that have all columns and a file name."""
    rows = _index_lines(spark, path)
    return rows.where(F.col(_MALFORMED).isNull() & F.col("filename").isNotNull()).drop(_MALFORMED)


def malformed_index_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an index that :func:`read_label_index` leaves out."""
    rows = _index_lines(spark, path)
    whole = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in ("filename", "label", "pipeline", "executor")])
    return rows.where(F.col(_MALFORMED).isNotNull() | F.col("filename").isNull()).select(F.coalesce(_MALFORMED, whole).alias("line"))


def labelled_logs(index: DataFrame, logs: DataFrame) -> DataFrame:
    """Index rows whose file exists, with its text; others are dropped.

    A file that very many index rows name is dealt out with copies of its text
    (:func:`flowtriage.functions.joins.lookup`), so no task holds all its rows.
    """
    numbered = index.withColumn("_row", F.monotonically_increasing_id())
    found = lookup(numbered, logs.select("filename", "text"), "filename", ["_row"], keys=index.select("filename"))
    return found.where(F.col("text").isNotNull()).select(
        "filename", "text", "label", F.coalesce("pipeline", F.lit("")).alias("pipeline"), F.lit("real").alias("source")
    )


def corpus_index(items: DataFrame) -> DataFrame:
    """File name and labels of every item, numbered across the whole corpus."""
    numbered = hash_position(items, "run_id")
    return numbered.withColumn("filename", F.format_string("%s_%04d.log", "label", "position"))


def save_corpus(items: DataFrame, folder: str) -> str:
    """Write texts by label and their index; returns the index folder.

    Texts stay one record per item instead of one small file each.
    """
    indexed = corpus_index(items)
    indexed.select("filename", "text", "label").write.mode("overwrite").partitionBy("label").parquet(f"{folder}/texts")
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("filename", "label", "pipeline", "executor")]
    indexed.select(*columns).write.mode("overwrite").csv(f"{folder}/labels", header=True, emptyValue="")
    return f"{folder}/labels"


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Items written by :func:`save_corpus`, through the labelled scan."""
    texts = spark.read.parquet(f"{folder}/texts").select("filename", "text")
    return labelled_logs(read_label_index(spark, f"{folder}/labels"), texts)
