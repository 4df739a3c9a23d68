"""Session set-up for tests and benchmarks; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: str | int = "*", app: str = "flowtriage", memory: str = "16g") -> SparkSession:
    """A local session with settings for one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or one of our own where it is unset.

    The fallback only serves single-machine runs: a cluster must name a folder
    that outlives its executors in ``spark.checkpoint.dir``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="flowtriage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, schema: StructType | None = None, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, split by column ``by`` if named.

    It is computed once and a lost executor re-reads it.  ``schema`` may give
    its structs the vector type they stand for.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    reader = df.sparkSession.read
    return (reader if schema is None else reader.schema(schema)).parquet(path)
