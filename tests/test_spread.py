from pyspark.sql import functions as F

from flowtriage.plans import registry
from flowtriage.sources import corpus


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _one_row_group(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 97).alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")


def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path):
    """The file is cut into more splits than there are cores, but one of them holds all rows."""
    _one_row_group(spark, tmp_path, 30_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        scan = corpus.table(spark, str(tmp_path), "orders")
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and max(_sizes(scan)) == 30_000
        sizes = _sizes(corpus.spread(scan, "o_orderkey", 1_000))
        assert sum(sizes) == 30_000 and max(sizes) < 1_300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tasks_grow_with_rows_and_not_with_cores(spark, tmp_path, monkeypatch):
    """Twice the rows are twice the tasks, for every query over the logs."""
    monkeypatch.setattr(corpus.spread, "__defaults__", (500,))
    for n in (5_000, 10_000):
        _one_row_group(spark, tmp_path / str(n), n)
        verdicts = registry.QUERIES["run_health"](spark, str(tmp_path / str(n)))
        sizes = _sizes(verdicts)
        assert sum(sizes) == n and len(sizes) == n // 500 and max(sizes) < 700


def test_small_and_well_dealt_scans(spark):
    """Nothing is shuffled where the tasks are small enough and many enough; empty tables pass."""
    cores = spark.sparkContext.defaultParallelism
    well = spark.range(0, 1_000, 1, 2 * cores).withColumnRenamed("id", "k")
    assert corpus.spread(well, "k", 1_000) is well
    assert len(_sizes(corpus.spread(spark.range(1_000).coalesce(1), "id", 1_000))) == cores
    assert corpus.spread(spark.range(0), "id").count() == 0
