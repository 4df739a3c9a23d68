from pyspark.sql import functions as F

from flowtriage.functions.joins import lookup


def test_lookup_with_hot_and_missing_keys_equals_a_left_join(spark):
    """One key holds a third of the rows, another third has none."""
    n = 900
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    left = spark.range(n).select("id", key.cast("bigint").alias("key"))
    right = spark.range(0, n, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("fact")).unionByName(
        spark.createDataFrame([(7, 70)], "key bigint, fact bigint")
    )
    expected = sorted(left.join(right, "key", "left").select("id", "key", "fact").collect())
    for rows_per_copy in (10, 1_000_000):
        got = lookup(left, right, "key", ["id"], rows_per_copy).select("id", "key", "fact").collect()
        assert sorted(got, key=lambda r: r.id) == sorted(expected, key=lambda r: r.id)


def test_list_of_hot_keys_is_bounded(spark, monkeypatch):
    """At most two hot keys are split, and the result stays a left join."""
    from flowtriage.functions import joins

    monkeypatch.setattr(joins, "MOST_HOT_KEYS", 2)
    left = spark.range(1000).select("id", (F.col("id") % 10).alias("key"))
    right = spark.range(10).select(F.col("id").alias("key"), (F.col("id") * 2).alias("fact"))
    got = lookup(left, right, "key", ["id"], 10).collect()
    assert len(got) == 1000 and all(r.fact == 2 * r.key for r in got)


def test_hot_key_rows_are_spread(spark):
    left = spark.range(1000).select("id", F.lit(1).cast("bigint").alias("key"))
    right = spark.createDataFrame([(1, "x")], "key bigint, fact string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(left, right, "key", ["id"], 10)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 1000 and max(sizes) < 400
