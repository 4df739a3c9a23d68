"""Running sums over groups of any size, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key(name: str) -> Column:
    """A text column as a group key that is never null: null and "" stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A fixed pseudo-random text for a row; its order is a seeded shuffle."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary"))


def running(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, before: str, total: str) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of each group, and over the whole group.

    Rows of a group are ordered by ``bucket`` and then by ``order``.  No group
    is sorted in one task: only a bucket is, and buckets are shifted by the
    sums of those before them.  There are as many bucket sums as buckets, not
    rows.  Rows are dealt out by group and bucket, so that no coarser
    partitioning of the input keeps a large group in one task.
    """
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        df.groupBy(*by, bucket)
        .agg(F.sum(value).alias("_sum"))
        .select(
            *by,
            bucket,
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"),
            F.sum("_sum").over(Window.partitionBy(*by)).cast("bigint").alias(total),
        )
    )
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(value).over(within), F.lit(0))
    return (
        df.repartition(*by, bucket)
        .withColumn("_inner", inner)
        .join(sums, [*by, bucket])
        .withColumn(before, (F.col("_inner") + F.col("_shift")).cast("bigint"))
        .drop("_inner", "_shift")
    )
