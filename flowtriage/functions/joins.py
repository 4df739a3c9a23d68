"""Look-ups that stay balanced when many rows share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_COPY = 1_000_000
# At most so many hot keys are split, the hottest ones; any other holds less than this share of all rows.
MOST_HOT_KEYS = 1 << 16
_NULL_SALTS = 4096


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    salt_by: list[str],
    rows_per_copy: int = ROWS_PER_COPY,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Left join with a side that has one row per key.

    A key held by more than ``rows_per_copy`` rows is split: its rows are dealt
    out by the hash of ``salt_by``, and its one row on the right is copied to
    each part.  Other keys keep one copy.  Rows without a key match nothing and
    are spread out.  The list of hot keys is broadcast and has at most
    ``MOST_HOT_KEYS`` entries, the hottest.  ``keys`` may name a cheaper
    DataFrame with the same keys to count them in.
    """
    hot = F.broadcast(
        (left if keys is None else keys).where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows_per_copy)
        .orderBy(F.desc("_n"))
        .limit(MOST_HOT_KEYS)
        .select(key, F.ceil(F.col("_n") / rows_per_copy).cast("int").alias("_copies"))
    )
    parts = F.coalesce("_copies", F.lit(1))
    spread = F.when(F.col(key).isNull(), F.lit(_NULL_SALTS)).otherwise(parts)
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), spread).cast("int"))
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_copies").join(copied.drop("_copies"), [key, "_salt"], "left").drop("_salt")
