"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtriage.session import checkpoint_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

BATCH_BYTES = "16m"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(0x632BE59BD9B4E019)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches of texts that Python workers get small, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it is counted to have at most ``most`` rows of a few bytes."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash pairs of 64-bit values, in order, to 64 bits."""
    with np.errstate(over="ignore"):
        x = (a * _GOLDEN) ^ (b + _SHIFT)
        x ^= x >> np.uint64(32)
        x *= _SPREAD
        x ^= x >> np.uint64(29)
    return x


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values, by doubling.

    A run of 2m is the pair of its halves; a length between powers of two is
    the pair of the two overlapping power-of-two runs that cover it.
    """
    if len(values) < n:
        return np.empty(0, np.uint64)
    out, size = values.astype(np.uint64), 1
    while 2 * size <= n:
        out, size = mix(out[:-size], out[size:]), 2 * size
    return out if size == n else mix(out[: -(n - size)], out[n - size :])


class Remembering(dict):
    """A bounded memory of a function of words; it is emptied when full."""

    def __init__(self, function, most: int = 1_000_000) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into ranges of about ``most`` in total size."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and only the columns used later are read."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def within_bytes(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``df``, to be broadcast if its text columns and 16 bytes a row come to at most ``most`` bytes."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = df.agg(F.sum(sum(texts, F.lit(16))).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= most else df


def set_aside(df: DataFrame, needed: tuple[str, ...], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """``df`` with its other columns under names that no helper column has, and the columns that name them back.

    ``needed`` columns keep their names.  Columns named in ``replaced`` are left out.
    """
    kept = [c for c in df.columns if c in needed or c.lower() not in {r.lower() for r in replaced}]
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in kept}
    away = {c: c if c in needed else f"aside {i}" for i, c in enumerate(kept)}
    renamed = df.select(*[F.col(quoted[c]).alias(away[c]) for c in kept])
    return renamed, [F.col(f"`{away[c]}`").alias(c) for c in kept]
