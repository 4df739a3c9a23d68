"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.llm.common import set_aside
from flowtriage.llm.running import key, running, shuffle_key

SHARDS = 40
SEED = 17
ROW_BYTES = 16
BUCKETS = 4096


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, and a fixed share per row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Deal the rows of ``docs`` into shards that all have the mixture of the whole.

    Within each source rows are ranked in a seeded shuffle.  The row of rank r
    among n stands at the fraction (r + u) / n, where u is fixed for a source
    in [0, 1), so that many small sources do not all stand at the same place.
    All rows, sorted by fraction, are cut into ``shards`` runs whose row
    counts are at most one apart; so every shard holds each source in
    proportion, up to a row for each source whose place falls to either side
    of a cut.  Ranks come from bucketed running sums: a
    source with most rows is spread over ``buckets`` parts.

    Keeps all columns and adds size (bytes of the text plus 16), text_crc32,
    shard, and slot (from 0 without gaps).  Null and empty texts have size 16
    and checksum 0; null sources are one stratum; rows with the same doc_id
    are told apart by their texts, and equal rows may swap places.  Columns of
    ``docs`` with the names of added ones are replaced.
    """
    if shards < 1 or not 1 <= buckets <= 1 << 20:
        raise ValueError("shards and buckets must be positive, buckets at most 2^20")
    added = ("size", "text_crc32", "shard", "slot")
    docs, named_back = set_aside(docs, ("doc_id", "text", "source"), added)
    rows = docs.withColumns({"size": text_bytes(F.col("text")), "text_crc32": text_crc32(F.col("text"))})
    rows = rows.withColumns(
        {"_source": key("source"), "_order": shuffle_key(seed, F.col("doc_id"), F.col("text_crc32")), "_one": F.lit(1)}
    ).withColumn("_bucket", (F.conv(F.substring("_order", 1, 5), 16, 10).cast("bigint") * buckets / (1 << 20)).cast("int"))
    order = ["_order", "size"]
    ranked = running(rows, ["_source"], "_bucket", order, "_one", "_rank", "_count")
    jitter = F.conv(F.substring(shuffle_key(seed, F.col("_source")), 1, 5), 16, 10).cast("double") / (1 << 20)
    placed = ranked.withColumn("_at", (F.col("_rank") + jitter) / F.col("_count")).withColumns(
        {"_bucket": (F.col("_at") * buckets).cast("int"), "_all": F.lit(0)}
    )
    dealt = running(placed, ["_all"], "_bucket", ["_at", "_source", *order], "_one", "_place", "_total")
    shard = F.expr(f"(_place * {shards}) div _total")
    slot = F.col("_place") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return dealt.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("bigint")).select(*named_back, *added)
