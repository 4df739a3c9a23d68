"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from flowtriage.llm.common import Remembering, bounded_batches, cut, grams, set_aside
from flowtriage.llm.components import bucket_components, components
from flowtriage.llm.fuzzy_lines import BANDS, banded

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
BLOCKS = 6
SEED = 42
# Of ``similar_groups``, which takes what the fingerprints miss.
SIMILAR_WORDS = 5
SIMILARITY = 0.8


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text, as a signed number.

    Words are runs of bytes other than ASCII white space, with A-Z in lower
    case.  Each shingle votes with the bits of its XXH64; a bit is set that
    over half the shingles set.  Null and wordless texts give zero.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def block_keys(value: Column, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS) -> Column:
    """All joint keys of ``blocks - max_distance`` blocks of a fingerprint.

    Two fingerprints that differ in at most ``max_distance`` bits agree in all
    but that many blocks, so they share at least one of these keys.
    """
    if not 0 < blocks - max_distance <= blocks <= 64:
        raise ValueError("there must be more blocks than differing bits")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    keys = []
    for chosen in combinations(range(blocks), blocks - max_distance):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(len(keys)).cast("tinyint").alias("table"), value.bitwiseAND(F.lit(signed)).alias("part")))
    return F.array(*keys)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _grouped(docs: DataFrame, max_distance: int, blocks: int) -> DataFrame:
    """(doc_id, own, fingerprint, component, component_id) of each row; own is a hash of the text."""
    bounded_batches(docs.sparkSession)
    rows = cut(docs.select("doc_id", F.xxhash64("text").alias("own"), fingerprint("text").alias("fingerprint")))
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    keys = block_keys(F.col("fingerprint"), max_distance, blocks)
    keyed = nodes.select(F.col("fingerprint").alias("node"), F.explode(keys).alias("bucket"))
    counts = keyed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    members = keyed.join(counts.select("bucket"), "bucket")

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.where(distance(F.col("a"), F.col("b")) <= max_distance)

    groups = bucket_components(members, verified).withColumnRenamed("node", "fingerprint")
    labelled = nodes.join(groups, "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    names = labelled.join(firsts, "component").select("fingerprint", "component", "component_id")
    return rows.join(names, "fingerprint")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Label each row of ``docs`` (doc_id, text) with its group of near copies.

    Equal fingerprints are one node; nodes are linked at ``max_distance`` or
    fewer differing bits.  Candidates share a joint key of blocks; they are
    verified, and components are found without listing the pairs of a group.

    Returns (doc_id, fingerprint bigint, component_id), one row per input row.
    component_id is the smallest doc_id in reach.  Null texts count as empty
    and are linked like any other; a null doc_id is never the smallest unless
    no other is in reach.  Repeated rows keep their number.
    """
    return _grouped(docs, max_distance, blocks).select("doc_id", "fingerprint", "component_id")


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _similar_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh64_intdigest
    hashes = Remembering(lambda word: digest(word, SEED))
    for batch in batches:
        nodes, values = [], []
        for node, text in zip(batch["node"], batch["text"]):
            words = _words(text)
            if words:
                found = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                nodes.append(node)
                values.append(grams(found, min(SIMILAR_WORDS, len(words))))
        if nodes:
            keys = banded(np.concatenate(values), np.repeat(np.arange(len(nodes)), [len(v) for v in values]), len(nodes))
            yield pd.DataFrame({"bucket": keys.ravel().view(np.int64), "node": np.repeat(nodes, BANDS)})


@F.pandas_udf(BooleanType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the exact Jaccard similarity of two texts' shingles of words is high enough."""
    last: dict[str, set] = {}

    def shingles(text: str) -> set:
        found = last.get(text)
        if found is None:
            if len(last) >= 8:
                last.clear()
            words = _words(text)
            size = max(1, min(SIMILAR_WORDS, len(words)))
            found = last[text] = set(zip(*(words[i:] for i in range(size))))
        return found

    out = []
    for one, two in zip(a, b):
        x, y = shingles(one), shingles(two)
        both = len(x & y)
        out.append(both >= SIMILARITY * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


def similar_groups(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, component) of the texts that are linked at a Jaccard similarity of 0.8 of their 5-word shingles.

    A node is the hash of a text.  Candidates share a band of their MinHash
    signatures (that of ``fuzzy_lines``) and are verified exactly, except
    where ``known`` (node, component) has linked them already.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), "text")
    keyed = cut(texts.mapInPandas(_similar_buckets, "bucket bigint, node bigint").distinct())
    several = keyed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    members = cut(keyed.join(several.select("bucket"), "bucket"))
    candidates = members.select("node").distinct()
    texts = cut(texts.join(candidates, "node", "left_semi").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        one = known.select(F.col("node").alias("a"), F.col("component").alias("ka"))
        two = known.select(F.col("node").alias("b"), F.col("component").alias("kb"))
        named = cut(pairs.join(one, "a").join(two, "b"))
        first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        held = named.where("ka != kb").select("a", "b").join(first, "a").join(second, "b")
        return named.where("ka = kb").select("a", "b").unionAll(held.where(similar("text_a", "text_b")).select("a", "b"))

    return bucket_components(members, verified, sparing=True)


def _widened(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` of ``_grouped``, joined where ``similar_groups`` links their texts."""
    groups = cut(groups)
    known = cut(groups.select(F.col("own").alias("node"), "component").distinct())
    found = cut(similar_groups(docs, known))
    # A group of texts joins the fingerprint components of its members: each is linked to the least of them.
    named = found.withColumnRenamed("component", "similar").join(known, "node").select("similar", "component").distinct()
    least = named.groupBy("similar").agg(F.min("component").alias("a"))
    joined = components(named.join(least, "similar").select("a", F.col("component").alias("b")))
    roots = joined.select(F.col("component").alias("root"), F.col("node").alias("component"))
    wider = groups.join(roots, "component", "left").withColumn("component", F.coalesce("root", "component"))
    wider = cut(wider.select("doc_id", "own", "component"))
    firsts = wider.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return wider.join(firsts, "component")


def representatives(
    docs: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, widen: bool = False
) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    With ``widen``, texts whose 5-word shingles have a Jaccard similarity of
    0.8 or more are near copies, too, however far their fingerprints are.
    One row per group stays: that of the smallest doc_id, and of several rows
    with that doc_id the one whose text has the least hash.
    """
    docs, named_back = set_aside(docs, ("doc_id", "text"))
    groups = _grouped(docs, max_distance, blocks)
    if widen:
        groups = _widened(docs, groups)
    groups = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy("component").agg(F.min("own").alias("_kept"), F.min("component_id").alias("_doc")).drop("component")
    own = docs.withColumn("_own", F.xxhash64("text"))
    joined = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_kept")))
    order = Window.partitionBy("doc_id", "_own").orderBy("_own")
    return joined.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*named_back)
