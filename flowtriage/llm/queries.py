"""The registered queries of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtriage.llm import (
    budget_mix,
    chat_trees,
    collocations,
    decontaminate,
    fuzzy_lines,
    interleave,
    oracle,
    pivot_index,
    pu_classifier,
    risk_rules,
    simhash,
    source_divergence,
    suffix_dedup,
    token_rollup,
)
from flowtriage.llm.common import small_side, table
from flowtriage.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = oracle.STATEMENTS

# A public byte-pair vocabulary and its splitting pattern; the path is a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_substring_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


@query
def op6_pu_quality(spark, sf_dir):
    return pu_classifier.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_budget_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return budget_mix.mix(docs).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


@query
def op5_interleave(spark, sf_dir):
    """Law ``rows``: the method cuts one global order into runs of rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return interleave.interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op3_reply_trees(spark, sf_dir):
    """All conversations, and one whose texts hold the template's own marks."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "\\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", marks), (-7, 1, "assistant", marks)]
    both = own.unionByName(spark.createDataFrame(extra, own.schema))
    return chat_trees.digests(chat_trees.format_trees(chat_trees.chains(both)))


@query
def op4_risk_rules(spark, sf_dir):
    return risk_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_token_rollup(spark, sf_dir):
    """All documents loaded, the load repeated, then take-downs of toxic and clean-ups of poor documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    tokenizers = {"byte_bpe_50k": token_rollup.byte_pair_counter(spark, VOCABULARY, PATTERN), "words": token_rollup.word_count}
    rollup = token_rollup.TokenRollup(spark, f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}", tokenizers)
    load = docs.withColumn("op", F.lit("insert"))
    rollup.apply("load", load)
    rollup.apply("load", load)
    none = F.lit(None).cast("string")
    deleted = labels.where("toxic = 1").select(F.lit("delete").alias("op"), "doc_id", *[none.alias(c) for c in ("source", "lang", "text")])
    poor = labels.where("toxic = 0 AND quality = 0").select("doc_id")
    squeezed = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    revised = docs.join(small_side(poor), "doc_id").withColumn("text", squeezed).withColumn("op", F.lit("revise"))
    rollup.apply("take-down", deleted.unionByName(revised))
    return rollup.totals()


@query
def op7_fuzzy_lines(spark, sf_dir):
    found = fuzzy_lines.duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")


@query
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_pivot_index(spark, sf_dir):
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_source_divergence(spark, sf_dir):
    return source_divergence.divergence(table(spark, sf_dir, "documents"))
