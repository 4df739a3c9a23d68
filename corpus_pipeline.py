"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  ``run`` writes every
stage to the shared folder and goes on from there, so a lost executor costs at
most the stage at work.

Rows with null or empty texts are judged like any other: their measures are
zero, they are near copies of each other, hold no benchmark item and have no
tokens.  Empty tables pass through all stages as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtriage.llm import budget_mix, decontaminate, interleave, pu_classifier, simhash
from flowtriage.llm.common import DOCUMENT_COLUMNS, table
from flowtriage.session import checkpoint_dir

# One epoch, so that no document comes twice; a budget that leaves room for the weights to act.
MIX_PERCENT = 90
MIX_EPOCHS = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on ``docs`` and the labels, accepts."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = pu_classifier.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every group of near copies."""
    return simhash.representatives(docs.select(*DOCUMENT_COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budget of their domain, language and source."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return budget_mix.mix(docs, budget_percent=MIX_PERCENT, max_epochs=MIX_EPOCHS).select(*DOCUMENT_COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their size, shard and slot."""
    return interleave.interleave(docs.select(*DOCUMENT_COLUMNS))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]

# The classifier and the fingerprints have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
