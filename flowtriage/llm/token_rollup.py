"""Token counts as delta-maintained rollups with idempotent batch commits.

A rollup lives in a shared folder.  ``ledger/batch=<id>`` holds one signed row
per changed document and tokenizer version, ``totals/batch=<id>`` their sums
by source, language and version.  The marker Spark writes last into a totals
folder commits the batch: what has no marker does not count and is written
over by the next try, and a committed batch is never applied again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from flowtriage.llm.common import bounded_batches

KEYS = ("source", "lang", "tokenizer")
_LEDGER = "doc_id bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint"
_TOTALS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def byte_pair_counter(spark: SparkSession, path: str, pattern: str):
    """A function from a text column to its number of byte-pair tokens.

    The vocabulary file of base64 tokens and ranks is read on the driver; its
    size is that of a vocabulary, and executors get it by broadcast.  Null
    texts have no tokens; special tokens are ordinary text.
    """
    bounded_batches(spark)
    with open(path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        lines = (line.split() for line in shared.value.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(text)) if text else 0 for text in batch], dtype="int64")

    return count


class TokenRollup:
    """Additive token totals of a changing corpus.

    ``tokenizers`` maps version names to functions from a text column to a
    count.  Changes have op, doc_id, source, lang and text:

    - ``insert`` adds a row's counts,
    - ``delete`` takes back all that committed batches hold for the doc_id,
    - ``revise`` does both.

    Other operations, deletes of unknown documents and of null doc_ids change
    nothing.  Rows of one doc_id are additive; a batch takes back a document
    once, however often it names it.  Null texts count as documents without
    tokens; null sources and languages are groups of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizers: Mapping[str, object]) -> None:
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), dict(tokenizers)

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        name = jvm.org.apache.hadoop.fs.Path(path)
        return name.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(name)

    def _committed(self) -> list[str]:
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals/batch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(f.getPath().getParent().getName().removeprefix("batch=") for f in found or ())

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch={batch}" for batch in self._committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _counted(self, rows: DataFrame) -> DataFrame:
        """Every tokenizer reads a text once; versions are rows."""
        pairs = [F.struct(F.lit(name).alias("tokenizer"), count(F.col("text")).alias("tokens")) for name, count in self.tokenizers.items()]
        return rows.select("doc_id", "source", "lang", F.inline(F.array(*pairs))).select(
            "doc_id", "source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("docs"), F.col("tokens").cast("bigint").alias("tokens")
        )

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; false if it was committed before.

        A batch must be tried again with the same changes, and batches one by one.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self._exists(f"{self.folder}/totals/batch={batch}/_SUCCESS"):
            return False
        changes = changes.select("op", F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "text")
        added = self._counted(changes.where("op IN ('insert', 'revise')"))
        touched = changes.where("op IN ('delete', 'revise') AND doc_id IS NOT NULL").select("doc_id").distinct()
        held = self._read("ledger", _LEDGER).join(touched, "doc_id").groupBy("doc_id", *KEYS)
        taken = held.agg((-F.sum("docs")).alias("docs"), (-F.sum("tokens")).alias("tokens")).where("docs != 0 OR tokens != 0")
        path = f"{self.folder}/ledger/batch={batch}"
        added.unionByName(taken).write.mode("overwrite").parquet(path)
        sums = self.spark.read.schema(_LEDGER).parquet(path).groupBy(*KEYS)
        sums = sums.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version, from the batch sums alone."""
        sums = self._read("totals", _TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 OR n_tokens != 0")

    def recounted(self) -> DataFrame:
        """The same totals summed from the document ledger, to audit the rollup."""
        sums = self._read("ledger", _LEDGER).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 OR n_tokens != 0")


def word_count(text: Column) -> Column:
    """Version of a token count that needs no vocabulary: runs other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
