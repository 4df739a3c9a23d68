"""Process progress lines and run metadata of run logs, all within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.functions import rx
from flowtriage.functions.catalog import METADATA_REGEXES, PROCESS_REGEX

_PROCESS = rx.IGNORE_CASE + PROCESS_REGEX
_DONE = "100%"


def process_array(text: Column) -> Column:
    """All progress hits of a text.

    The full text is matched once; the groups come from the short hits.
    """
    hits = F.regexp_extract_all(text, F.lit(_PROCESS), F.lit(0))

    def parse(hit: Column) -> Column:
        def group(n: int) -> Column:
            return F.regexp_extract(hit, _PROCESS, n)

        progress = rx.strip(group(3))
        return F.struct(
            group(1).alias("hash"),
            rx.strip(group(2)).alias("name"),
            progress.alias("progress"),
            rx.as_long(group(4)).alias("completed"),
            rx.as_long(group(5)).alias("total"),
            (progress == _DONE).alias("done"),
        )

    return F.transform(hits, parse)


def processes(runs: DataFrame) -> DataFrame:
    """One row per progress hit, ``pos`` in order of appearance from 0."""
    return runs.select("run_id", F.posexplode(process_array(F.col("text"))).alias("pos", "p")).select(
        "run_id", F.col("pos").cast("bigint").alias("pos"), "p.*"
    )


def process_counts(text: Column, regex: str = _PROCESS, progress_group: int = 3) -> tuple[Column, Column]:
    """Number of progress hits and of finished ones."""
    progress = F.regexp_extract_all(text, F.lit(regex), F.lit(progress_group))
    done = F.filter(progress, lambda p: rx.strip(p) == _DONE)
    return F.size(progress).cast("bigint"), F.size(done).cast("bigint")


def process_rollup(runs: DataFrame) -> DataFrame:
    """Totals per run; ``failed_processes`` counts the unfinished ones."""
    # Only digits are read, so folded text and a case-sensitive regex give the same counts.
    total, done = process_counts(rx.fold(F.col("text")), rx.folded_regex(PROCESS_REGEX))
    return runs.select("run_id", total.alias("total_processes"), done.alias("completed_processes")).withColumn(
        "failed_processes", F.col("total_processes") - F.col("completed_processes")
    )


def process_fraction(process_rows: DataFrame) -> DataFrame:
    """Completed share of each process, 0 when its total is 0."""
    share = F.when(F.col("total") > 0, F.col("completed") / F.col("total")).otherwise(F.lit(0.0))
    return process_rows.select("run_id", "pos", "name", share.alias("fraction"))


def metadata_columns(text: Column) -> dict[str, Column]:
    return {
        name: rx.strip(rx.first(text, pattern, ignore_case))
        for name, (pattern, ignore_case) in METADATA_REGEXES.items()
    }


def run_metadata(runs: DataFrame) -> DataFrame:
    """First version, pipeline, revision, failed process, work dir, command and exit status."""
    columns = metadata_columns(F.col("text"))
    return runs.select("run_id", *[c.alias(name) for name, c in columns.items()])
