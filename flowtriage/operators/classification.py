"""Rule-based verdict per run, and catalogue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.functions import rx, sql
from flowtriage.functions.arrays import computed
from flowtriage.functions.catalog import CATEGORIES, SEVERITIES, Category
from flowtriage.operators import detection, processes


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share * 100)


def _severity_count(severity: str) -> Column:
    return F.size(F.filter("detected", lambda d: d["severity"] == severity)).cast("bigint")


def classify(runs: DataFrame, catalog: list[Category] = CATEGORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One verdict row per run, without a shuffle; columns named in ``keep`` come along.

    Columns: ``detected`` (all failures, best first), ``primary`` (the first or
    NULL), one count per severity, ``run_health`` and ``triage_summary``.
    """
    failed_process = processes.metadata_columns(F.col("text"))["failed_process"]
    found = (
        detection.with_detections(runs, catalog)
        .select("run_id", *keep, "detected", failed_process.alias("failed_process"))
        .withColumn("primary", F.get("detected", F.lit(0)))
        .withColumns({s: _severity_count(s) for s in SEVERITIES})
    )
    primary = F.col("primary")
    sentence = F.concat(
        primary["icon"], F.lit(" "), primary["label"], F.lit(" detected in "),
        F.coalesce(F.nullif("failed_process", F.lit("")), F.lit("unknown process")),
        F.lit(" (confidence: "), percent(primary["confidence"]),
        F.lit(", severity: "), primary["severity"], F.lit(")"),
    )
    return found.select(
        "run_id",
        *keep,
        "detected",
        "primary",
        *SEVERITIES,
        F.when(F.col("critical") > 0, "failed")
        .when(F.size("detected") > 0, "degraded")
        .otherwise("healthy")
        .alias("run_health"),
        F.when(primary.isNull(), "No known error patterns detected in this log.")
        .otherwise(sentence)
        .alias("triage_summary"),
    )


def parse(runs: DataFrame, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """Nested parse result per run: detections, processes, metadata and totals."""
    meta = processes.metadata_columns(F.col("text"))
    parsed = detection.with_detections(runs, catalog).select(
        "run_id",
        "detected",
        processes.process_array(F.col("text")).alias("processes"),
        F.struct(*[c.alias(name) for name, c in meta.items()]).alias("meta"),
    )
    done = F.size(F.filter("processes", lambda p: p["done"])).cast("bigint")
    return parsed.withColumn("total_processes", F.size("processes").cast("bigint")).withColumns(
        {"completed_processes": done, "failed_processes": F.col("total_processes") - done}
    )


def category_usage(runs: DataFrame, categories: DataFrame) -> DataFrame:
    """The catalogue with the number of runs labelled with each category."""
    labelled = runs.groupBy(F.col("label").alias("id")).agg(F.count("*").alias("n_runs"))
    return categories.join(labelled, "id", "left").select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "id", "label", "family", "severity",
        F.size("regexes").cast("bigint").alias("n_regexes"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
    )


def regex_reference(runs: DataFrame, regexes: DataFrame, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """Every regex of the catalogue with the number of runs it matches.

    One scan sums all regexes at once; only that single row is unpivoted.
    """
    counted = ", ".join(
        sql.struct(id=sql.string(c.id), regex_pos=str(i), n_runs=f"count_if({rx.hits('_folded', p)})")
        for c in catalog
        for i, p in enumerate(c.regexes)
    )
    folded = runs.select(rx.fold(F.col("text")).alias("_folded"))
    sums = folded.agg(F.expr(f"array({counted})").alias("sums")).select(F.inline(computed("sums")))
    return regexes.join(F.broadcast(sums), ["id", "regex_pos"]).select(
        "family", "id", "severity", F.col("regex_pos").cast("bigint").alias("regex_pos"), "regex", "n_runs"
    )
