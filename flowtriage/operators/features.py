"""The 42 structured features of a run log: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.functions import rx, sql
from flowtriage.functions.catalog import (
    CATEGORIES,
    ERROR_LINE_REGEX,
    EXIT_CODE_REGEX,
    EXIT_ONE_HOT,
    MARKER_REGEXES,
    MEMORY_AVAILABLE_REGEX,
    MEMORY_REQUESTED_REGEX,
    PROCESS_FEATURE_REGEX,
    WARNING_LINE_REGEX,
    Category,
    feature_names,
)
from flowtriage.operators import detection
from flowtriage.operators.processes import process_counts


def exit_code(folded: Column) -> Column:
    """0 when absent or "-", -1 when not an integer."""
    token = rx.first_folded(folded, EXIT_CODE_REGEX)
    return F.when(token.isNull() | (token == "-"), F.lit(0)).otherwise(F.coalesce(rx.as_long(token), F.lit(-1)))


def _gigabytes(folded: Column, pattern: str) -> Column:
    return F.coalesce(rx.as_double(rx.first_folded(folded, pattern)), F.lit(0.0))


def _lines_with(pattern: str) -> Column:
    """Number of lines holding a match of one of the words."""
    words = pattern.split("|")
    count = f"size(filter(split(_folded, '\\n', -1), line -> {rx.hits_any('line', words)}))"
    return F.expr(f"CASE WHEN {rx.hits_any('_folded', words)} THEN CAST({count} AS BIGINT) ELSE 0L END")


def _marker(name: str) -> Column:
    if name == "has_stack_trace":
        found = F.col("text").rlike(rx.MULTILINE + MARKER_REGEXES[name])
    else:
        found = F.expr(rx.hits_any("_folded", MARKER_REGEXES[name].split("|")))
    return found.cast("bigint")


def features(runs: DataFrame, catalog: list[Category] = CATEGORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``run_id`` plus the ordered feature columns; columns named in ``keep`` come along."""
    # Only digits are read from these matches, so the folded text serves them all.
    text, folded = F.col("text"), F.col("_folded")
    n_processes, n_completed = process_counts(folded, rx.folded_regex(PROCESS_FEATURE_REGEX), progress_group=2)
    first_pass = (
        runs.withColumn("_folded", rx.fold(text))
        .select(
            "run_id",
            *keep,
            exit_code(folded).alias("exit_code"),
            _gigabytes(folded, MEMORY_REQUESTED_REGEX).alias("memory_requested_gb"),
            _gigabytes(folded, MEMORY_AVAILABLE_REGEX).alias("memory_available_gb"),
            n_processes.alias("n_processes"),
            n_completed.alias("n_completed"),
            (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
            _lines_with(ERROR_LINE_REGEX).alias("n_error_lines"),
            _lines_with(WARNING_LINE_REGEX).alias("n_warning_lines"),
            *[_marker(name).alias(name) for name in MARKER_REGEXES],
            *[F.expr(f"CAST({detection.match_count(c)} AS BIGINT)").alias(f"regex_{c.id}") for c in catalog],
        )
    )
    available, processes = F.col("memory_available_gb"), F.col("n_processes")
    derived = first_pass.withColumns(
        {
            "memory_ratio": F.when(available > 0, F.col("memory_requested_gb") / available).otherwise(F.lit(0.0)),
            "n_failed": processes - F.col("n_completed"),
            "completion_ratio": F.when(processes > 0, F.col("n_completed") / processes).otherwise(F.lit(1.0)),
            "error_density": F.col("n_error_lines") / F.col("n_lines"),
            **{f"exit_is_{code}": (F.col("exit_code") == code).cast("bigint") for code in EXIT_ONE_HOT},
        }
    )
    return derived.select("run_id", *keep, *feature_names(catalog))


def feature_pairs(catalog: list[Category] = CATEGORIES, offset: int = 0) -> Column:
    """Non-zero features of a feature row as (idx, value) structs."""
    pairs = ", ".join(
        f"CASE WHEN {name} <> 0 THEN " + sql.struct(idx=str(offset + i), value=f"CAST({name} AS DOUBLE)") + " END"
        for i, name in enumerate(feature_names(catalog))
    )
    return F.expr(f"array_compact(array({pairs}))")
