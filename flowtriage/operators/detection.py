"""Failure detection over run logs.

A run is one row, and everything derived from a single run stays in that row:
the regexes, the confidences and the ranking are column expressions, so a
corpus of any size is triaged in one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.functions import rx, sql
from flowtriage.functions.catalog import CATEGORIES, DEFAULT_SEVERITY, Category

LINE_BREAK = "\n"

# SQL of the confidence for n matching regexes: 0.7, 0.9, then 0.99.
CONFIDENCE = "least(0.5D + {n} * 0.2D, 0.99D)"


def lines(runs: DataFrame) -> DataFrame:
    """Numbered, stripped lines of every run."""
    return runs.select("run_id", F.posexplode(F.split("text", LINE_BREAK, -1)).alias("pos", "line")).select(
        "run_id", (F.col("pos") + 1).cast("bigint").alias("line_num"), rx.strip(F.col("line")).alias("text")
    )


def match_count(category: Category, folded: str = "_folded") -> str:
    """SQL: how many distinct regexes of a category occur in the folded text."""
    return " + ".join(f"CAST({rx.hits(folded, p)} AS INT)" for p in category.regexes)


def with_counts(runs: DataFrame, catalog: list[Category] = CATEGORIES, keep_folded: bool = False) -> DataFrame:
    """Add ``counts``: one struct field per category with its match count."""
    counts = sql.struct(**{c.id: match_count(c) for c in catalog})
    counted = runs.withColumn("_folded", rx.fold(F.col("text"))).withColumn("counts", F.expr(counts))
    return counted if keep_folded else counted.drop("_folded")


def _detected_array(catalog: list[Category]) -> Column:
    """Detected categories of a row with ``counts``, best first.

    Sorting (-confidence, ordinal) structs is the stable descending sort by
    confidence; a catalogue's worth of entries at most, so it belongs in the row.
    """
    found = ", ".join(
        f"CASE WHEN counts.{c.id} > 0 THEN "
        + sql.struct(
            order=f"-{CONFIDENCE.format(n=f'counts.{c.id}')}", ordinal=str(i), match_count=f"CAST(counts.{c.id} AS BIGINT)"
        )
        + " END"
        for i, c in enumerate(catalog)
    )
    texts = ", ".join(
        sql.struct(
            id=sql.string(c.id), label=sql.string(c.label), severity=sql.string(c.severity or DEFAULT_SEVERITY),
            icon=sql.string(c.icon),
        )
        for c in catalog
    )
    entry = sql.struct(
        **{field: f"get(array({texts}), x.ordinal).{field}" for field in ("id", "label", "severity", "icon")},
        match_count="x.match_count",
        confidence="-x.order",
    )
    return F.expr(f"transform(array_sort(array_compact(array({found}))), x -> {entry})")


def with_detections(runs: DataFrame, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """Add ``detected``: ranked structs of id, label, severity, icon, match_count, confidence."""
    return with_counts(runs, catalog).withColumn("detected", _detected_array(catalog)).drop("counts")


def detections(runs: DataFrame, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """One row per run and detected category with its rank, starting at 1."""
    return (
        with_counts(runs, catalog)
        .select("run_id", F.posexplode(_detected_array(catalog)).alias("pos", "d"))
        .select("run_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "d.*")
    )


def gated_regexes(regexes: DataFrame) -> DataFrame:
    """Rows of ``regexes`` (id, regex) as they are searched for: id, gate and pattern for folded texts.

    The gate is the longest string that each match must hold, empty where there is none.
    """
    rows = regexes.select("id", "regex").distinct().collect()  # a catalogue, see dimensions.MOST_REGEXES
    gates = [(r["id"], rx.gate(r["regex"]), rx.folded_regex(r["regex"])) for r in rows]
    return regexes.sparkSession.createDataFrame(gates, "id string, gate string, pattern string")


def counts_by_table(runs: DataFrame, regexes: DataFrame) -> DataFrame:
    """(run_id, id, match_count) as of :func:`with_counts`, for a catalogue that is only known as a table.

    ``regexes`` holds id and regex, one row each.  Texts are held against the
    gates of all regexes first; only where a gate is found is its regex tried.
    Texts stay where they are and only matches are counted by run.
    """
    folded = runs.select("run_id", rx.fold(F.col("text")).alias("_folded"))
    gates = F.broadcast(gated_regexes(regexes))
    found = folded.join(gates, F.contains("_folded", "gate")).where(F.expr("_folded RLIKE pattern"))
    return found.groupBy("run_id", "id").agg(F.count("*").alias("match_count"))


def enriched(detected: DataFrame, categories: DataFrame) -> DataFrame:
    """Attach the catalogue's long texts; unknown ids keep NULLs."""
    texts = categories.select("id", "cause", "fix", "command")
    return detected.join(F.broadcast(texts), "id", "left")


def matched_lines(runs: DataFrame, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """Per run and detected category, the lines on which it hits.

    ``matched`` may be empty when a hit spans a line break.  A line on which
    any regex of the category hits is one on which a matched regex hits, so
    all regexes of a category may be tested, and only detected categories
    look at the lines.
    """
    with_lines = _with_lines(with_counts(runs, catalog, keep_folded=True))
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("counts")[c.id] > 0,
                    F.struct(F.lit(c.id).alias("id"), _lines_hit(c).alias("matched")),
                )
                for c in catalog
            ]
        )
    )
    return with_lines.select("run_id", F.inline(found))


def _with_lines(folded: DataFrame) -> DataFrame:
    """Add numbered lines, as they are and folded; folding keeps line breaks."""
    both = F.arrays_zip(
        F.split("text", LINE_BREAK, -1).alias("line"), F.split("_folded", LINE_BREAK, -1).alias("folded")
    )
    numbered = F.transform(
        both,
        lambda x, i: F.struct((i + 1).cast("bigint").alias("line_num"), x["line"].alias("line"), x["folded"].alias("folded")),
    )
    return folded.withColumn("_lines", numbered)


def _lines_hit(category: Category) -> Column:
    hit = F.expr(f"filter(_lines, x -> {rx.hits_any('x.folded', category.regexes)})")
    return F.transform(hit, lambda x: F.struct(x["line_num"].alias("line_num"), rx.strip(x["line"]).alias("text")))


def category_lines(runs: DataFrame, category_id: str, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """Lines hit by any regex of one category; an unknown id gives no rows."""
    chosen = [c for c in catalog if c.id == category_id]
    if not chosen:
        return lines(runs).where(F.lit(False))
    split = _with_lines(runs.withColumn("_folded", rx.fold(F.col("text"))))
    in_text = F.expr(rx.hits_any("_folded", chosen[0].regexes))
    return split.select("run_id", F.inline(F.when(in_text, _lines_hit(chosen[0]))))
