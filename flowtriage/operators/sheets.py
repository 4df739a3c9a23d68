"""Sample-sheet validation.

A sheet is one text cell, so its rows, issues and summary are arrays of its
row: validating a corpus of sheets is one scan without a shuffle, and issues
come out in emission order because arrays keep it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.functions import rx
from flowtriage.functions.arrays import computed
from flowtriage.functions.catalog import FASTQ_SUFFIXES, REQUIRED_COLUMNS, STRANDEDNESS

# Rule names in emission order within their stage.
EMPTY, COLUMNS, SAMPLE, FASTQ_1, FASTQ_2, NAMING, STRAND, DUPLICATE = (
    "empty", "missing_columns", "sample_id", "fastq_1", "fastq_2", "pair_naming", "strandedness", "duplicate",
)
_ISSUE_TYPE = "struct<row_num: bigint, rule: string, type: string, message: string>"


def _issue(rule: str, severity: str, message: Column, row_num: Column | None = None) -> Column:
    number = F.lit(None).cast("bigint") if row_num is None else row_num
    return F.struct(
        number.alias("row_num"), F.lit(rule).alias("rule"), F.lit(severity).alias("type"), message.alias("message")
    )


def parse(sheets: DataFrame) -> DataFrame:
    """Header and numbered data rows of every sheet.

    Cells are found by header name, the first one if it repeats.  A missing
    column gives NULL, a short row ''.  Blank lines do not take a number.
    """
    lines = sheets.withColumn("_lines", F.split(rx.strip(F.col("text")), "\n", -1))
    header = F.transform(F.split(F.get("_lines", F.lit(0)), ",", -1), lambda h: F.lower(rx.strip(h)))
    data = F.filter(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(1))), lambda x: rx.strip(x) != "")
    framed = lines.select(
        "sheet_id",
        (F.length("text") > 0).alias("given"),
        (F.size("_lines") < 2).alias("is_empty"),
        header.alias("header"),
        F.transform(data, lambda x: F.split(x, ",", -1)).alias("_cells"),
    ).select(
        "*", *[F.array_position("header", c).cast("int").alias(f"_at_{c}") for c in REQUIRED_COLUMNS]
    )

    def cell(cells: Column, name: str) -> Column:
        at = F.col(f"_at_{name}")
        return F.when(at > 0, F.coalesce(rx.strip(F.get(cells, at - 1)), F.lit("")))

    rows = F.transform(
        "_cells",
        lambda cells, i: F.struct(
            (i + 2).cast("bigint").alias("row_num"), *[cell(cells, c).alias(c) for c in REQUIRED_COLUMNS]
        ),
    )
    return framed.select("sheet_id", "given", "is_empty", "header", rows.alias("rows"))


def sheet_rows(parsed: DataFrame) -> DataFrame:
    """One row per data row; an empty sheet has none."""
    return parsed.select("sheet_id", F.inline(F.when(~F.col("is_empty"), F.col("rows"))))


def _present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _bad_suffix(value: Column) -> Column:
    return ~reduce(lambda a, b: a | b, [value.endswith(s) for s in FASTQ_SUFFIXES])


def _row_issues(row: Column) -> Column:
    """Issues of one data row in rule order; conditions on NULL cells fail."""
    number, sample, fq1, fq2, strand = (row[c] for c in ("row_num", *REQUIRED_COLUMNS))

    def at(text: str) -> Column:
        return F.concat(F.lit("Row "), number.cast("string"), F.lit(f": {text}"))

    def suffix(column: str) -> Column:
        return at(f"{column} doesn't end with .fastq.gz or .fq.gz.")

    bare1 = F.regexp_replace(fq1, "_R1|_1", "")
    bare2 = F.regexp_replace(fq2, "_R2|_2", "")
    strand_message = F.concat(
        at('Invalid strandedness "'), strand, F.lit('". Must be one of: ' + ", ".join(STRANDEDNESS))
    )
    return F.array_compact(
        F.array(
            F.when(sample == "", _issue(SAMPLE, "critical", at("Empty sample ID."), number)),
            F.when(fq1 == "", _issue(FASTQ_1, "critical", at("Missing fastq_1 path."), number)).when(
                _bad_suffix(fq1), _issue(FASTQ_1, "warning", suffix("fastq_1"), number)
            ),
            F.when(
                _present(fq1) & (fq2 == ""),
                _issue(FASTQ_2, "info", at("No fastq_2 -- will be treated as single-end."), number),
            ).when((fq2 != "") & _bad_suffix(fq2), _issue(FASTQ_2, "warning", suffix("fastq_2"), number)),
            F.when(
                _present(fq1) & _present(fq2) & (bare1 != bare2),
                _issue(NAMING, "warning", at("Paired-end filenames don't follow R1/R2 naming convention."), number),
            ),
            F.when(
                _present(strand) & ~F.lower(strand).isin(*STRANDEDNESS), _issue(STRAND, "critical", strand_message, number)
            ),
        )
    )


def with_duplicates(parsed: DataFrame) -> DataFrame:
    """Add ``duplicates``: repeated sample ids with count, in first-seen order.

    Sorting a sheet's samples puts equal ids side by side; each run of equal
    ids is then as long as the distance to the next run.
    """
    named = F.transform(
        F.filter("rows", lambda r: _present(r["sample"])),
        lambda r: F.struct(r["sample"].alias("sample"), r["row_num"].alias("row_num")),
    )
    starts = F.filter(
        F.transform(
            "_sorted",
            lambda s, i: F.struct(
                s["sample"].alias("sample"),
                s["row_num"].alias("row_num"),
                i.alias("at"),
                F.coalesce(F.get("_sorted", i - 1)["sample"] != s["sample"], F.lit(True)).alias("first"),
            ),
        ),
        lambda s: s["first"],
    )
    counted = F.transform(
        "_starts",
        lambda s, i: F.struct(
            s["row_num"].alias("first_row"),
            s["sample"].alias("sample"),
            (F.coalesce(F.get("_starts", i + 1)["at"], F.size("_sorted")) - s["at"]).cast("bigint").alias("count"),
        ),
    )
    return (
        parsed.withColumn("_sorted", F.array_sort(named))
        .withColumn("_starts", starts)
        .withColumn("duplicates", F.array_sort(F.filter(counted, lambda g: g["count"] > 1)))
        .drop("_sorted", "_starts")
    )


def _duplicate_issue(group: Column) -> Column:
    message = F.concat(
        F.lit('Duplicate sample ID "'), group["sample"], F.lit('" appears '), group["count"].cast("string"),
        F.lit(" times. Ensure this is intentional (e.g., multi-lane sequencing)."),
    )
    return _issue(DUPLICATE, "warning", message)


def summary_struct() -> Column:
    """Summary of a parsed sheet, NULL when it is empty."""
    samples = F.filter(F.transform("rows", lambda r: r["sample"]), lambda s: s != "")
    return F.when(
        ~F.col("is_empty"),
        F.struct(
            F.size("rows").cast("bigint").alias("total_samples"),
            F.size(F.array_distinct(samples)).cast("bigint").alias("unique_samples"),
            F.size(F.filter("rows", lambda r: _present(r["fastq_1"]) & (r["fastq_2"] == ""))).cast("bigint").alias("single_end"),
            F.size(F.filter("rows", lambda r: _present(r["fastq_2"]))).cast("bigint").alias("paired_end"),
            F.col("header").alias("columns"),
        ),
    )


def validate(sheets: DataFrame) -> DataFrame:
    """Per sheet: ``issues`` in emission order, ``summary`` and the parsed ``rows``."""
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED_COLUMNS]), F.col("header"))
    header_issues = F.when(
        F.size(missing) > 0,
        F.array(
            _issue(COLUMNS, "critical", F.concat(F.lit("Missing required columns: "), F.array_join(missing, ", ")))
        ),
    ).otherwise(F.array().cast(f"array<{_ISSUE_TYPE}>"))
    empty = F.array(_issue(EMPTY, "critical", F.lit("Sample sheet is empty or has no data rows.")))
    issues = F.when(F.col("is_empty"), empty).otherwise(
        F.concat(
            header_issues,
            F.flatten(F.transform("rows", _row_issues)),
            F.transform("duplicates", _duplicate_issue),
        )
    )
    return with_duplicates(parse(sheets)).select(
        "sheet_id", "given", "is_empty", issues.alias("issues"), summary_struct().alias("summary"), "rows", "duplicates"
    )


def issues(validated: DataFrame) -> DataFrame:
    """One row per issue, ``ord`` from 1, with the status it displays as."""
    shown = (
        F.when(F.col("type") == "critical", "fail").when(F.col("type") == "warning", "warn").otherwise("skip")
    )
    return (
        validated.select("sheet_id", F.posexplode(computed("issues")).alias("pos", "i"))
        .select("sheet_id", (F.col("pos") + 1).cast("bigint").alias("ord"), "i.*")
        .withColumn("display", shown)
    )


def summaries(validated: DataFrame) -> DataFrame:
    """One row per sheet; all NULL for an empty sheet."""
    return validated.select("sheet_id", "summary.*")
