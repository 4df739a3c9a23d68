"""Catalogue data as dimension tables.

Their size is fixed by the catalogue (16 categories, 95 regexes, 14 genomes),
not by the corpus, so joins may broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtriage.functions.catalog import CATEGORIES, GENOMES, Category


def categories(spark: SparkSession, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """One row per category, ``ordinal`` in ranking order."""
    return spark.createDataFrame(
        [
            (i, c.id, c.label, c.family, c.severity, c.icon, c.cause, c.fix, c.command, list(c.regexes))
            for i, c in enumerate(catalog)
        ],
        "ordinal int, id string, label string, family string, severity string, icon string,"
        " cause string, fix string, command string, regexes array<string>",
    )


MOST_REGEXES = 100_000


def catalog_of(categories: DataFrame) -> list[Category]:
    """The catalogue that a table like that of :func:`categories` holds, for the operators that take one.

    So failure categories can be added as data.  Rows are ordered by ordinal,
    then id; missing texts are empty.  A catalogue is small by nature; one of
    more than ``MOST_REGEXES`` regexes is refused.
    """
    n = categories.agg(F.sum(F.size("regexes"))).first()[0] or 0
    if n > MOST_REGEXES:
        raise ValueError(f"a catalogue of {n} regexes")
    names = ("label", "family", "severity", "icon", "cause", "fix", "command")
    rows = categories.orderBy("ordinal", "id").collect()
    return [Category(r["id"], *[r[c] or "" for c in names], tuple(r["regexes"] or ())) for r in rows]


def regexes(spark: SparkSession, catalog: list[Category] = CATEGORIES) -> DataFrame:
    """One row per regex."""
    return categories(spark, catalog).select(
        "ordinal", "id", "family", "severity", F.posexplode("regexes").alias("regex_pos", "regex")
    )


def genomes(spark: SparkSession) -> DataFrame:
    """One row per known genome, ``ordinal`` in matching order."""
    return spark.createDataFrame(
        [(i, name, float(star), float(bwa), float(hisat2), float(size)) for i, (name, star, bwa, hisat2, size) in enumerate(GENOMES)],
        "ordinal int, name string, star_gb double, bwa_gb double, hisat2_gb double, size_gb double",
    )
