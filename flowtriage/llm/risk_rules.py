"""Quality rules whose cutoffs are certified on labelled holdouts.

DataFrame functions only.  The cutoffs of all rules tighten together in
levels that are fixed beforehand.  Per stratum the exact binomial tail tells
whether a level rejects too many good documents; levels are tested from
lenient to strict and testing stops at the first that is not certified, so no
correction is needed within a stratum, and the error is divided by the number
of strata (Bonferroni).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtriage.llm.common import cut
from flowtriage.llm.running import key

SPACE = r"[\x20\x09-\x0D]+"
RUN = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
RISK = 0.05
ERROR = 0.05
# A document breaks a rule at a level if its value is above that level's cutoff.
RULES = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.06),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5),
    "exclaims_per_word": (1.5, 1.0, 0.8, 0.6, 0.4, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "word_length": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0),
}
LEVELS = 6


def _chars(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("bigint")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def counts(docs: DataFrame) -> DataFrame:
    """The base counts and rule values of every whole text; nulls count as empty.

    Keeps doc_id and lang.  Steps that look up an array from within a lambda
    read it from a column of its own, which the optimizer does not copy into
    the lambda as long as it is used more than once.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", "lang", text.alias("text"), words.alias("words"), lines.alias("lines"))
    counted = split.select(
        "doc_id",
        "lang",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _chars(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        _chars(r"\p{Lu}").alias("n_upper"),
        _chars(r"\p{L}").alias("n_letters"),
        _chars(r"!").alias("n_exclaims"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    run = F.transform(F.sequence(F.lit(1), F.size("hashes") - (RUN - 1)), lambda i: F.xxhash64(F.slice("hashes", i, RUN)))
    hashed = counted.withColumn("runs", F.when(F.size("hashes") >= RUN, run)).drop("hashes")
    ordered = F.sort_array(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("runs")) < F.size("runs")
    sorted_runs = hashed.withColumn("ordered", F.when(some, ordered)).drop("runs")

    def twice(e: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get("ordered", k)["h"] == e["h"], F.lit(False))
        return same(j - 1) | same(j + 1)

    starts = F.sort_array(F.transform(F.filter("ordered", twice), lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + s + RUN - F.greatest(a["end"], s)).alias("n"), (s + RUN).alias("end")),
        lambda a: a["n"],
    )
    return sorted_runs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("ordered").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        _ratio(F.col("n_upper"), F.col("n_letters")).alias("upper_share"),
        _ratio(F.col("n_exclaims"), F.col("n_words")).alias("exclaims_per_word"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("word_length"),
    )


def level(rules: dict[str, tuple[float, ...]] = RULES) -> Column:
    """The first level at which a document breaks a rule, ``LEVELS`` if it never does."""
    first = [reduce(lambda a, b: a + b, [F.when(F.col(name) <= c, 1).otherwise(0) for c in cutoffs]) for name, cutoffs in rules.items()]
    return F.least(*first)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) at success rate ``p``, summed term by term in logarithms.

    1 where ``k`` is not below the mean: no risk of ``p`` can be excluded there.
    """
    odds = math.log(p / (1 - p))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.lit(0.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        more = a["term"] + F.log((n - i).cast("double") / (i + 1)) + F.lit(odds)
        return F.struct(more.alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), start, add, lambda a: a["sum"])
    return F.when(k < n * p, total).otherwise(1.0)


def certified(good: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, chosen): the strictest level that is certified in each stratum, -1 for none.

    ``good`` holds (stratum, level) of labelled good documents.  With
    probability 1 - ``error`` no stratum's chosen level rejects more than the
    share ``risk`` of its good documents.  One row a stratum is computed.
    """
    tally = good.groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.sum(F.when(F.col("level") <= t, 1).otherwise(0)).alias(f"k{t}") for t in range(LEVELS)]
    )
    strata = F.count("*").over(Window.partitionBy(F.lit(0)))
    tested = tally.withColumn("limit", F.lit(error) / strata)
    chosen = F.lit(LEVELS - 1)
    for t in reversed(range(LEVELS)):
        chosen = F.when(binomial_tail(F.col(f"k{t}"), F.col("n"), risk) > F.col("limit"), t - 1).otherwise(chosen)
    return tested.select("stratum", chosen.alias("chosen"))


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text, lang) by base rules and certified rules.

    The base rules fail texts under 20 words or with over 30 % of their words
    in repeated runs of 8.  Of the rest, labelled good documents (quality 1 in
    all their labels) certify the rule level of their language; a document is
    rejected if it breaks a rule at that level.  A stratum without enough
    labels rejects nothing.

    Returns doc_id, the base counts, base_failed, kept, and the broken level.
    Null and empty texts have no words and fail; a null language is a stratum
    of its own; a null doc_id has no label; repeated rows are judged each.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = counts(docs).select(
        "doc_id", key("lang").alias("stratum"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), level().alias("level"),
    )
    judged = cut(judged)
    trusted = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    )
    good = judged.where("NOT base_failed").join(trusted.select("doc_id"), "doc_id").select("stratum", "level")
    chosen = certified(good, risk, error)
    kept = ~F.col("base_failed") & (F.col("level") > F.coalesce("chosen", F.lit(-1)))
    return judged.join(chosen, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        F.col("level").alias("broken_level"),
    )
