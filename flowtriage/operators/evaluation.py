"""Corpus assembly for training, and reports on predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtriage.functions.arrays import computed
from flowtriage.functions.catalog import CLEAN, DIAGNOSIS_DEFAULT_ICON, DIAGNOSIS_DEFAULT_SEVERITY
from flowtriage.functions.ranking import hash_position

REAL_COPIES = 4
ALTERNATIVE_THRESHOLD = 0.05
SHORTLIST = 8
SHORTLIST_THRESHOLD = 0.001


def predicted_label(verdicts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rule-based prediction: the primary failure, or clean; columns named in ``keep`` come along."""
    return verdicts.select(
        "run_id",
        *keep,
        F.coalesce(F.col("primary.id"), F.lit(CLEAN)).alias("predicted"),
        F.col("primary.confidence").alias("confidence"),
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and averages.

    ``pairs`` holds label and predicted.  Everything after the first
    aggregation works on one row per pair of classes.
    """
    cells = pairs.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    totals = cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )

    def ratio(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    rates = totals.withColumns({"precision": ratio("hits", "guessed"), "recall": ratio("hits", "support")})
    both = F.col("precision") + F.col("recall")
    scored = rates.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    metrics = ("precision", "recall", "f1")
    all_rows = F.sum("support")
    averages = scored.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[F.lit(None).cast("double").alias(m) for m in metrics[:2]],
                     (F.sum("hits") / all_rows).alias("f1"), all_rows.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in metrics], all_rows.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     *[(F.sum(F.col(m) * F.col("support")) / all_rows).alias(m) for m in metrics], all_rows.alias("support")),
        ).alias("rows")
    ).select(F.inline("rows"))
    return scored.select("class", *metrics, "support").unionByName(averages)


def fold_scores(predictions: DataFrame) -> DataFrame:
    """Per fold: n_runs, n_right and the macro F1 over the classes that it or its predictions hold."""
    cells = predictions.groupBy("fold", "label", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("label") == F.col("predicted")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), none.alias("guessed"), F.when(hit, F.col("n")).otherwise(none).alias("hits")),
        F.struct(F.col("predicted").alias("class"), none.alias("support"), F.col("n").alias("guessed"), none.alias("hits")),
    )
    totals = cells.select("fold", F.inline(sides)).groupBy("fold", "class").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits")
    )
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("guessed"))
    scored = totals.groupBy("fold").agg(F.sum("support").alias("n_runs"), F.sum("hits").alias("n_right"), F.avg(f1).alias("f1_macro"))
    return scored.select(F.col("fold").cast("bigint").alias("fold"), "n_runs", "n_right", "f1_macro").orderBy("fold")


def diagnosis(predictions: DataFrame, categories: DataFrame) -> DataFrame:
    """Verdict and catalogue texts for each predicted label.

    Clean passes.  A label the catalogue does not know keeps its title-cased
    id, the default icon and the default severity.
    """
    known = F.broadcast(categories.select(F.col("id").alias("predicted"), "label", "severity", "icon", "cause", "fix", "command"))
    clean = F.col("predicted") == CLEAN
    severity = F.coalesce("severity", F.lit(DIAGNOSIS_DEFAULT_SEVERITY))
    return predictions.join(known, "predicted", "left").select(
        "run_id",
        "predicted",
        F.when(clean, "pass").when(severity.isin("critical", "high"), "fail").otherwise("warn").alias("verdict"),
        F.when(~clean, F.coalesce("label", F.initcap(F.replace("predicted", F.lit("_"), F.lit(" "))))).alias("label"),
        F.when(~clean, severity).alias("severity"),
        F.when(~clean, F.coalesce("icon", F.lit(DIAGNOSIS_DEFAULT_ICON))).alias("icon"),
        "cause",
        "fix",
        "command",
    )


def alternatives(probabilities: DataFrame) -> DataFrame:
    """Other failure classes above the threshold.

    ``probabilities`` holds run_id, predicted and ``ranked`` (label, probability) structs.
    """
    return probabilities.select("run_id", "predicted", F.explode(computed("ranked")).alias("r")).where(
        (F.col("r.label") != F.col("predicted"))
        & (F.col("r.label") != CLEAN)
        & (F.col("r.probability") > ALTERNATIVE_THRESHOLD)
    ).select("run_id", "predicted", F.col("r.label").alias("alternative"), F.col("r.probability").alias("probability"))


def confidence_shares(verdicts: DataFrame) -> DataFrame:
    """Rule-based stand-in for class probabilities: confidences scaled to sum to one."""
    total = F.aggregate("detected", F.lit(0.0), lambda a, d: a + d["confidence"])
    return verdicts.withColumn("_total", total).select(
        "run_id",
        F.coalesce(F.col("primary.id"), F.lit(CLEAN)).alias("predicted"),
        F.transform(
            "detected",
            lambda d: F.struct(d["id"].alias("label"), (d["confidence"] / F.col("_total")).alias("probability")),
        ).alias("ranked"),
    )


def explanation_shortlist(contributions: DataFrame) -> DataFrame:
    """The first contributions worth showing, with readable names."""
    return (
        contributions.select("run_id", F.posexplode(F.slice("top_features", 1, SHORTLIST)).alias("pos", "f"))
        .where(F.col("f.importance") > SHORTLIST_THRESHOLD)
        .select(
            "run_id",
            (F.col("pos") + 1).cast("bigint").alias("rank"),
            F.replace(F.col("f.feature"), F.lit("regex_"), F.lit("Pattern: ")).alias("feature"),
            F.col("f.importance").alias("importance"),
        )
    )


def label_distribution(runs: DataFrame) -> DataFrame:
    return runs.groupBy("label").agg(F.count("*").alias("count")).orderBy("label")


def with_real_runs(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """Both corpora, the real one four times, ``source`` telling them apart."""
    copies = real.withColumn("source", F.lit("real")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REAL_COPIES))))
    return synthetic.withColumns({"source": F.lit("synthetic"), "copy": F.lit(1)}).unionByName(copies)


def balanced_sample(runs: DataFrame, n_per_label: int, include_clean: bool = True, seed: int = 42) -> DataFrame:
    """Up to n runs of every label in a fixed random order.

    ``position`` is the place in the shuffled result.
    """
    chosen = runs if include_clean else runs.where(F.col("label") != CLEAN)
    ranked = hash_position(
        chosen.select("run_id", "label"), "run_id", by=["label"], seed=seed, name="label_position", limit=n_per_label
    )
    return hash_position(ranked, "run_id", seed=seed)


def smoke_table(predictions: DataFrame) -> DataFrame:
    """Expected label (``label``) beside the predicted one."""
    return predictions.select(
        "run_id", F.col("label").alias("expected"), F.col("predicted").alias("got"),
        (F.col("label") == F.col("predicted")).alias("matches"), "confidence",
    )
