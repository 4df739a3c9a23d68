"""Hybrid failure classifier: TF-IDF and structured features into tree ensembles."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowtriage.functions import sql
from flowtriage.functions.catalog import CATEGORIES, Category, feature_names
from flowtriage.functions.ranking import hash_position
from flowtriage.operators import text
from flowtriage.operators.boosting import BoostedTrees, boost
from flowtriage.operators.evaluation import balanced_sample, fold_scores
from flowtriage.operators.features import feature_pairs, features
from flowtriage.session import checkpoint_dir, stored

TOP_CLASSES = 5
TOP_FEATURES = 10
FOLDS = 5
SEED = 42
EXPLANATION_METHOD = "feature_importance"

# Training takes up to so many runs of each label, the size of the documented training set.
SAMPLE_PER_LABEL = 200
FOREST, BOOSTED = "forest", "boosted"
# A model folder holds versions, and a note for each that is complete.
_NOTE = "version string, published bigint, learner string"


def hybrid_features(
    runs: DataFrame, weights: DataFrame, n_terms: int, catalog: list[Category] = CATEGORIES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``pairs`` (idx, value) per run: TF-IDF weights, then structured features, by idx.

    Both are computed within the row of the run, so nothing is shuffled.
    """
    weighted = text.weighted(runs, weights, "run_id", keep=("text", *keep))
    terms = F.transform("pairs", lambda p: F.struct(p["idx"].alias("idx"), p["value"].alias("value")))
    rows = features(weighted.withColumn("pairs", terms), catalog, keep=("pairs", *keep))
    return rows.select("run_id", *keep, F.concat("pairs", feature_pairs(catalog, n_terms)).alias("pairs"))


def label_index(runs: DataFrame) -> DataFrame:
    """Alphabetical integer code of each run's label."""
    indexer = StringIndexer(inputCol="label", outputCol="_index", stringOrderType="alphabetAsc").fit(runs)
    return indexer.transform(runs).select("run_id", "label", F.col("_index").cast("bigint").alias("label_idx"))


def top_contributions(pairs: Column, importances: list[float], names: list[str], n: int = TOP_FEATURES) -> Column:
    """Largest importance x |value| products above zero, ties by feature order."""
    importance = F.expr("array(" + ", ".join(f"{float(i)!r}D" for i in importances) + ")")
    feature = F.expr("array(" + ", ".join(sql.string(name) for name in names) + ")")
    scored = F.transform(
        pairs,
        lambda p: F.struct(
            (-F.get(importance, p["idx"]) * F.abs(p["value"])).alias("order"),
            p["idx"].alias("idx"),
            p["value"].alias("value"),
        ),
    )
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["order"] < 0)), 1, n)
    return F.transform(
        best,
        lambda s: F.struct(
            F.get(feature, s["idx"]).alias("feature"), (-s["order"]).alias("importance"), s["value"].alias("value")
        ),
    )


def as_vectors(matrix: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """``matrix`` with its ``pairs`` as sparse vectors of ``size`` entries in ``features``.

    The rows are written to the shared folder once, as what a vector is stored
    as, and read back as vectors: no Python, and training and prediction do not
    repeat the extraction.
    """
    columns = [c for c in matrix.columns if c != "pairs"]
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform("pairs", lambda p: p["idx"]).alias("indices"),
        F.transform("pairs", lambda p: p["value"]).alias("values"),
    )
    fields = [matrix.schema[c] for c in columns]
    return stored(matrix.select(*columns, vector.alias("features")), StructType([*fields, StructField("features", VectorUDT())]), by)


def vector_pairs(features_col: str = "features") -> Column:
    """The (idx, value) pairs of a sparse vector column."""
    vector = F.unwrap_udt(features_col)
    return F.zip_with(vector["indices"], vector["values"], lambda i, v: F.struct(i.alias("idx"), v.alias("value")))


@dataclass
class TriageClassifier:
    """Tree ensembles over hybrid features.

    ``learner`` is "boosted", the documented gradient boosting with the
    multinomial loss in ``max_iter`` steps, each of which grows a tree for
    every label, or "forest", Spark ML's ensemble of as many trees.
    The defaults but for the learner are the documented training settings.  ``fit`` takes up to
    ``per_label`` runs of each label from the corpus (a bounded, seeded
    sample), or all labelled runs if that is None; vocabulary, document
    frequencies and labels are those of all runs.  ``predict`` and ``explain``
    take corpora of any size.
    """

    max_features: int = text.DEFAULT_VOCABULARY
    max_iter: int = 200
    max_depth: int = 5
    step_size: float = 0.1
    subsampling_rate: float = 0.8
    seed: int = SEED
    per_label: int | None = SAMPLE_PER_LABEL
    learner: str = FOREST
    trees: RandomForestClassificationModel | BoostedTrees | None = None
    weights: DataFrame | None = None
    labels: list[str] | None = None
    terms: list[str] | None = None

    def learn(self, runs: DataFrame) -> StringIndexerModel:
        """Fit vocabulary, document frequencies and labels on all ``runs``."""
        checkpoint_dir(runs.sparkSession)
        self.weights = text.fit_weights(runs.select("run_id", "text"), self.max_features, "run_id").orderBy("idx").checkpoint()
        self.terms = [r.term for r in self.weights.collect()]  # at most max_features rows
        indexer = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc").fit(runs.select("label"))
        self.labels = list(indexer.labels)
        return indexer

    def prepare(self, runs: DataFrame) -> DataFrame:
        """Learn from all ``runs``; draw the sample that the trees grow on and return its matrix.

        The sample is at most ``per_label`` rows a label, so its ids may be
        broadcast; without that limit all runs that have a label are taken.
        The matrix is written to the shared folder.
        """
        indexer = self.learn(runs)
        if self.per_label is None:
            labelled = runs.select("run_id", "text", "label").where(F.col("label").isNotNull())
            return self.matrix(indexer.transform(labelled), keep=("label", "label_idx"))
        drawn = balanced_sample(runs, self.per_label, seed=self.seed).select("run_id").checkpoint()
        sample = runs.select("run_id", "text", "label").join(F.broadcast(drawn), "run_id", "left_semi")
        return self.matrix(indexer.transform(sample), keep=("label", "label_idx"))

    def matrix(self, runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """run_id, the columns named in ``keep`` and the vector ``features`` of each run."""
        self._require(self.weights)
        return as_vectors(hybrid_features(runs, self.weights, len(self.terms), keep=keep), self.width())

    def width(self) -> int:
        return len(self.terms) + len(feature_names())

    def fit(self, runs: DataFrame) -> TriageClassifier:
        self.trees = self._grown(self.prepare(runs))
        return self

    def _grown(self, matrix: DataFrame) -> RandomForestClassificationModel | BoostedTrees:
        """Trees grown on ``matrix`` (label_idx, features); what is drawn from it depends on its order."""
        if self.learner == BOOSTED:
            return boost(matrix, len(self.labels), self.width(), self.max_iter, self.max_depth, self.step_size, self.subsampling_rate, self.seed)
        if self.learner != FOREST:
            raise ValueError(f"no such learner: {self.learner}")
        rows = matrix.repartition("run_id").sortWithinPartitions("run_id").select("label_idx", "features")
        shared = {"maxDepth": self.max_depth, "subsamplingRate": self.subsampling_rate, "seed": self.seed, "labelCol": "label_idx"}
        return RandomForestClassifier(numTrees=self.max_iter, featureSubsetStrategy="sqrt", **shared).fit(rows)

    def classify(self, matrix: DataFrame) -> DataFrame:
        """Add label, confidence and ``ranked`` (label, probability) structs, best first; ties in label order."""
        self._require(self.trees)
        names = F.array(*[F.lit(x) for x in self.labels])
        if isinstance(self.trees, BoostedTrees):
            vector = F.unwrap_udt("features")
            made, scores = matrix, self.trees.probabilities(vector["indices"], vector["values"])
        else:
            made, scores = self.trees.transform(matrix), vector_to_array("probability")
        scored = made.withColumn("_scores", scores).withColumn("_total", F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x))
        ranked = F.array_sort(
            F.zip_with(
                F.transform("_scores", lambda s, i: F.struct((-s).alias("order"), i.alias("at"))),
                F.array_repeat("_total", F.size("_scores")),
                lambda s, total: F.struct((s["order"] / total).alias("order"), s["at"].alias("at")),
            )
        )
        best = F.transform(ranked, lambda r: F.struct(F.get(names, r["at"]).alias("label"), (-r["order"]).alias("probability")))
        return scored.select(*matrix.columns, best.alias("ranked")).withColumns(
            {"predicted": F.get("ranked", F.lit(0))["label"], "confidence": F.get("ranked", F.lit(0))["probability"]}
        )

    def predict(self, runs: DataFrame) -> DataFrame:
        """Label, confidence, the five most probable classes and the top features of each run.

        ``predicted`` and ``ranked`` (all classes, best first) are what the
        diagnosis and alternatives of the evaluation operators take.
        """
        self._require(self.trees)
        top = F.slice("ranked", 1, TOP_CLASSES)
        pairs = self.classify(self.matrix(runs)).withColumn("pairs", vector_pairs())
        return pairs.select(
            "run_id",
            F.col("predicted").alias("label"),
            "confidence",
            F.map_from_entries(top).alias("probabilities"),
            top_contributions(F.col("pairs"), self.importances(), self.feature_names()).alias("top_features"),
            "predicted",
            "ranked",
        )

    def explain(self, runs: DataFrame) -> DataFrame:
        """Predictions with their contribution list and the method that made it."""
        return self.predict(runs).select(
            "*", F.col("top_features").alias("explanation"), F.lit(EXPLANATION_METHOD).alias("explanation_method")
        )

    def feature_names(self) -> list[str]:
        return [*self.terms, *feature_names()]

    def importances(self) -> list[float]:
        """Importance of each feature."""
        self._require(self.trees)
        if isinstance(self.trees, BoostedTrees):
            return self.trees.importances()
        return self.trees.featureImportances.toArray().tolist()

    def save(self, path: str) -> str:
        """Publish the model as a new version under ``path``; returns its name.

        All parts go to a folder of their own.  The note that makes the version
        known is written last, so a half-written version is never loaded, and
        applications that save at once do not touch each other's files.
        """
        self._require(self.trees)
        spark = self.weights.sparkSession
        version = uuid.uuid4().hex
        folder = f"{path}/versions/{version}"
        if isinstance(self.trees, BoostedTrees):
            self.trees.save(spark, f"{folder}/trees")
        else:
            self.trees.write().save(f"{folder}/trees")
        self.weights.write.parquet(f"{folder}/weights")
        spark.createDataFrame(list(enumerate(self.labels)), "idx int, label string").write.parquet(f"{folder}/labels")
        note = spark.createDataFrame([(version, time.time_ns(), self.learner)], _NOTE)
        note.coalesce(1).write.parquet(f"{path}/published/{version}")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> TriageClassifier:
        """The named version, or the one published last."""
        notes = spark.read.schema(_NOTE).option("recursiveFileLookup", "true").parquet(f"{path}/published")
        known = notes if version is None else notes.where(F.col("version") == version)
        last = known.orderBy(F.desc("published"), "version").first()
        if last is None:
            raise FileNotFoundError(f"no published model under {path}")
        folder = f"{path}/versions/{last.version}"
        weights = spark.read.parquet(f"{folder}/weights").orderBy("idx")
        trees = f"{folder}/trees"
        return cls(
            learner=last.learner,
            trees=RandomForestClassificationModel.load(trees) if last.learner == FOREST else BoostedTrees.load(spark, trees),
            weights=weights,
            labels=[r.label for r in spark.read.parquet(f"{folder}/labels").orderBy("idx").collect()],
            terms=[r.term for r in weights.collect()],
        )

    @staticmethod
    def _require(part) -> None:
        if part is None:
            raise RuntimeError("Model not trained yet. Call fit() first.")


def _group(name: str) -> Column:
    """A group as text; rows without one are a group."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("_group")


def _placed(runs: DataFrame, seed: int, group: str) -> DataFrame:
    """Position of each group among those of its label, in a fixed random order."""
    groups = runs.select(_group(group), "label").groupBy("_group").agg(F.min("label").alias("label"))
    return hash_position(groups, "_group", by=["label"], seed=seed).select("_group", "position")


def folds(runs: DataFrame, n: int = FOLDS, seed: int = SEED, group: str = "run_id") -> DataFrame:
    """Stratified fold of each run: labels are dealt out in a fixed random order.

    With a ``group``, such as the original of oversampled copies, all rows of
    one go to the same fold; it counts for the least of its labels.  Rows
    without a group share one fold.
    """
    if group == "run_id":
        placed = hash_position(runs.select("run_id", "label"), "run_id", by=["label"], seed=seed)
        return placed.select("run_id", "label", (F.col("position") % n).alias("fold"))
    dealt = _placed(runs, seed, group).select("_group", (F.col("position") % n).alias("fold"))
    columns = [c for c in dict.fromkeys(("run_id", group, "label")) if c in runs.columns]
    return runs.select(*columns, _group(group)).join(dealt, "_group").select(*columns, "fold")


def cross_validate(
    classifier: TriageClassifier, runs: DataFrame, n: int = FOLDS, group: str = "run_id", copies: str | None = None, parallelism: int = 2
) -> DataFrame:
    """Macro F1 per fold, with mean and population deviation over the folds.

    Vocabulary and labels are fitted once on all runs, which are all dealt to
    folds; rows of one ``group`` share a fold.  The trees of a fold grow on the
    first ``per_label`` groups of each label of the other folds (all if that is
    None), and predict every run of the fold.  ``copies`` names a column that says how often a row
    is taken for training: it is oversampled there only, after the folds are
    dealt.  Returns fold, n_runs, n_right, f1_macro, mean_f1 and std_f1.
    """
    indexer = classifier.learn(runs)
    placed = _placed(runs, classifier.seed, group)
    # A group at a position has so many groups of its label before it that are not of fold k.
    position, every = F.col("position"), F.array(*[F.lit(k) for k in range(n)])
    before = lambda k: position - F.floor((position + F.lit(n - 1) - k) / n)
    taken = lambda k: F.lit(True) if classifier.per_label is None else before(k) < classifier.per_label
    training = F.filter(every, lambda k: (k != position % n) & taken(k))
    dealt = placed.select("_group", (position % n).cast("int").alias("fold"), training.alias("trains"))
    keep = [c for c in ("label", copies) if c]
    columns = [F.col(c) for c in dict.fromkeys(("run_id", *keep))]
    rows = hybrid_features(
        indexer.transform(runs.withColumn("_group", _group(group))), classifier.weights, len(classifier.terms), keep=("_group", *keep, "label_idx")
    )
    joined = rows.join(dealt, "_group").select(*columns, "label_idx", "fold", "trains", "pairs")
    matrix = as_vectors(joined, classifier.width(), by="fold")

    def grown(k: int):
        own = matrix.where(F.array_contains("trains", k))
        if copies:
            own = own.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col(copies), F.lit(1)))))
        return classifier._grown(own)

    with ThreadPool(parallelism) as pool:
        ensembles = pool.map(grown, range(n))
    parts = []
    for k, trees in enumerate(ensembles):
        classifier.trees = trees
        parts.append(classifier.classify(matrix.where(F.col("fold") == k)).select("fold", "label", "predicted"))
    predicted = parts[0]
    for part in parts[1:]:
        predicted = predicted.unionAll(part)
    scores = fold_scores(predicted).collect()  # one row a fold
    values = [r.f1_macro for r in scores]
    table = runs.sparkSession.createDataFrame([tuple(r) for r in scores], "fold bigint, n_runs bigint, n_right bigint, f1_macro double")
    return table.withColumns({"mean_f1": F.lit(fmean(values)), "std_f1": F.lit(pstdev(values))})
