"""One named query per operator, over the corpora of a table folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtriage.functions.arrays import computed
from flowtriage.functions.catalog import EXIT_ONE_HOT, MARKER_REGEXES, feature_names
from flowtriage.operators import (
    classification,
    detection,
    evaluation,
    features,
    model,
    preflight,
    processes,
    sheets,
    text,
)
from flowtriage.operators.model import TriageClassifier
from flowtriage.session import checkpoint_dir
from flowtriage.sources import dimensions, files
from flowtriage.sources.corpus import corpus, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DRILL_DOWN_CATEGORY = "failed_process"
SAMPLE_PER_LABEL = 200
# Documents of one task: whole texts are longer than the logs of runs.
TASK_DOCUMENTS = 5_000

# Importances for the contribution reports: one per structured feature, some
# zero and some at the display threshold.
FIXED_IMPORTANCES = [((i * 7) % 11) / 1000.0 for i in range(len(feature_names()))]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _runs(spark, sf):
    return corpus(spark, sf, "runs")


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", TASK_DOCUMENTS)


# --- sources and sinks ----------------------------------------------------


def _run_files(spark, sf):
    name = F.concat(F.lit("run_"), F.col("run_id").cast("string"), F.lit(".log"))
    return _runs(spark, sf).select(name.alias("filename"), "text")


@query
def labelled_scan(spark, sf):
    logs = files.labelled_logs(corpus(spark, sf, "label_index"), _run_files(spark, sf))
    return logs.select("filename", "label", "pipeline", "source", F.length("text").cast("bigint").alias("n_chars"))


@query
def log_ingest(spark, sf):
    """Logs as uploaded bytes: three suffixes, and a bad byte at the end of some."""
    number = F.col("run_id")
    suffix = F.when(number % 5 == 0, ".csv").when(number % 5 == 1, ".txt").otherwise(".log")
    bad = F.when(number % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    uploads = _runs(spark, sf).select(
        F.concat(F.lit("/uploads/run_"), number.cast("string"), suffix).alias("path"),
        F.concat(F.col("text").cast("binary"), bad).alias("content"),
    )
    return files.ingest_logs(uploads).select("filename", F.length("text").cast("bigint").alias("n_chars"), "text")


@query
def sheet_ingest(spark, sf):
    read = preflight.ingest_status(corpus(spark, sf, "cases"), "sheet_id", corpus(spark, sf, "sheets"))
    found = F.expr(preflight.sheet_input_check("status", "sheet_id"))
    return read.select("case_id", "status", found["check"].alias("check"), found["message"].alias("message"))


@query
def config_ingest(spark, sf):
    read = preflight.ingest_status(corpus(spark, sf, "cases"), "config_id", corpus(spark, sf, "configs"))
    found = F.expr(preflight.config_input_check("status", "config_id"))
    return read.select("case_id", "status", found["check"].alias("check"), found["message"].alias("message"))


@query
def pattern_catalog(spark, sf):
    return classification.category_usage(_runs(spark, sf), dimensions.categories(spark))


@query
def genome_catalog(spark, sf):
    settings = preflight.config_settings(corpus(spark, sf, "configs"))
    return preflight.genome_usage(settings, dimensions.genomes(spark))


@query
def corpus_index(spark, sf):
    return files.corpus_index(_runs(spark, sf)).select("filename", "label", "pipeline", "executor")


@query
def corpus_roundtrip(spark, sf):
    """The corpus written by label with its index, and read back through the labelled scan."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    files.save_corpus(_runs(spark, sf), folder)
    back = files.read_corpus(spark, folder)
    return back.select("filename", "label", "pipeline", "source", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def model_roundtrip(spark, sf):
    """Labels of the model as published and loaded again, and whether they and the confidence are those of the original."""
    folder = f"{checkpoint_dir(spark)}/flowtriage-models"
    fitted = trained(spark, sf)
    loaded = TriageClassifier.load(spark, folder, fitted.save(folder))
    matrix = fitted.matrix(_runs(spark, sf))
    before = fitted.classify(matrix).select("run_id", "predicted", "confidence")
    after = loaded.classify(matrix).select("run_id", F.struct("predicted", "confidence").alias("loaded"))
    same = (F.col("predicted") == F.col("loaded.predicted")) & (F.abs(F.col("confidence") - F.col("loaded.confidence")) < 1e-9)
    return before.join(after, "run_id").select("run_id", F.col("loaded.predicted").alias("label"), same.alias("same"))


# --- log triage -----------------------------------------------------------


@query
def log_lines(spark, sf):
    return detection.lines(_runs(spark, sf))


@query
def detect_counts(spark, sf):
    return detection.detections(_runs(spark, sf)).select("run_id", "id", "match_count")


@query
def detect_counts_table(spark, sf):
    """The counts with the catalogue as a table of regexes instead of expressions."""
    counted = detection.counts_by_table(_runs(spark, sf), dimensions.regexes(spark))
    return counted.select("run_id", "id", "match_count")


@query
def matched_lines(spark, sf):
    return detection.matched_lines(_runs(spark, sf)).select("run_id", "id", F.explode_outer("matched").alias("m")).select(
        "run_id", "id", "m.line_num", "m.text"
    )


@query
def detect_confidence(spark, sf):
    return detection.detections(_runs(spark, sf)).select("run_id", "id", F.round("confidence", 6).alias("confidence"))


@query
def detect_enriched(spark, sf):
    found = detection.enriched(detection.detections(_runs(spark, sf)), dimensions.categories(spark))
    return found.select("run_id", "id", "label", "severity", "icon", "cause", "fix", "command", "match_count")


@query
def detect_ranked(spark, sf):
    return detection.detections(_runs(spark, sf)).select("run_id", "id", "rank")


@query
def process_rows(spark, sf):
    return processes.processes(_runs(spark, sf))


@query
def process_rollup(spark, sf):
    return processes.process_rollup(_runs(spark, sf))


@query
def run_metadata(spark, sf):
    return processes.run_metadata(_runs(spark, sf))


@query
def category_lines(spark, sf):
    return detection.category_lines(_runs(spark, sf), DRILL_DOWN_CATEGORY)


@query
def process_fraction(spark, sf):
    rows = processes.process_fraction(processes.processes(_runs(spark, sf)))
    return rows.withColumn("fraction", F.round("fraction", 6))


def _verdicts(spark, sf):
    return classification.classify(_runs(spark, sf))


@query
def severity_counts(spark, sf):
    return _verdicts(spark, sf).select("run_id", "critical", "high", "medium")


@query
def run_health(spark, sf):
    return _verdicts(spark, sf).select("run_id", "run_health")


@query
def primary_failure(spark, sf):
    primary = F.col("primary")
    return _verdicts(spark, sf).select(
        "run_id", primary["id"].alias("id"), primary["label"].alias("label"), primary["severity"].alias("severity"),
        primary["match_count"].alias("match_count"), F.round(primary["confidence"], 6).alias("confidence"),
    )


@query
def triage_summary(spark, sf):
    return _verdicts(spark, sf).select("run_id", "triage_summary")


@query
def classify_runs(spark, sf):
    return _verdicts(spark, sf).select(
        "run_id", "run_health", "critical", "high", "medium", F.col("primary.id").alias("primary_id"),
        F.size("detected").cast("bigint").alias("n_failures"),
        F.array_join(F.transform("detected", lambda d: d["id"]), ",").alias("all_failures"), "triage_summary",
    )


@query
def pattern_reference(spark, sf):
    return classification.regex_reference(_runs(spark, sf), dimensions.regexes(spark))


# --- structured features --------------------------------------------------


def _features(spark, sf, *names):
    return features.features(_runs(spark, sf)).select("run_id", *names)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query
def feat_exit_code(spark, sf):
    return _features(spark, sf, "exit_code")


@query
def feat_exit_onehot(spark, sf):
    return _features(spark, sf, *[f"exit_is_{c}" for c in EXIT_ONE_HOT])


@query
def feat_memory(spark, sf):
    return _rounded(_features(spark, sf, "memory_requested_gb", "memory_available_gb", "memory_ratio"))


@query
def feat_process(spark, sf):
    return _rounded(_features(spark, sf, "n_processes", "n_completed", "n_failed", "completion_ratio"))


@query
def feat_lines(spark, sf):
    return _rounded(_features(spark, sf, "n_lines", "n_error_lines", "n_warning_lines", "error_density"))


@query
def feat_markers(spark, sf):
    return _features(spark, sf, *MARKER_REGEXES)


@query
def feat_regex_counts(spark, sf):
    return _features(spark, sf, *[n for n in feature_names() if n.startswith("regex_")])


@query
def feature_table(spark, sf):
    return _rounded(_features(spark, sf, *feature_names()))


# --- text features, training and prediction -------------------------------


@query
def tokens(spark, sf):
    return text.tokens(_docs(spark, sf)).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


@query
def ngrams(spark, sf):
    return text.terms(_docs(spark, sf)).select(
        "doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", "|").alias("terms")
    )


@query
def vocabulary(spark, sf):
    return text.vocabulary(_docs(spark, sf)).select("term", "count", "idx")


@query
def tfidf(spark, sf):
    docs = _docs(spark, sf)
    return text.tfidf(docs, text.fit_weights(docs)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def label_index(spark, sf):
    return model.label_index(_runs(spark, sf).select("run_id", "label"))


@lru_cache(maxsize=2)
def _trained(application: str, sf: str, state: int, per_label: int | None) -> TriageClassifier:
    spark = SparkSession.active()
    # All labelled runs are for the documented learner.
    learner = model.BOOSTED if per_label is None else model.FOREST
    return TriageClassifier(per_label=per_label, learner=learner).fit(_runs(spark, sf))


def trained(spark: SparkSession, sf: str, per_label: int | None = SAMPLE_PER_LABEL) -> TriageClassifier:
    """A model with the documented settings, shared by the queries of one application while the orders stay the same."""
    files = table(spark, sf, "orders").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()[0]
    return _trained(spark.sparkContext.applicationId, sf, state, per_label)


@query
def hybrid_features(spark, sf):
    runs = _runs(spark, sf)
    weights = text.fit_weights(runs, id_col="run_id")
    matrix = model.hybrid_features(runs, weights, weights.count())
    total = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["value"])
    return matrix.select("run_id", F.size("pairs").cast("bigint").alias("n_values"), F.round(total, 4).alias("total"))


@query
def train_model(spark, sf):
    """Per label of the boosted model: its code, the runs that the trees grew on, which are all, how many of them it gets right, and its trees."""
    fitted = trained(spark, sf, per_label=None)
    right = F.count_if(F.col("label") == F.col("predicted"))
    matrix = fitted.matrix(_runs(spark, sf), keep=("label",))
    found = fitted.classify(matrix).groupBy("label").agg(F.count("*").alias("n_sample"), right.alias("n_right"))
    codes = F.array(*[F.lit(x) for x in fitted.labels])
    return found.select(
        "label", (F.array_position(codes, F.col("label")) - 1).alias("label_idx"), "n_sample", "n_right",
        F.lit(fitted.trees.getNumTrees).cast("bigint").alias("n_trees"),
    )


@query
def cv_folds(spark, sf):
    return model.folds(_runs(spark, sf))


@query
def cv_group_folds(spark, sf):
    """Folds of the corpus in which each real run comes four times: the copies of a run and the folds that hold them."""
    runs = _runs(spark, sf)
    real = files.labelled_logs(corpus(spark, sf, "label_index"), _run_files(spark, sf)).select("filename", "label")
    name = F.concat(F.lit("synthetic_"), F.col("run_id").cast("string"))
    both = evaluation.with_real_runs(runs.select(name.alias("filename"), "label"), real)
    dealt = model.folds(both, group="filename")
    return dealt.groupBy("filename").agg(
        F.min("label").alias("label"), F.count("*").alias("n_copies"), F.count_distinct("fold").alias("n_folds"), F.min("fold").alias("fold")
    )


@query
def cv_score(spark, sf):
    """Runs scored and predicted right by the trees of the other folds, by fold; rules separate these logs almost fully."""
    scores = model.cross_validate(TriageClassifier(), _runs(spark, sf))
    right = F.col("n_right") >= 0.95 * F.col("n_runs")
    return scores.select(
        "fold", "n_runs", right.alias("mostly_right"), F.col("f1_macro").between(0.9, 1.0).alias("good"),
        F.col("mean_f1").between(0.9, 1.0).alias("good_mean"), (F.col("std_f1") < 0.1).alias("steady"),
    )


@query
def classification_report(spark, sf):
    runs = _runs(spark, sf)
    predicted = evaluation.predicted_label(classification.classify(runs, keep=("label",)), keep=("label",))
    return _rounded(evaluation.classification_report(predicted))


@query
def predict_top5(spark, sf):
    """Per run: the number of classes shown, and whether they are ranked probabilities led by the label."""
    predicted = trained(spark, sf).predict(_runs(spark, sf))
    chances = F.map_values("probabilities")
    ranked = F.forall(F.sequence(F.lit(1), F.size(chances) - 1), lambda i: F.get(chances, i) <= F.get(chances, i - 1))
    whole = F.aggregate("ranked", F.lit(0.0), lambda a, r: a + r["probability"])
    return predicted.select(
        "run_id",
        F.get(F.map_keys("probabilities"), F.lit(0)).alias("first"),
        F.size("probabilities").cast("bigint").alias("n_classes"),
        (ranked & (F.get(F.map_keys("probabilities"), F.lit(0)) == F.col("label"))).alias("ranked"),
        (F.abs(whole - 1) < 1e-9).alias("sums_to_one"),
    )


@query
def predict_batch(spark, sf):
    """The learnt label of every run, and whether its confidence is that of the first class."""
    predicted = trained(spark, sf).predict(_runs(spark, sf))
    best = F.array_max(F.map_values("probabilities"))
    return predicted.select("run_id", "label", ((F.col("confidence") == best) & F.col("confidence").between(0, 1)).alias("sound"))


def _contributions(spark, sf):
    pairs = features.features(_runs(spark, sf)).select("run_id", features.feature_pairs().alias("pairs"))
    top = model.top_contributions(F.col("pairs"), FIXED_IMPORTANCES, feature_names())
    return pairs.select("run_id", top.alias("top_features"))


@query
def top_features(spark, sf):
    return _rounded(
        _contributions(spark, sf)
        .select("run_id", F.posexplode(computed("top_features")).alias("pos", "f"))
        .select("run_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "f.*")
    )


@query
def explain(spark, sf):
    """Per run: the method, and whether the contributions are few, positive and ranked."""
    explained = trained(spark, sf).explain(_runs(spark, sf))
    shares = F.transform("explanation", lambda f: f["importance"])
    falling = F.forall(F.sequence(F.lit(0), F.size(shares)), lambda i: F.coalesce(F.get(shares, i + 1) <= F.get(shares, i), F.lit(True)))
    sound = (F.size(shares) <= model.TOP_FEATURES) & F.forall(shares, lambda s: s > 0) & falling
    return explained.select("run_id", "label", "explanation_method", (F.size(shares) > 0).alias("explained"), sound.alias("sound"))


@query
def diagnosis(spark, sf):
    predicted = evaluation.predicted_label(_verdicts(spark, sf))
    return evaluation.diagnosis(predicted, dimensions.categories(spark))


@query
def model_diagnosis(spark, sf):
    """The diagnosis of the learnt labels."""
    predicted = trained(spark, sf).predict(_runs(spark, sf)).select("run_id", "predicted")
    return evaluation.diagnosis(predicted, dimensions.categories(spark))


@query
def model_alternatives(spark, sf):
    """Per run: whether alternatives to the learnt label are failures above the threshold and below the confidence."""
    predicted = trained(spark, sf).predict(_runs(spark, sf))
    shown = evaluation.alternatives(predicted).groupBy("run_id").agg(F.min("probability").alias("least"), F.max("probability").alias("most"))
    sound = (F.col("least") > evaluation.ALTERNATIVE_THRESHOLD) & (F.col("most") <= F.col("confidence"))
    return predicted.select("run_id", "predicted", "confidence").join(shown, "run_id", "left").select(
        "run_id", "predicted", F.coalesce(sound, F.lit(True)).alias("sound")
    )


@query
def training_report(spark, sf):
    """The report on the sample that the model was trained on."""
    runs = _runs(spark, sf)
    drawn = evaluation.balanced_sample(runs, SAMPLE_PER_LABEL).select("run_id")
    sample = runs.join(F.broadcast(drawn), "run_id", "left_semi")
    predicted = trained(spark, sf).predict(sample).select("run_id", "predicted")
    return _rounded(evaluation.classification_report(sample.select("run_id", "label").join(predicted, "run_id")))


@query
def parse_runs(spark, sf):
    """Totals of the nested parse result of every run."""
    parsed = classification.parse(_runs(spark, sf))
    return parsed.select(
        "run_id", F.size("detected").cast("bigint").alias("n_detected"), "total_processes", "completed_processes", "failed_processes",
        F.col("meta.failed_process").alias("failed_process"),
    )


@query
def alternatives(spark, sf):
    return _rounded(evaluation.alternatives(evaluation.confidence_shares(_verdicts(spark, sf))))


@query
def explanation_shortlist(spark, sf):
    return _rounded(evaluation.explanation_shortlist(_contributions(spark, sf)))


@query
def label_distribution(spark, sf):
    return evaluation.label_distribution(_runs(spark, sf))


@query
def oversample(spark, sf):
    name = F.concat(F.lit("run_"), F.col("run_id").cast("string"), F.lit(".log"))
    synthetic = _runs(spark, sf).select(name.alias("filename"), "label")
    real = files.labelled_logs(corpus(spark, sf, "label_index"), _run_files(spark, sf)).select("filename", "label")
    return evaluation.with_real_runs(synthetic, real).select("filename", "label", "source", _long("copy"))


@query
def balanced_sample(spark, sf):
    return evaluation.balanced_sample(_runs(spark, sf), SAMPLE_PER_LABEL)


@query
def smoke_compare(spark, sf):
    runs = _runs(spark, sf)
    predicted = evaluation.predicted_label(classification.classify(runs, keep=("label",)), keep=("label",))
    return _rounded(evaluation.smoke_table(predicted))


# --- sample sheets --------------------------------------------------------


def _validated(spark, sf):
    return sheets.validate(corpus(spark, sf, "sheets"))


def _rule(spark, sf, rule):
    of_rule = F.filter("issues", lambda i: i["rule"] == rule)
    return _validated(spark, sf).select("sheet_id", F.inline(of_rule)).select("sheet_id", "row_num", "type", "message")


@query
def sheet_rows(spark, sf):
    return sheets.sheet_rows(sheets.parse(corpus(spark, sf, "sheets")))


@query
def sheet_empty(spark, sf):
    return _rule(spark, sf, sheets.EMPTY).drop("row_num")


@query
def sheet_missing_columns(spark, sf):
    return _rule(spark, sf, sheets.COLUMNS).drop("row_num")


@query
def sheet_sample_id(spark, sf):
    return _rule(spark, sf, sheets.SAMPLE)


@query
def sheet_fastq1(spark, sf):
    return _rule(spark, sf, sheets.FASTQ_1)


@query
def sheet_fastq2(spark, sf):
    return _rule(spark, sf, sheets.FASTQ_2)


@query
def sheet_pair_naming(spark, sf):
    return _rule(spark, sf, sheets.NAMING)


@query
def sheet_strandedness(spark, sf):
    return _rule(spark, sf, sheets.STRAND)


@query
def sheet_duplicates(spark, sf):
    return sheets.with_duplicates(sheets.parse(corpus(spark, sf, "sheets"))).select(
        "sheet_id", F.inline(F.when(~F.col("is_empty"), F.col("duplicates")))
    )


@query
def sheet_summary(spark, sf):
    return sheets.summaries(_validated(spark, sf)).withColumn("columns", F.array_join("columns", ","))


@query
def sheet_issues(spark, sf):
    return sheets.issues(_validated(spark, sf))


# --- launch readiness -----------------------------------------------------


@query
def pf_sheet_checks(spark, sf):
    return preflight.structure_checks(_validated(spark, sf)).select("sheet_id", F.posexplode(computed("checks")).alias("pos", "c")).select(
        "sheet_id", (F.col("pos") + 1).cast("bigint").alias("ord"), "c.check", "c.status", "c.severity", "c.message"
    )


@query
def pf_fastq_exists(spark, sf):
    found = preflight.fastq_checks(_validated(spark, sf), corpus(spark, sf, "manifest"))
    return found.select(
        "sheet_id", "fastq_check.status", "fastq_check.message", F.array_join("fastq_check.details", "|").alias("details")
    )


def _configs(spark, sf):
    return corpus(spark, sf, "configs")


def _settings(spark, sf):
    return preflight.config_settings(_configs(spark, sf))


def _config_check(df: DataFrame, check: str) -> DataFrame:
    return df.select("config_id", F.inline(preflight.check_array(check))).select(
        "config_id", "check", "status", "severity", "message"
    )


@query
def pf_braces(spark, sf):
    return _config_check(
        _configs(spark, sf).select("config_id", preflight.brace_balance(F.col("text")).alias("balance")), preflight.brace_check()
    )


@query
def pf_config_settings(spark, sf):
    return _settings(spark, sf)


@query
def pf_container_engine(spark, sf):
    return _settings(spark, sf).select("config_id", "container_engine")


@query
def pf_memory_alloc(spark, sf):
    return _config_check(_settings(spark, sf), preflight.memory_check())


@query
def pf_cpu_alloc(spark, sf):
    return _config_check(_settings(spark, sf), preflight.cpu_check())


@query
def pf_engine_check(spark, sf):
    return _config_check(_settings(spark, sf), preflight.engine_check())


@query
def pf_references(spark, sf):
    found = preflight.reference_checks(_settings(spark, sf), corpus(spark, sf, "manifest"))
    return found.select("config_id", F.posexplode(computed("reference_checks")).alias("pos", "c")).select(
        "config_id", (F.col("pos") + 1).cast("bigint").alias("ord"), "c.check", "c.status", "c.severity", "c.message"
    )


@query
def pf_memory_genome(spark, sf):
    return _config_check(preflight.with_genome_figures(_settings(spark, sf)), preflight.memory_genome_check())


def _case_checks(frame: DataFrame, checks: Column) -> DataFrame:
    return frame.select("case_id", F.inline(checks)).select("case_id", "check", "status", "severity", "message")


@query
def pf_disk(spark, sf):
    frame = preflight.case_frame(
        corpus(spark, sf, "cases"), preflight.sample_side(corpus(spark, sf, "sheets")),
        preflight.with_genome_figures(_settings(spark, sf)), corpus(spark, sf, "hosts"),
    )
    return _case_checks(preflight.with_disk_need(frame), preflight.check_array(preflight.disk_check()))


@query
def pf_tools(spark, sf):
    host = preflight.host_side(corpus(spark, sf, "hosts"), corpus(spark, sf, "host_tools"))
    frame = preflight.case_frame(corpus(spark, sf, "cases"), None, _settings(spark, sf), host)
    return _case_checks(frame, preflight.check_array(*preflight.tool_checks()))


def _reports(spark, sf):
    names = ("cases", "sheets", "configs", "manifest", "hosts", "host_tools")
    return preflight.run(*[corpus(spark, sf, n) for n in names])


@query
def pf_all_checks(spark, sf):
    return preflight.all_checks(_reports(spark, sf)).withColumn("details", F.array_join("details", "|"))


@query
def pf_verdict(spark, sf):
    return _reports(spark, sf).drop("checks", "settings")


@query
def pf_ordered_checks(spark, sf):
    return preflight.ordered_checks(_reports(spark, sf))


@query
def pf_config_report(spark, sf):
    return preflight.config_report(_settings(spark, sf))
