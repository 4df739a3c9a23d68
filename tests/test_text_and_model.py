import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowtriage.functions.ranking import hash_position
from flowtriage.operators import evaluation, features, model, text
from flowtriage.operators.classification import classify
from flowtriage.operators.model import TriageClassifier
from flowtriage.plans import registry

TOKEN = re.compile(r"(?u)\b\w[\w./:-]+\b")
TEXTS = [
    "STAR --genomeDir /data/ref.fa: exit 137, v2.7.10a",
    "a bb a. ./x - é É café ÇA Ça x_y::z.. 42 ½½",
    "the the the cat sat; the cat ran",
    "",
    "x",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def stripped(s):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def grams(s):
    t = TOKEN.findall(stripped(s))
    return t + [" ".join(t[i : i + 2]) for i in range(len(t) - 1)] + [" ".join(t[i : i + 3]) for i in range(len(t) - 2)]


def test_terms_match_plain_python(docs):
    got = {r.doc_id: list(r.terms) for r in text.terms(docs).collect()}
    assert got == {i: grams(t) for i, t in enumerate(TEXTS)}


def test_vocabulary_and_tfidf_by_brute_force(spark, docs):
    counts = Counter(g for t in TEXTS for g in grams(t))
    top = sorted(counts, key=lambda g: (-counts[g], g))[:8]
    index = {g: i for i, g in enumerate(sorted(top))}
    got = {r.term: (r["count"], r.idx) for r in text.vocabulary(docs, 8).collect()}
    assert got == {g: (counts[g], index[g]) for g in top}
    n = len(TEXTS)
    expected = {}
    for i, t in enumerate(TEXTS):
        tf = Counter(g for g in grams(t) if g in index)
        w = {g: (1 + math.log(c)) * (math.log((1 + n) / (1 + sum(g in grams(x) for x in TEXTS))) + 1) for g, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        expected.update({(i, g): v / norm for g, v in w.items()})
    rows = text.tfidf(docs, text.fit_weights(docs, 8)).collect()
    assert {(r.doc_id, r.term) for r in rows} == set(expected)
    assert all(abs(r.weight - expected[r.doc_id, r.term]) < 1e-9 for r in rows)


def test_hash_position_equals_a_global_sort(spark):
    n = 5000
    df = spark.range(n).select(F.col("id").alias("run_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("label"))
    key = lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i)
    got = {r.run_id: r.position for r in hash_position(df, "run_id", seed=7).collect()}
    assert got == {i: p for p, i in enumerate(sorted(range(n), key=key))}
    by = {r.run_id: r.position for r in hash_position(df, "run_id", by=["label"], seed=7).collect()}
    for members in ([i for i in range(n) if i % 3], [i for i in range(n) if not i % 3]):
        assert [by[i] for i in sorted(members, key=key)] == list(range(len(members)))


def test_folds_are_stratified(spark):
    df = spark.range(1003).select(F.col("id").alias("run_id"), F.when(F.col("id") < 900, "a").otherwise("b").alias("label"))
    sizes = {(r.label, r.fold): r["count"] for r in model.folds(df).groupBy("label", "fold").count().collect()}
    assert {sizes["a", k] for k in range(5)} == {180} and {sizes["b", k] for k in range(5)} <= {20, 21}


def test_balanced_sample(spark):
    df = spark.range(300).select(F.col("id").alias("run_id"), F.when(F.col("id") < 10, "rare").when(F.col("id") < 150, "clean").otherwise("x").alias("label"))
    counts = {r.label: r["count"] for r in evaluation.balanced_sample(df, 20).groupBy("label").count().collect()}
    assert counts == {"rare": 10, "clean": 20, "x": 20}
    rest = evaluation.balanced_sample(df, 20, include_clean=False)
    assert sorted(r.position for r in rest.collect()) == list(range(30))


def test_classification_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    rows = {r["class"]: r for r in evaluation.classification_report(spark.createDataFrame(pairs, "label string, predicted string")).collect()}
    assert (rows["a"].precision, rows["a"].recall, rows["a"].support) == (0.75, 0.75, 4)
    assert (rows["c"].precision, rows["c"].recall, rows["c"].f1) == (0.0, 0.0, 0.0)
    assert rows["accuracy"].f1 == pytest.approx(5 / 7)
    assert rows["macro avg"].recall == pytest.approx((0.75 + 1 + 0) / 3)
    assert rows["weighted avg"].recall == pytest.approx((4 * 0.75 + 2 * 1) / 7)


def test_diagnosis_of_unknown_label(spark, runs):
    from flowtriage.sources import dimensions

    df = spark.createDataFrame([(1, "odd_new_thing"), (2, "clean"), (3, "invalid_parameter")], "run_id bigint, predicted string")
    rows = {r.run_id: r for r in evaluation.diagnosis(df, dimensions.categories(spark)).collect()}
    assert (rows[1].label, rows[1].verdict, rows[1].severity, rows[1].icon) == ("Odd New Thing", "fail", "high", "⚠️")
    assert (rows[2].verdict, rows[2].label) == ("pass", None)
    assert rows[3].verdict == "warn"


def test_alternatives_and_shortlist(spark, runs):
    shares = evaluation.confidence_shares(classify(runs("EACCES\nENOSPC", "fine")))
    assert [(r.run_id, r.alternative, r.probability) for r in evaluation.alternatives(shares).collect()] == [(0, "disk_space", 0.5)]
    pairs = features.features(runs("EACCES")).select("run_id", features.feature_pairs().alias("pairs"))
    names = features.feature_names()
    weights = [0.5 if n == "regex_permission_issue" else 0.001 if n == "n_lines" else 0.0 for n in names]
    top = pairs.select("run_id", model.top_contributions(F.col("pairs"), weights, names).alias("top_features"))
    assert [f.feature for f in top.first().top_features] == ["regex_permission_issue", "n_lines"]
    assert [r.feature for r in evaluation.explanation_shortlist(top).collect()] == ["Pattern: permission_issue"]


@pytest.fixture(scope="module")
def trained(spark):
    kinds = {"memory_exceeded": "SIGKILL memory limit reached", "disk_space": "No space left on device ENOSPC", "clean": "Pipeline completed successfully"}
    rows = [(i * 3 + k, f"run {i} {t}", label) for i in range(12) for k, (label, t) in enumerate(kinds.items())]
    corpus = spark.createDataFrame(rows, "run_id bigint, text string, label string")
    return corpus, TriageClassifier(max_features=20, max_iter=2, max_depth=2).fit(corpus)


def test_train_predict_explain(trained):
    corpus, fitted = trained
    explained = fitted.explain(corpus).join(corpus.withColumnRenamed("label", "truth"), "run_id").collect()
    assert len(explained) == 36 and all(r.label == r.truth for r in explained)
    for r in explained:
        probabilities = list(r.probabilities.values())
        assert r.confidence == max(probabilities) and sum(probabilities) == pytest.approx(1.0)
        assert r.explanation_method == "feature_importance" and len(r.top_features) <= 10
        assert all(f.importance > 0 for f in r.top_features)


def test_model_round_trip(spark, trained, tmp_path):
    corpus, fitted = trained
    version = fitted.save(str(tmp_path))
    loaded = TriageClassifier.load(spark, str(tmp_path))
    key = lambda m: {r.run_id: (r.label, round(r.confidence, 9)) for r in m.predict(corpus).collect()}
    assert key(loaded) == key(fitted) and loaded.learner == model.FOREST
    assert key(TriageClassifier.load(spark, str(tmp_path), version)) == key(fitted)


def test_half_written_versions_are_never_loaded(spark, trained, tmp_path):
    corpus, fitted = trained
    first = fitted.save(str(tmp_path))
    second = fitted.save(str(tmp_path))
    assert first != second
    # An application that stops before its note is written, and one that stops while writing it.
    (tmp_path / "versions" / "broken" / "trees").mkdir(parents=True)
    (tmp_path / "published" / "torn" / "_temporary" / "0").mkdir(parents=True)
    assert TriageClassifier.load(spark, str(tmp_path)).labels == fitted.labels
    assert TriageClassifier.load(spark, str(tmp_path), first).terms == fitted.terms
    with pytest.raises(FileNotFoundError):
        TriageClassifier.load(spark, str(tmp_path), "broken")


def test_boosted_learner(spark, trained, tmp_path):
    corpus, _ = trained
    fitted = TriageClassifier(max_features=20, max_iter=2, max_depth=2, learner=model.BOOSTED).fit(corpus)
    predicted = fitted.predict(corpus).join(corpus.withColumnRenamed("label", "truth"), "run_id").collect()
    assert all(r.label == r.truth and sum(r.probabilities.values()) == pytest.approx(1.0) for r in predicted)
    assert sum(fitted.importances()) == pytest.approx(1.0)
    fitted.save(str(tmp_path))
    again = TriageClassifier.load(spark, str(tmp_path)).predict(corpus).collect()
    assert {r.run_id: r.confidence for r in again} == pytest.approx({r.run_id: r.confidence for r in predicted})
    with pytest.raises(ValueError):
        TriageClassifier(learner="other").fit(corpus)


def test_untrained_model_refuses(runs, tmp_path):
    with pytest.raises(RuntimeError):
        TriageClassifier().predict(runs("x"))
    with pytest.raises(RuntimeError):
        TriageClassifier().save(str(tmp_path))


def test_accents_of_other_scripts(spark):
    """Marks go, letters stay, and what decomposes to several characters expands."""
    words = ["Ünïcödé", "がぎパ", "שָׁלוֹם", "Ёлка йод", "ώρα", "ＡＢＣ", "ĳs x̂y", "한국어", "가각힣 값", "ﬁle ﬂow ﬃ", "½ ⅔x", "㎏/m² ㍿", "ǆez ﷺ", "𝐀𝐁 𝟙𝟚 🄀x"]
    got = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    found = {r.doc_id: list(r.tokens) for r in text.tokens(got).collect()}
    for i, word in enumerate(words):
        assert found[i] == re.findall(r"\b\w[\w./:-]+\b", stripped(word)), word


def test_plain_text_takes_the_short_way_to_the_same_tokens(spark):
    plain = "A/b.c:D-e _x1 .y. a-- --b c: 12_ x\x7fy Ab\tcd q\x00r z"
    got = spark.createDataFrame([(1, plain), (2, plain + " é")], "doc_id bigint, text string")
    one, two = (list(r.tokens) for r in text.tokens(got).orderBy("doc_id").collect())
    assert one == two == re.findall(r"\b\w[\w./:-]+\b", plain.lower())


def test_heavy_hitters_with_a_sketch_that_is_too_small(spark):
    """Eight buckets for hundreds of terms: the bound tells nothing, is widened, and the result stays exact."""
    rows = [f"t{i}" for i in range(300) for _ in range(1 + (300 - i) // 7)]
    counts = Counter(rows)
    found = spark.createDataFrame([(x,) for x in rows], "term string").repartition(3)
    for n, width in ((20, 8), (20, 64), (5, 1 << 12), (400, 8), (400, 1 << 12)):
        got = [(r.term, r["count"]) for r in text.heavy_hitters(found, n, width).orderBy(F.desc("count"), "term").collect()]
        assert got == sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:n]
    assert text.heavy_hitters(found.limit(0), 5).count() == 0


def test_sketch_leaves_out_most_terms(spark):
    """Few of many rare terms reach the exact count, and no frequent one is lost."""
    rows = spark.range(60_000).select(F.concat(F.lit("rare"), "id").alias("term")).unionAll(
        spark.range(50_000).select(F.concat(F.lit("often"), F.col("id") % 50).alias("term"))
    )
    width = 1 << 14
    sketch = text._sketch(rows, width).cache()
    kept = {r.term: r["count"] for r in text._at_least(rows, sketch, width, 900).collect()}
    assert {f"often{i}": 1000 for i in range(50)}.items() <= kept.items() and len(kept) < 60


def test_transforms_do_not_shuffle(spark, docs):
    weights = text.fit_weights(docs, 8)
    runs = docs.withColumnRenamed("doc_id", "run_id")
    for df in (text.tfidf(docs, weights), model.hybrid_features(runs, weights, 8)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_weights_of_a_corpus_without_terms(spark):
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    weights = text.fit_weights(empty, 8)
    assert weights.count() == 0 and text.tfidf(empty, weights).count() == 0


def test_sample_is_bounded_per_label(spark):
    rows = [(i, f"text number {i} of {'ab'[i % 2]}", "ab"[i % 2]) for i in range(60)]
    fitted = TriageClassifier(max_features=30, max_iter=3, max_depth=2, per_label=5)
    matrix = fitted.prepare(spark.createDataFrame(rows, "run_id bigint, text string, label string"))
    assert sorted(r["count"] for r in matrix.groupBy("label").count().collect()) == [5, 5]


def test_trees_grow_on_all_labelled_runs_without_a_limit(spark):
    rows = [(i, f"text number {i} of {'ab'[i % 2]}", "ab"[i % 2] if i < 500 else None) for i in range(510)]
    fitted = TriageClassifier(max_features=30, max_iter=3, max_depth=2, per_label=None)
    matrix = fitted.prepare(spark.createDataFrame(rows, "run_id bigint, text string, label string"))
    assert sorted(r["count"] for r in matrix.groupBy("label").count().collect()) == [250, 250]


def test_train_model_takes_every_run(spark, monkeypatch):
    """More runs of a label than the documented sample has: all are grown on and counted."""
    rows = [(i, f"of {'ab'[i % 2]}{'ab'[i % 2]} kind", "ab"[i % 2]) for i in range(500)]
    corpus = spark.createDataFrame(rows, "run_id bigint, text string, label string")
    monkeypatch.setattr(registry, "_runs", lambda *_: corpus)
    monkeypatch.setattr(registry, "trained", lambda spark, sf, per_label=200: TriageClassifier(max_features=20, max_iter=2, max_depth=2, per_label=per_label).fit(corpus))
    got = {r.label: (r.label_idx, r.n_sample, r.n_right) for r in registry.QUERIES["train_model"](spark, "").collect()}
    assert got == {"a": (0, 250, 250), "b": (1, 250, 250)}


def test_vocabulary_and_idf_are_those_of_all_runs(spark):
    rows = [(i, f"text {'ab'[i % 2]} only{i}", "ab"[i % 2]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "run_id bigint, text string, label string")
    fitted = TriageClassifier(max_features=500, per_label=5)
    fitted.prepare(corpus)
    assert {f"only{i}" for i in range(60)} <= set(fitted.terms)
    idf = {r.term: r.idf for r in fitted.weights.collect()}
    assert idf["only7"] == pytest.approx(math.log(61 / 2) + 1) and idf["text"] == pytest.approx(1.0)


def test_cross_validation_scores_every_run(spark, monkeypatch):
    """Each run once, by trees that grew on a bounded sample of the other folds."""
    rows = [(i, f"number {i} of {'alpha beta'.split()[i % 3 % 2]}", "ab"[i % 3 % 2]) for i in range(90)]
    corpus = spark.createDataFrame(rows, "run_id bigint, text string, label string")
    grown = []
    grow = TriageClassifier._grown

    def growing(self, matrix):
        grown.append({label: sorted(r.run_id for r in matrix.where(F.col("label") == label).collect()) for label in "ab"})
        return grow(self, matrix)

    monkeypatch.setattr(TriageClassifier, "_grown", growing)
    classifier = TriageClassifier(max_features=40, max_iter=5, max_depth=2, per_label=7)
    got = model.cross_validate(classifier, corpus, parallelism=1).collect()
    assert len(got) == 5 and sum(r.n_runs for r in got) == 90 and all(r.n_right <= r.n_runs for r in got)
    own = {r.run_id: r.fold for r in model.folds(corpus).collect()}
    assert len(grown) == 5
    for k, by_label in enumerate(grown):
        assert all(len(ids) == 7 and all(own[i] != k for i in ids) for ids in by_label.values())


def test_copies_stay_in_one_fold_and_are_taken_for_training_only(spark, monkeypatch):
    rows = [(i, f"number {i} of {'alpha beta'.split()[i % 2]}", "ab"[i % 2], f"run{i // 4}", 4 if i % 4 else 1) for i in range(120)]
    corpus = spark.createDataFrame(rows, "run_id bigint, text string, label string, original string, copies int")
    dealt = model.folds(corpus, group="original")
    assert dealt.count() == 120
    assert dealt.groupBy("original").agg(F.count_distinct("fold").alias("n")).where("n != 1").count() == 0
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    assert sizes == [24] * 5
    grown = []
    grow = TriageClassifier._grown

    def growing(self, matrix):
        grown.append(Counter(r.run_id for r in matrix.collect()))
        return grow(self, matrix)

    monkeypatch.setattr(TriageClassifier, "_grown", growing)
    classifier = TriageClassifier(max_features=40, max_iter=3, max_depth=2)
    got = model.cross_validate(classifier, corpus, group="original", copies="copies", parallelism=1).collect()
    fold = {r.run_id: r.fold for r in dealt.collect()}
    assert sum(r.n_runs for r in got) == 120
    for k, taken in enumerate(grown):
        assert taken == {i: (4 if i % 4 else 1) for i in fold if fold[i] != k}
    lone = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", "x")], "run_id bigint, label string, original string")
    assert {r.run_id for r in model.folds(lone, group="original").collect()} == {1, 2, 3}


def test_fold_scores_are_macro_f1(spark):
    pairs = [(0, "a", "a")] * 3 + [(0, "a", "b")] + [(0, "b", "b")] * 2 + [(1, "c", "a")]
    got = {r.fold: r for r in evaluation.fold_scores(spark.createDataFrame(pairs, "fold int, label string, predicted string")).collect()}
    assert (got[0].n_runs, got[0].n_right) == (6, 5) and got[0].f1_macro == pytest.approx((6 / 7 + 4 / 5) / 2)
    assert (got[1].n_right, got[1].f1_macro) == (0, 0.0)


def test_frequent_terms_by_brute_force(spark):
    """Also with many ties at the bound, and where too many tie for a broadcast."""
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(40))) for _ in range(80)] + ["é w1 w2 w3", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = Counter(g for t in texts for g in grams(t or ""))
    for n in (1, 7, 50, 300, 10_000):
        expected = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:n]
        for most in (text.MOST_BROADCAST, 3, 0):
            assert sorted(map(tuple, text.frequent_terms(df, n, most).collect()), key=lambda c: (-c[1], c[0])) == expected


def test_vocabulary_broadcasts_little_where_rare_terms_abound(spark, monkeypatch):
    """Of rare tokens, as of runs that have one each, none is broadcast or counted in longer terms."""
    sizes, plain = [], F.broadcast
    monkeypatch.setattr(text.F, "broadcast", lambda df: (sizes.append(df.count()), plain(df))[1])
    logs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.expr("concat('start node', id % 20, ' rare', id, ' other', id)").alias("text"))
    top = text.vocabulary(logs, 15).collect()
    assert len(top) == 15 and sizes and max(sizes) <= 60
    # All buckets of the sketch are as full as the bound: words of 64 of them are broadcast.
    sizes.clear()
    found = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("term"))
    width = 1 << 12
    assert text._at_least(found, text._sketch(found, width), width, 1).count() == 20_000
    assert sizes and max(sizes) <= width // 64
