"""Gradient boosting against a plain one, and in the query that trains the documented model."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowtriage.operators import boosting, model
from flowtriage.operators.model import TriageClassifier
from flowtriage.plans import registry


def plain_tree(x, r, rows, depth):
    """(feature, threshold, left, right) of the largest fall of squared error, or the rows of a leaf."""
    best = None
    if depth and len(rows) > 1 and np.ptp(r[rows]) > 1e-6:
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for threshold in (values[:-1] + values[1:]) / 2:
                left, right = rows[x[rows, f] <= threshold], rows[x[rows, f] > threshold]
                gain = len(left) * len(right) / len(rows) * (r[left].mean() - r[right].mean()) ** 2
                if best is None or gain > best[0] * (1 + 1e-6):
                    best = gain, left, right
    if best is None:
        return [rows]
    return plain_tree(x, r, best[1], depth - 1) + plain_tree(x, r, best[2], depth - 1)


def plain_boost(x, y, k, steps, depth, rate):
    scores = np.tile(np.log(np.bincount(y, minlength=k) / len(y)), (len(y), 1))
    for _ in range(steps):
        residual = np.eye(k)[y] - boosting.softmax(scores)
        for c in range(k):
            for rows in plain_tree(x, residual[:, c], np.arange(len(y)), depth):
                r = residual[rows, c]
                scores[rows, c] += rate * (k - 1) / k * r.sum() / (np.abs(r) * (1 - np.abs(r))).sum()
    return boosting.softmax(scores)


def matrix_of(spark, x, y):
    rows = [(i, float(c), Vectors.sparse(len(v), np.flatnonzero(v).tolist(), v[v != 0].tolist())) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["run_id", "label_idx", "features"])


def chances(trees, matrix):
    vector = F.unwrap_udt("features")
    found = matrix.select("run_id", trees.probabilities(vector["indices"], vector["values"]).alias("p")).orderBy("run_id").collect()
    return np.array([r.p for r in found])


@pytest.mark.parametrize("rows_per_task", [8_000, 40])
def test_boosting_is_the_plain_one(spark, monkeypatch, tmp_path, rows_per_task):
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", rows_per_task)
    monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", rows_per_task << 9)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((150, 6)) < 0.5, 0, rng.integers(-3, 9, (150, 6)) / 4)
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] + rng.normal(0, 0.4, 150) > 0.4)
    matrix = matrix_of(spark, x, y)
    trees = boosting.boost(matrix, 3, 6, 3, 3, 0.1, 1.0, 42)
    assert trees.getNumTrees == 3 and max(len(t.feature) for step in trees.steps for t in step) > 7
    expected = plain_boost(x, y, 3, 3, 3, 0.1)
    assert np.abs(chances(trees, matrix) - expected).max() < 1e-4
    assert sum(trees.importances()) == pytest.approx(1.0)
    trees.save(spark, str(tmp_path))
    assert np.allclose(chances(boosting.BoostedTrees.load(spark, str(tmp_path)), matrix), chances(trees, matrix))


def test_scores_survive_checkpoints_and_steps_draw_their_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHECKPOINT_STEPS", 2)
    rng = np.random.default_rng(6)
    x, y = rng.random((200, 3)), rng.integers(0, 2, 200)
    trees = boosting.boost(matrix_of(spark, x, y), 2, 3, 6, 2, 0.1, 0.8, 42)
    assert len(trees.steps) == 6 and len({tuple(t.threshold) for step in trees.steps for t in step}) > 4
    drawn = [boosting._drawn(boosting._mixed(np.arange(10_000, dtype=np.uint64)), 42, step, 0.8) for step in range(2)]
    assert all(abs(d.mean() - 0.8) < 0.02 for d in drawn) and (drawn[0] != drawn[1]).mean() > 0.2


def test_cuts_follow_the_rows_of_many_values():
    value = np.arange(1, 2001) / 7
    count = np.ones(2000, np.int64)
    feature, kept, counts = boosting._summary([(np.zeros(2000, np.int32), value, count)] * 2)
    assert len(kept) <= boosting.SUMMARY and counts.sum() == 4000
    found = boosting.edges(feature, kept, counts, 2)
    bins = np.bincount(found.bins(np.zeros(2000, int), value))
    assert found.zero.tolist() == [0, 0] and bins[0] == 0 and 28 <= (bins > 0).sum() <= boosting.BINS and bins.max() < 2 * 2000 / 30


def test_train_model_boosts(spark, monkeypatch):
    """The documented learner and its settings, on all runs."""
    rows = [(i, f"of {'ab'[i % 2]}{'ab'[i % 2]} kind", "ab"[i % 2]) for i in range(60)]
    corpus = spark.createDataFrame(rows, "run_id bigint, text string, label string")
    fit, fitted = TriageClassifier.fit, []

    def short(self, runs):
        fitted.append((self.learner, self.max_iter, self.max_depth, self.step_size, self.subsampling_rate, self.per_label))
        self.max_iter = 3
        return fit(self, runs)

    monkeypatch.setattr(TriageClassifier, "fit", short)
    monkeypatch.setattr(registry, "_runs", lambda *_: corpus)
    monkeypatch.setattr(registry, "table", lambda spark, *_: spark.read.parquet(folder))
    folder = f"{model.checkpoint_dir(spark)}/orders-of-boosting"
    spark.range(1).write.mode("overwrite").parquet(folder)
    got = {r.label: (r.label_idx, r.n_sample, r.n_right, r.n_trees) for r in registry.QUERIES["train_model"](spark, "boosting").collect()}
    assert fitted == [(model.BOOSTED, 200, 5, 0.1, 0.8, None)]
    assert got == {"a": (0, 30, 30, 3), "b": (1, 30, 30, 3)}
