"""Quality classifier learnt from trusted positives and unlabelled text.

The non-negative unbiased risk of positive-unlabelled learning, with the
logistic loss, is minimised over all unlabelled documents: each Newton step is
one Spark job that sums gradients and curvature over a table of binned
features.  The class prior comes from the best bin of an earlier fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from flowtriage.session import checkpoint_dir

_SHARES = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8)
_EVEN = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
# Cut points of the measures, in the order of `measures`.
EDGES = {
    "upper_share": _SHARES,
    "digit_share": _SHARES,
    "space_share": (0.05, 0.1, 0.13, 0.15, 0.17, 0.2, 0.25, 0.3, 0.4),
    "symbol_share": _SHARES,
    "stop_share": (0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.1),
    "exclaims_per_word": _SHARES,
    "other_mark_share": _SHARES,
    "beyond_ascii_share": _SHARES,
    "distinct_words": _EVEN,
    "repeats_next": _SHARES,
    "repeated_lines": _EVEN,
    "word_length": (2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),
    "longest_word": (5, 8, 10, 12, 15, 20, 25, 30, 50, 100),
    "words_log2": (0.5, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14),
    "byte_entropy": (1, 2, 2.5, 3, 3.5, 3.75, 4, 4.25, 4.5, 5),
}
_CUTS = [np.array(cuts) for cuts in EDGES.values()]
_OFFSETS = np.cumsum([1] + [len(cuts) + 1 for cuts in EDGES.values()])
WIDTH = int(_OFFSETS[-1])
_OFFSETS = _OFFSETS[:-1]

FIRST_PRIOR = 0.5
# The ridge is this much, and as much again as so many positives outweigh.
RIDGE = 1e-3
RIDGE_ROWS = 4.0
STEPS = 12
TOLERANCE = 1e-4
BINS = 2000
SPAN = 20.0
CONFIDENCE = 0.1
HELD_OUT_PARTS, HELD_OUT_PART = 3, 1

_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~=+_\\/{}[]", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)
_EXCLAIMS = np.frombuffer(b"!?", np.uint8)
_OTHER_MARKS = np.frombuffer(b"\"'()-`", np.uint8)


def measures(text: str | None) -> list[float]:
    """What the classifier sees of a whole text; nulls count as empty texts."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    space = int(counts[9:14].sum() + counts[32])
    share = counts[counts > 0] / size
    return [
        upper / max(1, upper + lower),
        int(counts[48:58].sum()) / size,
        space / size,
        int(counts[_SYMBOLS].sum()) / size,
        int(counts[_STOPS].sum()) / size,
        int(counts[_EXCLAIMS].sum()) / n,
        int(counts[_OTHER_MARKS].sum()) / size,
        int(counts[128:].sum()) / size,
        len(set(words)) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        (len(raw) - space) / n,
        float(max(map(len, words), default=0)),
        float(np.log2(len(words) + 1)),
        float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
    ]


def codes_of(text: str | None) -> bytes:
    """The bin of every measure, one byte each."""
    return bytes(int(np.searchsorted(cuts, value, "right")) for cuts, value in zip(_CUTS, measures(text)))


@F.pandas_udf(BinaryType())
def codes(texts: pd.Series) -> pd.Series:
    return pd.Series([codes_of(t) for t in texts], dtype=object)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read: by the CRC-32 of doc_id as text."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS == HELD_OUT_PART
    return F.coalesce(part, F.lit(False))


def _columns(batch: pd.Series) -> np.ndarray:
    """The column of every measure's bin, by row."""
    packed = np.frombuffer(b"".join(batch), np.uint8).reshape(len(batch), len(EDGES))
    return packed + _OFFSETS


def _steps() -> np.ndarray:
    """Features of a column: it and all lower bins of its measure, so that weights are steps between bins."""
    measure = np.searchsorted(_OFFSETS, np.arange(WIDTH), "right")
    at = np.arange(WIDTH)
    return ((measure[:, None] == measure) & (at <= at[:, None])).astype(float)


_STEPS = _steps()


def _dense(columns: np.ndarray) -> np.ndarray:
    x = _STEPS[columns].sum(axis=1)
    x[:, 0] = 1
    return x


def _logits(weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return weights[0] + (_STEPS @ weights)[columns].sum(axis=1)


def _sums(weights: np.ndarray):
    """Per task: counts, losses, gradients of positives and unlabelled rows, and curvature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 + 3 + 3 * WIDTH + WIDTH * WIDTH)
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.iloc[at : at + 8192]
                columns = _columns(part["codes"])
                x, g, positive = _dense(columns), _logits(weights, columns), part["positive"].to_numpy(bool)
                s = 1 / (1 + np.exp(-g))
                p, u = positive, ~positive
                against = np.logaddexp(0, g)
                heads = [p.sum(), u.sum(), np.logaddexp(0, -g[p]).sum(), against[p].sum(), against[u].sum()]
                curve = (x[u] * (s * (1 - s))[u, None]).T @ x[u]
                total += np.concatenate((heads, x[p].sum(axis=0), s[p] @ x[p], s[u] @ x[u], curve.ravel()))
        yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    return run


def _summed(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    sums = rows.mapInPandas(_sums(weights), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(5 + 3 * WIDTH + WIDTH * WIDTH)
    for at, value in sums.collect():
        out[at] = value
    return out


def _minimise(rows: DataFrame, prior: float, weights: np.ndarray) -> np.ndarray:
    """Newton steps on the non-negative risk; each is one job over all rows."""
    for _ in range(STEPS):
        sums = _summed(rows, weights)
        n_p, n_u, _, against_p, against_u = sums[:5]
        if not n_p or not n_u:
            return weights
        x_p, s_p, s_u = sums[5 : 5 + 3 * WIDTH].reshape(3, WIDTH)
        ridge = RIDGE + RIDGE_ROWS / n_p
        curve = sums[5 + 3 * WIDTH :].reshape(WIDTH, WIDTH) / n_u + ridge * np.eye(WIDTH)
        negative = against_u / n_u - prior * against_p / n_p
        slope = s_u / n_u - prior * s_p / n_p
        if negative >= 0:
            slope = slope - prior * (x_p - s_p) / n_p + ridge * weights
        else:  # the negative class cannot have a risk below zero: undo the overfit first
            slope = -slope
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        weights = weights - step
        if np.abs(step).max() < TOLERANCE:
            break
    return weights


def _histogram(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                g = np.clip(_logits(weights, _columns(batch["codes"])), -SPAN, SPAN)
                yield pd.DataFrame({"bin": ((g + SPAN) / (2 * SPAN) * (BINS - 1)).astype(int), "positive": batch["positive"]})

    return run


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from counts by ascending score.

    Above a score where nearly all rows are positive, the unlabelled rows are
    as many times thinner than the positives as they hold other rows.  The
    best cut has the least upper bound on that ratio.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p = np.cumsum(positive[::-1]) / n_p
    above_u = np.cumsum(unlabelled[::-1]) / n_u
    doubt = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    seen = above_p > 0
    bound = (above_u[seen] + doubt) / above_p[seen]
    best = int(np.argmin(bound))
    return float(np.clip(above_u[seen][best] / above_p[seen][best], 0.01, 0.99))


@dataclass
class Model:
    """Weights of the binned measures; none if there was nothing to learn from."""

    weights: np.ndarray | None
    prior: float | None

    def score_codes(self, column: Column) -> Column:
        """Probability of label 1 from binned measures; 0.5 without weights."""
        if self.weights is None:
            return F.lit(0.5)
        weights = self.weights

        @F.pandas_udf(DoubleType())
        def score(batch: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-_logits(weights, _columns(batch)))) if len(batch) else [], dtype=float)

        return score(column)

    def score(self, text: Column) -> Column:
        return self.score_codes(codes(text))


def binned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, codes, held_out, quality), written once to the shared folder.

    quality is null for held-out and unlabelled rows and where labels of one
    document disagree.  This table is a few bytes a document.
    """
    spark = docs.sparkSession
    agreed = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .select("doc_id", F.when(F.col("quality") == F.col("most"), F.col("quality")).alias("quality"))
    )
    rows = docs.select("doc_id", codes("text").alias("codes"), held_out(F.col("doc_id")).alias("held_out"))
    path = f"{checkpoint_dir(spark)}/pu-{uuid.uuid4().hex}"
    rows.join(agreed, "doc_id", "left").write.parquet(path)
    return spark.read.parquet(path)


def fit_binned(rows: DataFrame) -> Model:
    """Fit on trusted positives (quality 1) and on every row without a usable label.

    The prior is estimated on the half of the rows that the first fit did not
    see, so that learning rows by heart cannot make it too small.
    """
    kept = rows.where("quality IS NULL OR quality = 1").select(
        "codes", F.col("quality").isNotNull().alias("positive"), (F.pmod(F.xxhash64("doc_id", "codes"), F.lit(2)) == 0).alias("half")
    )
    first = _minimise(kept.where("half"), FIRST_PRIOR, np.zeros(WIDTH))
    if not first.any():
        return Model(None, None)
    unseen = kept.where("NOT half").select("codes", "positive")
    counted = unseen.mapInPandas(_histogram(first), "bin int, positive boolean").groupBy("bin", "positive").count()
    by_class = np.zeros((2, BINS))
    for at, positive, count in counted.collect():
        by_class[int(positive), at] = count
    prior = best_bin_prior(by_class[1], by_class[0]) if by_class.any(axis=1).all() else FIRST_PRIOR
    return Model(_minimise(kept, prior, first), prior)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn quality from documents (doc_id, text) and labels (doc_id, quality).

    Only labels outside the held-out part are read, and of those only the
    positives; texts of label 0 are left out.  All unlabelled rows are used,
    none are sampled.  Null texts count as empty ones; rows with a null doc_id
    are unlabelled; without positives or unlabelled rows there is no model and
    every score is 0.5.
    """
    return fit_binned(binned(docs, labels))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``docs`` and score each of its rows: doc_id, held_out, score, predicted."""
    rows = binned(docs, labels)
    score = fit_binned(rows).score_codes(F.col("codes"))
    scored = rows.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
