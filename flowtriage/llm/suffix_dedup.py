"""Removal of repeated passages by prefix-partitioned suffix trees.

The suffixes of all documents that can share ``window`` words with another
document are split by variable-length prefixes into groups, and each group is
sorted so that the suffixes below one tree node follow each other.  A node at
depth ``window`` with leaves in several documents is a repeat.

Suffixes are named by hashes of their leading words, made by prefix doubling.
The partitioning prefix is read at an anchor: the least hash of ``anchor``
words among those in the window, so equal windows have equal anchors.  An
anchor that only one document has proves its windows unique; they never leave
their document.  A prefix that would gather more than ``group_rows`` suffixes
is lengthened to the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtriage.llm.common import Remembering, grams, mix

WINDOW = 50
ANCHOR = 24
GROUP_ROWS = 200_000


def split(text: str | None) -> list[bytes]:
    """Words: runs of bytes other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_memory() -> Remembering:
    return Remembering(xxhash.xxh64_intdigest)


def _hashes(words: list[bytes], memory: Remembering) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def _rolling(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over all runs of ``size`` values, by doubling."""
    out, have = values, 1
    while 2 * have <= size:
        out, have = best(out[:-have], out[have:]), 2 * have
    return out if have == size else best(out[: len(values) - size + 1], out[size - have : size - have + len(values) - size + 1])


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of every window."""
    return _rolling(grams(hashes, anchor), window - anchor + 1, np.minimum)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _text_key(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return _signed(digest >> 64), _signed((digest & ((1 << 64) - 1)) | 1)


def _marks(window: int, anchor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = word_memory()
        for batch in batches:
            keys, others, rows = [], [], []
            for i, text in enumerate(batch["text"]):
                words = split(text)
                if len(words) < window:
                    continue
                hashes = _hashes(words, memory)
                found = np.unique(window_anchors(hashes, window, anchor)).view(np.int64)
                one, two = _text_key(hashes)
                keys += [found, np.array([one])]
                others += [np.zeros(len(found), np.int64), np.array([two])]
                rows.append(np.full(len(found) + 1, i))
            if rows:
                at = np.concatenate(rows)
                yield pd.DataFrame(
                    {"key": np.concatenate(keys), "other": np.concatenate(others), "doc_id": batch["doc_id"].to_numpy()[at], "own": batch["own"].to_numpy()[at]}
                )

    return run


def _is_copy(hashes: np.ndarray, doc_id: int, copies) -> bool:
    own = _text_key(hashes)
    return any((c["key"], c["other"]) == own and c["first"] < doc_id for c in copies)


def _suffixes(window: int, anchor: int, group_rows: int):
    """Rows (route, a, b, doc_id, own, at, known) of the suffixes whose windows may repeat.

    (a, b) names the node at depth ``window``.  Of the suffixes of a batch
    below one node only the one in the smallest document goes on to its group;
    the others are known to repeat.  So a passage that many documents share
    sends few rows into its group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = word_memory()
        for batch in batches:
            parts = []
            for doc, own, text, anchors, copies in zip(*(batch[c] for c in ("doc_id", "own", "text", "anchors", "copies"))):
                if anchors is None or not len(anchors):
                    continue
                hashes = _hashes(split(text), memory)
                if _is_copy(hashes, doc, copies):
                    continue
                key = np.fromiter((x["key"] for x in anchors), np.int64, len(anchors))
                many = np.fromiter((x["docs"] for x in anchors), np.int64, len(anchors)) * (window - anchor + 1) > group_rows
                order = np.argsort(key)
                key, many = key[order], many[order]
                of = window_anchors(hashes, window, anchor).view(np.int64)
                place = np.minimum(np.searchsorted(key, of), len(key) - 1)
                at = np.flatnonzero(key[place] == of)
                a = grams(hashes, window)[at].view(np.int64)
                b = grams(mix(hashes, hashes), window)[at].view(np.int64)
                route = np.where(many[place[at]], a, of[at])
                parts.append((route, a, b, np.full(len(at), doc), np.full(len(at), own), at.astype(np.int32)))
            if parts:
                rows = pd.DataFrame(dict(zip(("route", "a", "b", "doc_id", "own", "at"), map(np.concatenate, zip(*parts)))))
                least = rows.groupby(["a", "b"], sort=False)["doc_id"].transform("min")
                rows["known"] = rows["doc_id"] > least
                first = ~rows["known"] & ~rows.duplicated(["a", "b", "doc_id", "own", "at"])
                rows.loc[rows["known"], "route"] = rows["own"]
                yield rows[rows["known"] | first]

    return run


def _repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves below each node that lie in a later document than the node's first; rows come sorted."""
    node, first = None, None
    for batch in batches:
        if batch.empty:
            continue
        known = batch["known"].to_numpy()
        out = [batch.loc[known, ["doc_id", "own", "at"]]]
        rest = batch[~known]
        if len(rest):
            a, b, doc = (rest[c].to_numpy() for c in ("a", "b", "doc_id"))
            fresh = np.ones(len(rest), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            heads = doc[np.maximum.accumulate(np.where(fresh, np.arange(len(rest)), 0))]
            if node == (a[0], b[0]):
                run = int(np.argmax(fresh[1:])) + 1 if fresh[1:].any() else len(rest)
                heads[:run] = first
            node, first = (a[-1], b[-1]), heads[-1]
            out.append(rest.loc[doc > heads, ["doc_id", "own", "at"]])
        yield pd.concat(out)


def _kept(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = word_memory()
        for batch in batches:
            rows = []
            for doc, text, copies, at in zip(*(batch[c] for c in ("doc_id", "text", "copies", "at"))):
                words = split(text)
                kept = words
                if copies is not None and len(copies) and _is_copy(_hashes(words, memory), doc, copies):
                    kept = []
                elif at is not None and len(at):
                    change = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(np.asarray(at))
                    change[starts] += 1
                    np.add.at(change, np.minimum(starts + window, len(words)), -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                joined = b" ".join(kept)
                rows.append((doc, joined.decode("utf-8", "surrogatepass"), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"])
            yield out.astype({"doc_id": "Int64"})

    return run


def _digest(run):
    """The same results without the texts, which need not leave the task then."""

    def slim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out.drop(columns="kept_text")

    return slim


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_rows: int = GROUP_ROWS, texts: bool = True
) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller doc_id.

    A window is ``window`` consecutive words of one document; all are judged
    on the input.  Documents with the very words of a smaller one are settled
    by a hash of the whole (128 bits), windows by 128 bits, too.

    Returns, one row per input row: doc_id, kept_text (unless ``texts`` is
    false), n_words, n_removed, kept_sha256.  Null and empty texts have no
    words.  A null doc_id is neither larger nor smaller than another: its row
    keeps all words and costs no other row any.  Rows with one doc_id are one
    document to each other: they remove nothing from one another.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    marks = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(
        _marks(window, anchor), "key bigint, other bigint, doc_id bigint, own bigint"
    )
    repeated = (
        marks.groupBy("key", "other")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("docs"))
        .where("first < last")
        .drop("last")
    )
    anchor_of = F.when(F.col("other") == 0, F.struct("key", "docs"))
    copy_of = F.when(F.col("other") != 0, F.struct("key", "other", "first"))
    flags = (
        marks.join(repeated, ["key", "other"])
        .groupBy("doc_id", "own")
        .agg(F.collect_list(anchor_of).alias("anchors"), F.collect_list(copy_of).alias("copies"))
    )
    joined = rows.join(flags, ["doc_id", "own"], "left")
    suffixes = joined.mapInPandas(
        _suffixes(window, anchor, group_rows), "route bigint, a bigint, b bigint, doc_id bigint, own bigint, at int, known boolean"
    )
    grouped = suffixes.repartition("route").sortWithinPartitions("a", "b", "doc_id")
    repeats = grouped.mapInPandas(_repeats, "doc_id bigint, own bigint, at int")
    removed = repeats.groupBy("doc_id", "own").agg(F.collect_list("at").alias("at"))
    schema = "doc_id bigint, kept_text string, n_words bigint, n_removed bigint, kept_sha256 string"
    run = _kept(window)
    if not texts:
        run, schema = _digest(run), schema.replace("kept_text string, ", "")
    return joined.join(removed, ["doc_id", "own"], "left").mapInPandas(run, schema)
