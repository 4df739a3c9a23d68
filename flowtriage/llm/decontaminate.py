"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from flowtriage.llm.common import Remembering, chunks, cut, grams, mix

SIMILARITY = 0.8
TARGET_RECALL = 0.98
SAMPLED = 3
# Items that these many walks find too seldom, and all longer than this, are searched by exact pieces instead.
MOST_WALKS = 256
WALKED_WORDS = 4096
BLOCK_CHARS = 4_000_000
CHUNK_WORDS = 1 << 19
SLAB = 2048
SLAB_CELLS = 1 << 22
SEED = 20240607

LEAKS = ArrayType(
    StructType([StructField("item_id", LongType()), StructField("distance", IntegerType()), StructField("position", IntegerType())])
)


def normal(word: str) -> str:
    """A word in lower case with letters and digits only, maybe empty."""
    return word.lower() if word.isalnum() else "".join(c for c in word.lower() if c.isalnum())


# Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
)


def raw_words(text: str | None) -> list[str]:
    """What white space parts; of scripts without spaces every character is a word."""
    if not text:
        return []
    return (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, raw_words(text)) if w]


def edit_distances(items: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distances of row pairs; a window's row counts up to its length."""
    pairs, n = windows.shape
    step = np.arange(n + 1, dtype=np.int32)
    row = np.tile(step, (pairs, 1))
    for i in range(items.shape[1]):
        fresh = np.empty_like(row)
        fresh[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != items[:, i : i + 1]), out=fresh[:, 1:])
        row = np.minimum.accumulate(fresh - step, axis=1) + step
    return row[np.arange(pairs), lengths]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo to hi one after the other, and the size of each range."""
    count = hi - lo
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count), count


class Size:
    """The items of one length: their walks, keys and vocabulary."""

    def __init__(self, n: int, limit: int, items: np.ndarray, ids: np.ndarray, codes: np.ndarray, target: float) -> None:
        self.n, self.limit, self.items, self.ids, self.codes = n, limit, items, ids, codes
        self.slab = max(1, min(SLAB, SLAB_CELLS // n))
        self.most = np.zeros(len(codes), np.int32)
        for item in items:
            np.maximum(self.most, np.bincount(item, minlength=len(codes)), out=self.most)
        self.member = (self.most > 0).astype(np.int32)
        self.walks = self._enough(target)
        if not self.walks:
            self._cut_pieces()
            return
        keys = self.embed(items.ravel(), np.arange(len(items)) * n, np.full(len(items), n), self.walks)
        flat = keys.T.ravel()
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], np.repeat(np.arange(len(items)), self.walks)[order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_drawn"}

    def _random(self, walks: int) -> tuple[np.ndarray, np.ndarray]:
        """For each walk its coin multipliers and its sampled positions.

        A walk spells a word about twice, so 2n of the embedding's 3n symbols
        are spelled before its padding on average; samples fall on those.
        """
        if len(self.__dict__.get("_drawn", ((), ()))[0]) < walks:
            coins = np.random.default_rng([SEED, self.n]).integers(0, 1 << 63, (walks, 2 * self.n), np.uint64)
            samples = np.random.default_rng([SEED, self.n, 1]).integers(0, 2 * self.n, (walks, SAMPLED))
            self._drawn = coins * np.uint64(2) + np.uint64(1), np.sort(samples, axis=1)
        return self._drawn

    def embed(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walks: int, skipped: int = 0) -> np.ndarray:
        """Keys (walk, window), but for the first ``skipped`` walks: a hash of the walk's symbols at its sampled positions.

        The random walk of Chakraborty, Goldenberg and Koucky: at every step
        it writes the current symbol and moves on if a coin, which depends on
        step and symbol, says so.  Equal walks see equal coins, so few edits
        give few differing symbols.
        """
        coins, samples = (drawn[skipped:walks] for drawn in self._random(walks))
        at = np.broadcast_to(starts, (len(coins), len(starts))).astype(np.int64)
        ends = starts + lengths
        keys = np.broadcast_to(np.arange(skipped, walks, dtype=np.uint64)[:, None], at.shape).copy()
        last = len(symbols) - 1
        for step in range(int(samples.max()) + 1):
            inside = at < ends
            code = np.where(inside, self.codes[symbols[np.minimum(at, last)]], np.uint64(1))
            for column in range(SAMPLED):
                taken = samples[:, column] == step
                if taken.any():
                    keys[taken] = mix(keys[taken], code[taken])
            with np.errstate(over="ignore"):
                at += inside & ((code * coins[:, step : step + 1]) >> np.uint64(63)).astype(bool)
        return keys

    def _enough(self, target: float) -> int:
        """The walks it takes for edited items at the limit to be found at ``target`` recall, 0 if ``MOST_WALKS`` do not."""
        if not self.limit:
            return 1
        if self.n > WALKED_WORDS:
            return 0
        rng = np.random.default_rng([SEED, self.n, 2])
        copies = []
        for k in range(256):
            item = self.items[k % len(self.items)].tolist()
            for edit in rng.integers(0, 3, self.limit):
                at = int(rng.integers(0, len(item))) if item else 0
                if edit == 0 and item:
                    item[at] = 0
                elif edit == 1:
                    item.insert(at, 0)
                elif item:
                    del item[at]
            copies.append((item + [0] * self.n)[: self.n])
        own, edited = self.items[np.arange(256) % len(self.items)].ravel(), np.array(copies).ravel()
        place, length = np.arange(256) * self.n, np.full(256, self.n)
        found, walks, tried = np.zeros(256, bool), 8, 0
        while True:
            keys = (self.embed(x, place, length, walks, tried) for x in (own, edited))
            found |= np.equal(*keys).any(axis=0)
            if found.mean() >= target:
                return walks
            if walks >= MOST_WALKS:
                return 0
            walks, tried = 2 * walks, walks

    def _cut_pieces(self) -> None:
        """Cut every item into limit + 1 pieces: ``limit`` edits leave one of them whole.

        Pieces are known by their first ``span`` words, so that all have one length.
        """
        self.span = self.n // (self.limit + 1)
        offset = np.arange(self.limit + 1) * self.n // (self.limit + 1)
        at = (np.arange(len(self.items))[:, None] * self.n + offset).ravel()
        keys = grams(self.codes[self.items.ravel()], self.span)[at]
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner, self.offset = np.repeat(np.arange(len(self.items)), len(offset))[order], np.tile(offset, len(self.items))[order]

    def pieced(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) that share a piece, moved by no more than ``limit`` words, once each; no pair within the limit is missed."""
        base = int(starts.min())
        here = grams(self.codes[symbols[base : int((starts + lengths).max())]], self.span)
        spots = np.zeros(len(here) + 1, np.int64)
        whole = lengths >= self.span
        np.add.at(spots, starts[whole] - base, 1)
        np.add.at(spots, (starts + lengths)[whole] - base - self.span + 1, -1)
        place = np.flatnonzero(np.cumsum(spots[:-1]) > 0)
        lo, hi = (np.searchsorted(self.keys, here[place], side) for side in ("left", "right"))
        hit, count = _spread(lo, hi)
        place, item = np.repeat(place, count) + base, self.owner[hit]
        aligned = place - self.offset[hit]
        order = np.argsort(aligned, kind="stable")
        place, item, aligned = place[order], item[order], aligned[order]
        lo, hi = np.searchsorted(aligned, starts - self.limit, "left"), np.searchsorted(aligned, starts + self.limit, "right")
        found = [np.empty(0, np.int64)]
        for a, b in chunks((hi - lo).tolist(), SLAB_CELLS):
            at, count = _spread(lo[a:b], hi[a:b])
            window = np.repeat(np.arange(a, b), count)
            inside = (place[at] >= starts[window]) & (place[at] + self.span <= starts[window] + lengths[window])
            found.append(np.unique(window[inside] * len(self.items) + item[at[inside]]))
        pairs = np.concatenate(found)
        return pairs // len(self.items), pairs % len(self.items)

    def plausible(self, cells: np.ndarray) -> np.ndarray:
        """Whether windows (their symbols by row, -1 behind the end) hold enough of the items' words.

        A word counts as often as some item has it; what is beyond that costs an edit.
        """
        row = np.sort(cells, axis=1)
        column = np.arange(self.n)
        fresh = np.ones(row.shape, bool)
        fresh[:, 1:] = row[:, 1:] != row[:, :-1]
        again = column - np.maximum.accumulate(np.where(fresh, column, 0), axis=1)
        return ((row > 0) & (again < self.most[row])).sum(axis=1) >= self.n - self.limit

    def candidates(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) that share a key, once each."""
        if not self.walks:
            return self.pieced(symbols, starts, lengths)
        keys = self.embed(symbols, starts, lengths, self.walks).ravel()
        window = np.tile(np.arange(len(starts)), self.walks)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owner[np.repeat(lo[found], count) + within]
        pairs = np.unique(np.repeat(window[found], count) * len(self.items) + item)
        return pairs // len(self.items), pairs % len(self.items)

    def leaks(self, symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item_id, distance, start) of the windows of a chunk within the limit.

        ``first`` and ``end`` bound the documents in ``symbols``.  A window
        holds as many words as the items; a shorter document is one window.
        A window within ``limit`` edits has all but that many words from the
        items' words, so others need no embedding.
        """
        known = np.concatenate(([0], np.cumsum(self.member[symbols])))
        starts = np.flatnonzero(known[self.n :] - known[: -self.n] >= self.n - self.limit) if len(symbols) >= self.n else np.empty(0, np.int64)
        doc = np.searchsorted(first, starts, "right") - 1
        whole = starts + self.n <= end[doc] if len(starts) else np.empty(0, bool)
        starts, doc = starts[whole], doc[whole]
        size = end - first
        short = np.flatnonzero((size < self.n) & (size >= self.n - self.limit) & (size > 0))
        short = short[known[end[short]] - known[first[short]] >= self.n - self.limit]
        starts = np.concatenate((starts, first[short]))
        doc = np.concatenate((doc, short))
        column = np.arange(self.n)
        for at in range(0, len(starts), self.slab):
            s, d = starts[at : at + self.slab], doc[at : at + self.slab]
            lengths = np.minimum(self.n, end[d] - s)
            cells = np.where(column < lengths[:, None], symbols[np.minimum(s[:, None] + column, len(symbols) - 1)], -1)
            kept = self.plausible(cells)
            s, d, lengths, cells = s[kept], d[kept], lengths[kept], cells[kept]
            window, item = self.candidates(symbols, s, lengths) if len(s) else (s, s)
            for lo in range(0, len(window), self.slab):
                w, i = window[lo : lo + self.slab], item[lo : lo + self.slab]
                distance = edit_distances(self.items[i], cells[w], lengths[w])
                for k in np.flatnonzero(distance <= self.limit):
                    yield int(d[w[k]]), int(self.ids[i[k]]), int(distance[k]), int(s[w[k]] - first[d[w[k]]])


class Index:
    """A block of benchmark items, ready to be looked up in texts."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float, target: float) -> None:
        texts = [(i, words_of(text)) for i, text in items]
        texts = sorted({(i, tuple(w)) for i, w in texts if i is not None and w})
        self.vocabulary: dict[str, int] = {}
        for _, words in texts:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        codes = np.random.default_rng(SEED).integers(2, 1 << 63, len(self.vocabulary) + 1, np.uint64)
        by_size: dict[int, list] = {}
        for i, words in texts:
            by_size.setdefault(len(words), []).append((i, [self.vocabulary[w] for w in words]))
        self.sizes = [
            Size(n, int(n * (1 - similarity) + 1e-9), np.array([w for _, w in of]), np.array([i for i, _ in of]), codes, target)
            for n, of in sorted(by_size.items())
        ]

    def symbol(self, word: str) -> int:
        """The number of a word, 0 for all words of no item, -1 for an empty one."""
        word = normal(word)
        return self.vocabulary.get(word, 0) if word else -1

    def find(self, texts: list[str | None], symbols: dict) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        for lo, hi in chunks([len(t or "") // 5 + 1 for t in texts], CHUNK_WORDS):
            parts = []
            for text in texts[lo:hi]:
                part = np.fromiter(map(symbols.__getitem__, raw_words(text)), np.int32)
                parts.append(part[part >= 0])
            end = np.cumsum([len(p) for p in parts])
            first, joined = end - [len(p) for p in parts], np.concatenate(parts)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for size in self.sizes if len(joined) else ():
                for doc, item, distance, start in size.leaks(joined, first, end):
                    best[doc, item] = min(best.get((doc, item), (distance, start)), (distance, start))
            for (doc, item), (distance, start) in sorted(best.items()):
                out[lo + doc].append({"item_id": item, "distance": distance, "position": start})
        return out


def leak_columns(benchmark: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> Iterator[tuple]:
    """Functions from a text column to its leaks, one for each block of items, and whether it is the only one.

    The benchmark is the stated query set.  It is cut by hash into blocks of
    about ``BLOCK_CHARS`` characters; every block looks at all texts.  A block
    of several is gone when the next one is asked for, so what the driver and
    the executors hold is bounded however large the set: results must be
    computed before.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(Index([tuple(r) for r in part], similarity, target)))
        yield F.pandas_udf(_lookup(shared), LEAKS), blocks == 1
        if blocks > 1:
            shared.destroy()


def _lookup(shared):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = cloudpickle.loads(shared.value)
        symbols = Remembering(index.symbol)
        for batch in batches:
            yield pd.Series(index.find(list(batch), symbols), dtype=object)

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> DataFrame:
    """Pairs (doc_id, item_id) where a document holds a benchmark item.

    A document leaks an item of n words if one of its windows of n words (the
    whole document if it is shorter) is within floor((1 - similarity) n) word
    edits; items under five words must be there unchanged at the default.
    Words are compared in lower case by letters and digits only, and a
    character of a script without spaces is a word.  Candidates come from the
    embedding at ``target`` recall for items edited up to the limit.  Items so
    long that ``MOST_WALKS`` walks do not reach it are cut into one piece more
    than the limit, of which one must be whole, which misses nothing.  Every
    candidate is verified by its exact edit distance.

    Returns doc_id, item_id, distance (the least), position (its first word).
    Null or empty texts and items leak nothing; repeated rows give repeated
    pairs; an empty table on either side gives no rows.
    """
    out = None
    for find, alone in leak_columns(benchmark, similarity, target):
        rows = docs.select("doc_id", F.explode(find(F.col("text"))).alias("leak")).select("doc_id", "leak.*")
        rows = rows if alone else cut(rows)
        out = rows if out is None else out.unionAll(rows)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    for find, alone in leak_columns(benchmark, similarity):
        docs = docs.where(F.size(find(F.col("text"))) == 0)
        docs = docs if alone else cut(docs)
    return docs
