"""Phrase collocations from a weighted de Bruijn graph of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtriage.llm.common import bounded_batches, cut, mix, stored

LONGEST = 4
MIN_COUNT = 30
SCALE = 2_000_000
COVERED_PERCENT = 80
SHOWN = 2000
NO_LANG = "und"

# At most so many bits (32 MB) say which words and pairs of words are frequent.
FILTER_BITS = 1 << 28
_FLUSH_WORDS = 1 << 20
_OUT_ROWS = 1 << 16
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b"," * len(_BREAKS) + b" ")


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, list[str], np.ndarray]]:
    """Words, their codes in text order, languages and the language of each; code 0 parts pieces and documents."""
    codes: dict[bytes, int] = {b",": 0}
    langs: dict[str, int] = {}
    found, owners, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = text.translate(_TABLE).replace(b",", b" , ").split()
            new = codes.setdefault
            row = np.zeros(len(words) + 1, np.int32)
            row[:-1] = np.fromiter((new(w, len(codes)) for w in words), np.int32, len(words))
            found.append(row)
            owners.append((langs.setdefault(lang, len(langs)), len(row)))
            size += len(row)
            if size >= _FLUSH_WORDS:
                yield list(codes), np.concatenate(found), list(langs), np.repeat(*np.array(owners).T)
                codes, langs, found, owners, size = {b",": 0}, {}, [], [], 0
    if found:
        yield list(codes), np.concatenate(found), list(langs), np.repeat(*np.array(owners).T)


def _hashes(words: list[bytes], code: np.ndarray, langs: list[str], lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: the hash of its word, and of the pair of it and the next, both with the language."""
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[code]
    one = mix(np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in langs), np.uint64, len(langs))[lang], word)
    two = np.zeros(len(code), np.uint64)
    two[:-1] = mix(one[:-1], word[1:])
    return one, two


def _count_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, code, langs, lang in _flushes(batches):
        one, two = _hashes(words, code, langs, lang)
        valid = code != 0
        paired = np.zeros(len(code), bool)
        paired[:-1] = valid[:-1] & valid[1:]
        values, n = np.unique(np.concatenate([one[valid], two[paired]]), return_counts=True)
        for at in range(0, len(values), _OUT_ROWS):
            part = slice(at, at + _OUT_ROWS)
            yield pa.record_batch({"gram": pa.array(values[part].view(np.int64)), "n": pa.array(n[part].astype(np.int64))})


def _frequent(rows: DataFrame, min_count: int) -> np.ndarray:
    """A bitmap over hashes of words and pairs of words; the bit of each frequent one is set.

    Others may share a bit.  The bitmap has 16 bits for a frequent gram, but
    no more than ``FILTER_BITS`` in all, which bounds what is sent.
    """
    counted = rows.mapInArrow(_count_hashes, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = stored(counted.where(F.col("n") >= min_count).select("gram"))
    bits = min(FILTER_BITS, 1 << (16 * max(64, grams.count()) - 1).bit_length())
    place = F.shiftrightunsigned("gram", 64 - (bits.bit_length() - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int"))
    placed = grams.select(place.alias("place"))
    marks = placed.groupBy(F.floor(F.col("place") / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("marks"))
    collected = marks.toPandas()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[collected["at"].to_numpy()] = collected["marks"].to_numpy()
    return out.view(np.uint64)


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _count_grams(shared):
    """Count, for each position of a frequent word, the longest gram of frequent words and pairs that starts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for words, code, langs, lang in _flushes(batches):
            one, two = _hashes(words, code, langs, lang)
            here = (code != 0) & _is_set(bitmap, one)
            n_words = np.bincount(lang[code != 0], minlength=len(langs))
            yield pa.record_batch(
                {"lang": pa.array(langs), "size": pa.array([0] * len(langs), pa.int32()), "gram": pa.array([""] * len(langs)), "n": pa.array(n_words.astype(np.int64))}
            )
            on = np.zeros(len(code) + LONGEST, bool)
            on[: len(code) - 1] = here[:-1] & here[1:] & _is_set(bitmap, two[:-1])
            size = here.astype(np.int32)
            going = here.copy()
            for step in range(LONGEST - 1):
                going &= on[step : step + len(code)]
                size += going
            at = np.nonzero(here)[0]
            padded = np.append(code, np.zeros(LONGEST, code.dtype))
            if not len(at):
                continue
            columns = [lang[at].astype(np.int32), *(np.where(size[at] > k, padded[at + k], 0).astype(np.int32) for k in range(LONGEST))]
            del one, two, on, going, padded
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            fresh = np.zeros(len(at), bool)
            fresh[0] = True
            for c in columns:
                fresh[1:] |= c[1:] != c[:-1]
            first = np.nonzero(fresh)[0]
            n = np.diff(np.append(first, len(at)))
            lang_of, *parts = (c[first] for c in columns)
            sizes = size[at][order][first]
            grams = [b" ".join([words[w] for w in row[:k]]) for row, k in zip(zip(*(p.tolist() for p in parts)), sizes.tolist())]
            names = pa.array(langs).take(pa.array(lang_of))
            for lo in range(0, len(first), _OUT_ROWS):
                part = slice(lo, lo + _OUT_ROWS)
                yield pa.record_batch(
                    {"lang": names[part], "size": pa.array(sizes[part], pa.int32()), "gram": pa.array(grams[part], pa.binary()).cast(pa.string()), "n": pa.array(n[part].astype(np.int64))}
                )

    return run


def graph(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """The edges of the graph and the ends of its pieces: lang, size, gram, n.

    From each place in a piece goes the longest gram of up to four words.  One
    of four is an edge from the node of its first three words to that of its
    last three; a shorter one says that the piece ends there.  A row of size 0
    holds the number of words of a language.

    A phrase that is frequent holds only frequent words and pairs of words.  A
    first pass counts their 64-bit hashes, and pieces are cut between words
    that are no frequent pair (a shared hash or bit cuts less, never more).  So
    each frequent phrase is counted wherever it occurs, while what is shuffled
    are few distinct grams instead of one for every place.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(rows, min_count))
    counted = rows.mapInArrow(_count_grams(shared), "lang string, size int, gram string, n bigint")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _words(first: int, n: int, gram: str = "gram") -> Column:
    """``n`` words of a gram from the ``first``, counted from 1."""
    return F.array_join(F.slice(F.split(gram, " "), first, n), " ")


def gram_counts(edges: DataFrame) -> dict[int, DataFrame]:
    """(lang, gram, n) by number of words, from the flow through the nodes of ``graph``.

    A gram occurs as often as longer ones that begin with it, and once more for
    each piece that ends with it.
    """
    ends = lambda k: edges.where(F.col("size") == k).select("lang", "gram", "n")
    counts = {LONGEST: ends(LONGEST)}
    for k in range(LONGEST - 1, 0, -1):
        flow = counts[k + 1].select("lang", _words(1, k).alias("gram"), "n")
        counts[k] = stored(flow.unionAll(ends(k)).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return counts


def paths(edges: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Unary paths of the edges of weight ``min_count`` or more: lang, words (an array), n.

    A node is unary if one edge comes in, one goes out, and no piece starts or
    ends there: then both have the same weight.  Edges over unary nodes are
    joined by doubling the distance to the first edge of the path, each round
    checkpointed.  Pieces are finite, so a path is no longer than one of them,
    and none is a ring.
    """
    all_edges = edges.where(F.col("size") == LONGEST)
    node = LONGEST - 1
    out = all_edges.groupBy("lang", _words(1, node).alias("node")).agg(F.count("*").alias("n_out"), F.sum("n").alias("w_out"), F.min("gram").alias("next"))
    into = all_edges.groupBy("lang", _words(2, node).alias("node")).agg(F.count("*").alias("n_in"), F.sum("n").alias("w_in"), F.min("gram").alias("previous"))
    # As much goes out as comes in and no piece ends here: so none starts here, either.
    unary = out.join(into, ["lang", "node"]).where((F.col("n_out") == 1) & (F.col("n_in") == 1) & (F.col("w_out") == F.col("w_in")))
    unary = unary.join(edges.where(F.col("size") == node).select("lang", F.col("gram").alias("node")), ["lang", "node"], "left_anti")
    heavy = all_edges.where(F.col("n") >= min_count)
    steps = unary.where(F.col("w_out") >= min_count).select("lang", F.col("next").alias("gram"), F.col("previous").alias("head"))
    state = heavy.join(steps, ["lang", "gram"], "left").select(
        "lang", "gram", "n", F.coalesce("head", "gram").alias("head"), F.col("head").isNotNull().cast("bigint").alias("at")
    )
    state = cut(state)
    moving = True
    while moving:
        known = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("further"), F.col("at").alias("more"))
        state = cut(state.join(known, ["lang", "head"]).select("lang", "gram", "n", F.col("further").alias("head"), (F.col("at") + F.col("more")).alias("at"), (F.col("more") > 0).alias("moved")))
        moving = state.where("moved").limit(1).count() > 0
    last = F.element_at(F.split("gram", " "), -1)
    joined = state.groupBy("lang", "head").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", last.alias("word")))).alias("rest"))
    tail = F.transform(F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))), lambda r: r["word"])
    return joined.select("lang", F.concat(F.split("head", " "), tail).alias("words"), "n")


def candidates(edges: DataFrame, counts: dict[int, DataFrame], min_count: int = MIN_COUNT) -> DataFrame:
    """Frequent phrases of two to four words: lang, gram, size, n.

    Those of four words are read off the paths.  Inside a path each node is
    part of a longer phrase that is just as frequent, so it can be left out:
    such nodes are the inner three words of a path.
    """
    way = stored(paths(edges, min_count))
    windows = way.select("lang", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (LONGEST - 1))).alias("at"))
    four = windows.select("lang", F.array_join(F.slice("words", F.col("at"), LONGEST), " ").alias("gram"), F.lit(LONGEST).alias("size"), "n")
    inner = windows.where("at > 1").select("lang", F.array_join(F.slice("words", F.col("at"), LONGEST - 1), " ").alias("gram"))
    three = counts[3].where(F.col("n") >= min_count).join(inner, ["lang", "gram"], "left_anti")
    two = counts[2].where(F.col("n") >= min_count)
    shorter = [df.select("lang", "gram", F.lit(k).alias("size"), "n") for k, df in ((3, three), (2, two))]
    return four.unionByName(shorter[0]).unionByName(shorter[1])


def _each(df: DataFrame, made: list[Column], *names: str) -> DataFrame:
    return df.select("*", F.explode(F.array(*made)).alias("_made")).select("*", *[F.col(f"_made.{n}").alias(n) for n in names]).drop("_made")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED_PERCENT, shown: int = SHOWN) -> DataFrame:
    """The phrases of ``docs`` (text, lang) that hold together best, by language.

    Texts are put in lower case (A-Z), cut into pieces at ``.,;:!?`` and line
    ends, and into words at blanks and tabs.  Phrases of two to four words that
    occur at least ``min_count`` times within pieces are scored by their
    weakest cut: occurrences of the phrase against those of its two parts.
    One that lies in a longer candidate with at least ``covered`` percent of
    its occurrences is left out.  Null texts are empty, a null lang is 'und';
    rows that repeat count each time; an empty table gives no row.

    Returns lang, rank, phrase, a (occurrences), l, r (of the parts), n (words
    of the language) and score, the first ``shown`` of each language.
    """
    edges = stored(graph(docs, min_count))
    counts = gram_counts(edges)
    found = stored(candidates(edges, counts, min_count))
    parts = counts[1].unionAll(counts[2]).unionAll(counts[3]).where(F.col("n") >= min_count)

    size = F.col("size")
    words = F.split("gram", " ")
    ways = [
        F.struct(F.lit(k).alias("cut"), _words(1, k).alias("first"), F.array_join(F.slice(words, k + 1, LONGEST), " ").alias("rest"))
        for k in range(1, LONGEST)
    ]
    cuts = _each(found, ways, "cut", "first", "rest").where(F.col("cut") < size)
    left = parts.select("lang", F.col("gram").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r"))
    above = F.lit(SCALE).cast("decimal(10,0)") * F.col("n").cast("decimal(20,0)")
    below = (F.col("l") + F.col("r")).cast("decimal(20,0)")
    score = F.try_divide(above - above % below, below).cast("bigint")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    best = scored.groupBy("lang", "gram", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    spans = [F.struct(F.lit(first + k - 1).alias("until"), _words(first, k).alias("inside")) for k in range(2, LONGEST) for first in range(1, LONGEST - k + 2)]
    inside = _each(found.where(size > 2), spans, "until", "inside").where((F.col("until") <= size) & (F.col("inside") != F.col("gram")))
    longer = inside.groupBy("lang", F.col("inside").alias("gram")).agg(F.max("n").alias("most"))
    kept = best.join(longer, ["lang", "gram"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * covered))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    ranked = kept.select(
        "lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")
    ).withColumn("rank", rank)
    totals = edges.where(size == 0).select("lang", F.col("n").alias("total"))
    top = ranked.where(F.col("rank") <= shown).join(totals, "lang")
    return top.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
