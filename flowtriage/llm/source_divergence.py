"""Source divergence audit by factorizing texts into chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtriage.llm.common import bounded_batches, stored, within_bytes

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TERMS_SHOWN = 50

# Bytes of a term: a-z, A-Z and all of characters beyond ASCII.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_FLUSH_WORDS = 1 << 21
_OUT_ROWS = 1 << 16
_CELLS = 1 << 22
_SMALL_GROUPS = 1 << 20

_PARTIAL = "lang string, chunk binary, n_docs int, base bigint, docs binary, sources array<string>, counts binary"
_FACTOR = "lang string, terms array<binary>, times array<bigint>, n_docs bigint, docs array<bigint>, sources array<string>, counts array<bigint>"
_LISTS = {"docs": pa.int64(), "sources": pa.string(), "counts": pa.int64()}


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of 32-bit numbers as bytes, which take less room in a shuffled row than arrays."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(4 * sizes, out=offsets[1:])
    data = np.ascontiguousarray(values, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and list sizes of ``_packed``."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw.copy().view(np.int32), np.diff(offsets) // 4


def _sizes(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(starts, end))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts in sorted rows."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return np.nonzero(fresh)[0]


def _counted(rows: list[tuple], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One row per language and chunk of some documents (number, lang, source, codes of words), and a table of words."""
    *rows, words = rows
    rows.sort(key=lambda r: (r[1], r[2]))
    langs, lang = np.unique(np.array([r[1] for r in rows], object), return_inverse=True)
    sources, source = np.unique(np.array([r[2] for r in rows], object), return_inverse=True)
    number = np.array([r[0] for r in rows], np.int64)
    base = int(number.min())
    owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    keys, times = np.unique(np.concatenate([r[3] for r in rows]).astype(np.int64) * len(rows) + owner, return_counts=True)
    if not len(keys):
        return
    word, doc = keys // len(rows), keys % len(rows)
    by_source = _starts(word, lang[doc], source[doc])
    entry = _starts(word, lang[doc])
    n_docs = _sizes(entry, len(keys))
    listed = np.repeat(n_docs < min_docs, n_docs)
    batch = pa.record_batch(
        {
            "lang": pa.array(langs, pa.string()).take(pa.array(lang[doc[entry]])),
            "chunk": pa.array(words, pa.binary()).take(pa.array(word[entry])),
            "n_docs": pa.array(n_docs, pa.int32()),
            "base": pa.array(np.full(len(entry), base)),
            "docs": _packed(number[doc[listed]] - base, np.where(n_docs < min_docs, n_docs, 0)),
            "sources": _lists(
                pa.array(sources, pa.string()).take(pa.array(source[doc[by_source]])),
                _sizes(np.searchsorted(by_source, entry), len(by_source)),
            ),
            "counts": _packed(np.add.reduceat(times, by_source), _sizes(np.searchsorted(by_source, entry), len(by_source))),
        }
    )
    for at in range(0, batch.num_rows, _OUT_ROWS):
        yield batch.slice(at, _OUT_ROWS)


def _count_chunks(min_docs: int):
    """Count the chunks of each document; documents of a task are combined, some two million words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        rows, size = [], 0
        for batch in batches:
            for number, lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "lang", "source", "text"))):
                chunks = text.split()
                new = codes.setdefault
                found = np.fromiter((new(c, len(codes)) for c in chunks), np.int32, len(chunks))
                rows.append((number, lang, source, found))
                size += len(chunks)
                if size >= _FLUSH_WORDS:
                    yield from _counted([*rows, list(codes)], min_docs)
                    codes, rows, size = {}, [], 0
        if rows:
            yield from _counted([*rows, list(codes)], min_docs)

    return run


def _numbered(batch: pa.RecordBatch) -> pa.Table:
    """Rows with the documents' own numbers, which travel as small distances from the first of their task."""
    (docs, listed), (counts, used) = _unpacked(batch.column("docs")), _unpacked(batch.column("counts"))
    columns = {c: batch.column(c) for c in ("lang", "chunk", "sources")}
    columns["n_docs"] = batch.column("n_docs").cast(pa.int64())
    columns["docs"] = _lists(pa.array(np.repeat(batch.column("base").to_numpy(), listed) + docs), listed)
    columns["counts"] = _lists(pa.array(counts.astype(np.int64)), used)
    return pa.table(columns)


def _merged(table: pa.Table, min_docs: int) -> pa.Table:
    """One row per chunk and language of rows sorted by them."""
    table = table.combine_chunks()
    column = {c: table.column(c).chunk(0) for c in table.column_names}
    chunk, lang = (column[c].dictionary_encode().indices.to_numpy() for c in ("chunk", "lang"))
    starts = _starts(chunk, lang)
    segment = np.repeat(np.arange(len(starts)), _sizes(starts, len(chunk)))
    n_docs = np.add.reduceat(column["n_docs"].to_numpy(), starts)
    listed = pc.list_value_length(column["docs"]).to_numpy()
    kept = n_docs < min_docs
    docs = column["docs"].flatten().filter(pa.array(np.repeat(kept[segment], listed)))
    each = np.repeat(segment, pc.list_value_length(column["sources"]).to_numpy())
    source = column["sources"].flatten().dictionary_encode()
    key = each * max(1, len(source.dictionary)) + source.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    runs = _starts(key[order])
    first = order[runs]
    per = np.bincount(each[first], minlength=len(starts))
    return pa.table(
        {
            "lang": column["lang"].take(pa.array(starts)),
            "chunk": column["chunk"].take(pa.array(starts)),
            "n_docs": pa.array(n_docs),
            "docs": _lists(docs, np.where(kept, np.bincount(segment, listed, len(starts)).astype(np.int64), 0)),
            "sources": _lists(source.dictionary.take(pa.array(source.indices.to_numpy()[first])), per),
            "counts": _lists(pa.array(np.add.reduceat(column["counts"].flatten().to_numpy()[order], runs)), per),
        }
    )


def _factored(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of whole chunks with their terms; each chunk is tokenized once, whatever the number of its languages."""
    chunk = table.column("chunk").combine_chunks().dictionary_encode()
    found = [Counter(_TERM.findall(c.lower())) for c in chunk.dictionary.to_pylist()]
    code = chunk.indices.to_numpy()
    sizes = np.array([len(f) for f in found])[code]
    terms = _lists(pa.array([t for c in code for t in found[c]], pa.binary()), sizes)
    times = _lists(pa.array([n for c in code for n in found[c].values()], pa.int64()), sizes)
    columns = {"lang": table.column("lang").combine_chunks(), "terms": terms, "times": times}
    columns |= {c: table.column(c).combine_chunks() for c in ("n_docs", *_LISTS)}
    out = pa.table(columns).filter(pa.array(sizes > 0)).combine_chunks()
    yield from out.to_batches(max_chunksize=_OUT_ROWS)


def _factor(min_docs: int):
    """Merge rows sorted by chunk and language and attach terms; only the last chunk of a batch is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _numbered(batch)
            rows = _merged(rows if held is None else pa.concat_tables([held.select(rows.column_names), rows.cast(held.select(rows.column_names).schema)]), min_docs)
            code = rows.column("chunk").combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.searchsorted(code, code[-1]))
            held = rows.slice(last)
            if last:
                yield from _factored(rows.slice(0, last))
        if held is not None:
            yield from _factored(held)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text"))


def factors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The distinct chunks of each language with their terms, documents and occurrences by source.

    Chunks are runs between ASCII white space.  They are counted within each
    document, and rows of a task are combined before the one shuffle by chunk.
    There each globally distinct chunk is tokenized once and its terms are
    joined to the rows of its languages: lang, terms and times (its distinct
    terms and how often it holds them), n_docs, docs (the documents themselves
    while there are fewer than ``min_docs``, else empty), sources and counts.
    Chunks without a term are left out.
    """
    bounded_batches(docs.sparkSession)
    rows = _texts(docs).withColumn("text", F.col("text").cast("binary")).withColumn("doc", F.monotonically_increasing_id())
    counted = rows.mapInArrow(_count_chunks(min_docs), _PARTIAL)
    sorted_rows = counted.repartition("chunk").sortWithinPartitions("chunk", "lang")
    return sorted_rows.mapInArrow(_factor(min_docs), _FACTOR).withColumn("terms", F.col("terms").cast("array<string>"))


def kept_terms(table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of the language; ``table`` holds ``factors``.

    The documents of a term are between those of its commonest chunk and the
    sum over its chunks.  Only where ``min_docs`` lies between are distinct
    documents counted, and there each chunk lists all of its documents.
    """
    spread = table.select("lang", F.explode("terms").alias("term"), "n_docs")
    bounds = spread.groupBy("lang", "term").agg(F.max("n_docs").alias("least"), F.sum("n_docs").alias("most"))
    bounds = stored(bounds.where(F.col("most") >= min_docs))
    open_terms = within_bytes(bounds.where(F.col("least") < min_docs).select("lang", "term"))
    listed = table.where(F.size("docs") > 0).select("lang", F.explode("terms").alias("term"), "docs")
    places = listed.join(open_terms, ["lang", "term"], "left_semi").select("lang", "term", F.explode("docs").alias("doc"))
    counted = places.groupBy("lang", "term").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs)
    sure = bounds.where(F.col("least") >= min_docs).select("lang", "term")
    return sure.unionAll(counted.select("lang", "term"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term, in billionths, rounded down, plus one; exact at any size."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    below = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.try_divide(above - above % below, below).cast("bigint") + 1


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of absolute differences of the shares of every two sources, over the terms of a batch."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            base = np.asarray(rows["base"].iloc[0], np.int64)
            width = len(base)
            step = max(1, _CELLS // width)
            total = np.zeros((width, width), np.int64)
            for at in range(0, len(rows), step):
                part = rows.iloc[at : at + step]
                shares = np.tile(base, (len(part), 1))
                owner = np.repeat(np.arange(len(part)), part["places"].map(len))
                shares[owner, np.concatenate(part["places"].tolist())] = np.concatenate(part["shares"].tolist())
                for one in range(width - 1):
                    total[one, one + 1 :] += np.abs(shares[:, one + 1 :] - shares[:, one : one + 1]).sum(axis=0)
            one, two = np.triu_indices(width, 1)
            yield pd.DataFrame({"lang": lang, "one": one, "two": two, "value": total[one, two]})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, terms_shown: int = TERMS_SHOWN) -> DataFrame:
    """How far the vocabulary of each source of ``docs`` (text, lang, source) is from the others of its language.

    Null text, lang and source read as ''.  Terms are runs of letters and of
    characters beyond ASCII, A-Z in lower case; a language keeps those in at
    least ``min_docs`` of its documents (rows).  Each group (lang, source) and
    each language gives a kept term a smoothed share of its occurrences.  Part
    ``pair`` holds, for every other source of the language, the sum over kept
    terms of the absolute differences; part ``term`` the terms that the group
    uses most beyond its language.  A language that keeps no term has pairs of
    value 0 and no terms; an empty table has neither.

    The sources of one language fit one row: the result itself holds all their
    pairs.  Returns lang, source, part, item, value, rank.
    """
    table = stored(factors(docs, min_docs))
    kept = stored(kept_terms(table, min_docs))
    held = table.select("lang", F.explode(F.arrays_zip("terms", "times")).alias("t"), "sources", "counts")
    held = held.select("lang", F.col("t.terms").alias("term"), F.col("t.times").alias("times"), "sources", "counts")
    held = held.join(within_bytes(kept), ["lang", "term"], "left_semi")
    each = held.select("lang", "term", "times", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    uses = each.groupBy("lang", F.col("s.sources").alias("source"), "term").agg(F.sum(F.col("s.counts") * F.col("times")).alias("n"))
    uses = stored(uses)

    groups = _texts(docs).select("lang", "source").distinct()
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(totals, ["lang", "source"], "left").join(n_terms, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), place.alias("place")
    )
    groups = stored(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("n_terms"))))
    small = within_bytes(groups)
    shares = uses.join(small.select("lang", "source", "total", "n_terms", "place"), ["lang", "source"])
    shares = shares.withColumn("share", _share(F.col("n"), F.col("total"), F.col("n_terms")))

    whole = uses.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_totals = within_bytes(groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("n_terms").alias("lang_terms")))
    whole = whole.join(lang_totals, "lang").select(
        "lang", "term", _share(F.col("lang_n"), F.col("lang_total"), F.col("lang_terms")).alias("usual")
    )
    above = shares.join(whole, ["lang", "term"]).where("share > usual")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("usual")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_shown)

    # One row per term with its few sources; the shares of the others are their base.
    lists = F.collect_list(F.struct("place", "share"))
    vectors = shares.groupBy("lang", "term").agg(lists.alias("l")).select(
        "lang", F.col("l.place").alias("places"), F.col("l.share").alias("shares")
    )
    bases = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "base"))).alias("l"))
    bases = bases.select("lang", F.col("l.base").alias("base"))
    vectors = vectors.join(F.broadcast(bases) if groups.count() <= _SMALL_GROUPS else bases, "lang")
    sums = vectors.mapInPandas(_distances, "lang string, one int, two int, value bigint")
    sums = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", F.col("place").alias("here"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("there"))
    pairs = one.join(two, "lang").where("here != there").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.least("here", "there").alias("one"), F.greatest("here", "there").alias("two")
    )
    pairs = pairs.join(sums, ["lang", "one", "two"], "left").select(
        "lang", "source", "part", "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value")
    )
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(above)
