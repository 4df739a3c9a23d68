"""The registered queries on the smallest tables: against their SQL, or against brute force."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from flowtriage.llm import decontaminate, queries, simhash, token_rollup
from test_near_copies import line_groups, roots
from test_selection import edits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")



@pytest.fixture(scope="module")
def documents_rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    expected = Counter(result.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == expected and expected


def test_op1(spark, documents_rows):
    found = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op1_decontaminate"](spark, SF).collect()}
    text = {i: decontaminate.words_of(t) for i, t, *_ in documents_rows}
    items = {i: decontaminate.words_of(t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()}
    held = {(d, i) for d, words in text.items() for i, goal in items.items() if f" {' '.join(goal)} " in f" {' '.join(words)} "}
    assert held and held <= set(found)
    for (doc, item), r in found.items():
        n = len(items[item])
        assert edits(items[item], text[doc][r.position : r.position + n]) == r.distance <= n // 5


def test_op2(spark, documents_rows, monkeypatch):
    """The take-downs and clean-ups, with a counter that plain Python can repeat."""
    monkeypatch.setattr(token_rollup, "byte_pair_counter", lambda *_: lambda c: queries.F.length(queries.F.coalesce(c, queries.F.lit(""))))
    marks = defaultdict(list)
    for doc, quality, toxic in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall():
        marks[doc].append((quality, toxic))
    expected = defaultdict(Counter)
    for doc, text, lang, source in documents_rows:
        if any(t for _, t in marks[doc]):
            continue
        if marks[doc] and min(q for q, _ in marks[doc]) == 0:
            text = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        for version, n in (("byte_bpe_50k", len(text)), ("words", len(text.split()))):
            expected[source, lang, version].update(docs=1, tokens=n)
    got = {(r.source, r.lang, r.tokenizer): {"docs": r.n_docs, "tokens": r.n_tokens} for r in queries.QUERIES["op2_token_rollup"](spark, SF).collect()}
    assert got == {k: dict(v) for k, v in expected.items()}


def test_op6(spark, documents_rows):
    got = queries.QUERIES["op6_pu_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in documents_rows]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_op7(spark, documents_rows):
    expected = line_groups([(i, t) for i, t, *_ in documents_rows])
    got = {r.doc_id: set(r.removed) for r in queries.QUERIES["op7_fuzzy_lines"](spark, SF).collect()}
    assert {i: x for i, x in got.items() if x} == {i: x for i, x in expected.items() if x} and len(got) == len(documents_rows)


def test_op10(spark, documents_rows):
    prints = {i: simhash.fingerprint_of(t) % (1 << 64) for i, t, *_ in documents_rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = roots(set(prints), links)
    got = queries.QUERIES["op10_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", expected[i]) for i, p in prints.items()}
