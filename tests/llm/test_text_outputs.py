"""Token rollups, chat trees and the pipeline."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowtriage.llm import chat_trees, decontaminate, pu_classifier, queries, simhash, token_rollup
from flowtriage.llm.common import DOCUMENT_COLUMNS

SMALL = "/root/testdata/sf0.001"


# --- token rollups ----------------------------------------------------------------


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "op string, doc_id bigint, source string, lang string, text string")


@pytest.fixture
def rollup(spark, tmp_path):
    return token_rollup.TokenRollup(spark, str(tmp_path / "rollup"), {"words": token_rollup.word_count, "chars": lambda c: F.length(F.coalesce(c, F.lit("")))})


def test_rollup_equals_a_recount_after_every_batch(spark, rollup):
    rng = random.Random(1)
    state = defaultdict(list)
    for batch in range(4):
        rows = []
        for _ in range(40):
            op = rng.choice(("insert", "insert", "delete", "revise", "ignored"))
            rows.append((op, rng.randrange(25), rng.choice(("a", "b", None)), rng.choice(("en", None)), "w " * rng.randrange(6)))
        assert rollup.apply(f"b{batch}", changes(spark, *rows))
        for doc in {r[1] for r in rows if r[0] in ("delete", "revise")}:
            state[doc] = []
        for op, doc, source, lang, text in rows:
            if op in ("insert", "revise"):
                state[doc].append((source, lang, text))
        expected = Counter()
        for source, lang, text in (x for held in state.values() for x in held):
            for version, n in (("words", len(text.split())), ("chars", len(text))):
                expected[source, lang, version, "docs"] += 1
                expected[source, lang, version, "tokens"] += n
        for found in (rollup.totals(), rollup.recounted()):
            got = Counter()
            for r in found.collect():
                got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
                got[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
            assert +got == +expected


def test_batches_commit_once(spark, rollup, tmp_path):
    rows = changes(spark, ("insert", 1, "a", "en", "x y z"), ("insert", None, None, None, None))
    assert rollup.apply("one", rows) and not rollup.apply("one", rows)
    assert {(r.source, r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {
        ("a", "words", 1, 3), ("a", "chars", 1, 5), (None, "words", 1, 0), (None, "chars", 1, 0)
    }
    again = changes(spark, ("revise", 1, "b", "en", "x y"))
    assert rollup.apply("two", again)
    before = sorted(map(str, rollup.totals().collect()))
    # A try that was lost before its marker does not count, and the next one writes over it.
    (tmp_path / "rollup/totals/batch=two/_SUCCESS").unlink()
    assert {r.source for r in rollup.totals().collect()} == {"a", None}
    assert rollup.apply("two", again)
    assert sorted(map(str, rollup.totals().collect())) == before
    with pytest.raises(ValueError):
        rollup.apply("../x", again)


def test_rollup_of_nothing(spark, rollup):
    assert rollup.totals().count() == 0
    assert rollup.apply("none", changes(spark).limit(0)) and rollup.totals().count() == 0
    assert rollup.apply("unknown", changes(spark, ("delete", 9, None, None, None))) and rollup.totals().count() == 0


def test_byte_pair_counts_equal_the_tokenizer(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello there, it's 42!", "  \n\t x", "é漢\U0001f600", "<|endoftext|>", "long " * 5000]
    count = token_rollup.byte_pair_counter(spark, queries.VOCABULARY, queries.PATTERN)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(count("t")).collect()
    assert [r[0] for r in got] == [len(encoding.encode_ordinary(t or "")) for t in texts]


# --- chat trees --------------------------------------------------------------------

NODES = "tree string, node string, parent string, role string, text string, score double"


def test_best_branches_of_random_trees(spark):
    rng = random.Random(2)
    rows, parent = [], {}
    for tree in "abc":
        for i in range(40):
            up = f"{tree}{rng.randrange(max(0, i - 4), i)}" if i else None
            parent[f"{tree}{i}"] = up
            rows.append((tree, f"{tree}{i}", up, rng.choice(("user", "assistant")), f"t{i}", float(rng.randrange(9))))
    by_id = {r[1]: r for r in rows}
    leaves = sorted(set(by_id) - set(parent.values()))
    paths = {}
    for leaf in leaves:
        path, at = [], leaf
        while at:
            path.append(by_id[at])
            at = parent[at]
        paths[leaf] = path[::-1]
    got = {(r.tree, r.branch): (r.leaf, chat_trees.parse(r.formatted)) for r in chat_trees.format_trees(spark.createDataFrame(rows, NODES), 3).collect()}
    for tree in "abc":
        order = sorted((x for x in leaves if x[0] == tree), key=lambda x: (-sum(n[5] for n in paths[x]), x))
        for rank, leaf in enumerate(order[:3], 1):
            assert got[tree, rank] == (leaf, [(n[3], n[4]) for n in paths[leaf]])
    assert len(got) == 9


def test_orphans_cycles_and_repeated_nodes(spark):
    rows = [
        ("u", "e", "gone", "user", "orphan", None), ("v", "f", "g", "user", "ring", 1.0), ("v", "g", "f", "user", "ring", 1.0),
        ("v", "h", "g", "user", "below the ring", 1.0), ("w", "k", None, None, None, 1.0), ("w", "k", None, None, None, 1.0),
        ("w", None, "k", "user", "no id", 1.0),
    ]
    df = spark.createDataFrame(rows, NODES).withColumns({"leaf": F.lit(1), "branch": F.lit(1), "at": F.lit(1)})
    got = {r.tree: r.formatted for r in chat_trees.format_trees(df).collect()}
    assert got == {"u": "### user: orphan</turn>\n", "w": "### : </turn>\n"}
    assert chat_trees.format_trees(df.limit(0)).count() == 0


TEXTS = ["", None, "###", "####", "#####x", "</turn>", "<</turn>\n", "\\", "\\h##", "\\\\###\\</turn>", "a: b", "### user: x</turn>\n", "\n", "é\U0001f600#"]


def test_every_text_and_role_is_read_back(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(("#", "<", "/turn>", "\\", "h", "l", ":", "é", "</turn>", "### ", "\n")) for _ in range(rng.randrange(12))) for _ in range(150)]
    rows = [(i % 9, i, rng.choice(("user", "assistant", "a:b", "###", None, "\\c")), t) for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, 1, "assistant", "x"), (20, 1, "user", "tie"), (20, 1, "assistant", "tie"), (20, 1, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_trees.format_trees(chat_trees.chains(table.withColumn("node", F.lit(0))))
    got = {r.conv_id: r for r in chat_trees.digests(formatted).collect()}
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_a_long_chain_takes_few_rounds(spark):
    rows = [("t", f"n{i}", f"n{i - 1}" if i else None, "user", str(i), 0.0) for i in range(700)]
    out = chat_trees.format_trees(spark.createDataFrame(rows, NODES)).collect()
    assert [t for _, t in chat_trees.parse(out[0].formatted)] == [str(i) for i in range(700)]


# --- pipeline ----------------------------------------------------------------------


def test_stages_decide_as_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[k] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == list(DOCUMENT_COLUMNS)
    raw = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    text = {r.doc_id: r.text for r in raw}
    model = pu_classifier.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scored = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", model.score(F.col("text")).alias("s"))
    assert {r.doc_id for r in kept[0]} == {r.doc_id for r in scored.collect() if r.s >= 0.5}
    prints = {r.doc_id: simhash.fingerprint_of(r.text) % (1 << 64) for r in kept[0]}
    group = {i: {i} for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    assert {r.doc_id for r in kept[1]} == {min(g) for g in group.values()}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    exact = {i for i in (r.doc_id for r in kept[1]) if any(f" {' '.join(w)} " in f" {' '.join(decontaminate.words_of(text[i]))} " for w in items)}
    assert not exact & {r.doc_id for r in kept[2]}
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]} and len(kept[3]) == len({r.doc_id for r in kept[3]})
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]}
    assert all(r.text == text[r.doc_id] for k in kept for r in kept[k])


def test_stages_take_odd_and_empty_tables(spark, odd, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert out.count() <= odd.count(), name
        assert stage(spark, no_documents, SMALL).count() == 0, name


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(queries.ORACLE) <= names
