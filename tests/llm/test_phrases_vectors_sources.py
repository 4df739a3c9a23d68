"""Collocations, the pivot index and the divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage.llm import collocations, pivot_index, source_divergence
from test_near_copies import roots

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id bigint, embedding array<double>"


# --- collocations -----------------------------------------------------------


def phrase_counts(rows):
    """{lang: (number of words, {phrase of up to 4 words: occurrences})}"""
    out = defaultdict(lambda: [0, Counter()])
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            own = out["und" if lang is None else lang]
            own[0] += len(words)
            for k in range(1, 5):
                own[1].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return out


def brute_collocations(rows, least, covered=80, shown=2000):
    out = {}
    for lang, (n, f) in phrase_counts(rows).items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if 100 * most[p] >= covered * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:shown], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n, -score)
    return out


def found_collocations(df):
    return {(r["lang"], r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def repetitive(rng, n):
    """Texts of few words with set phrases, so that paths, ends and covered phrases all occur."""
    phrases = ["New York City hall opens", "state of the art", "in the state of", "a b a b a b a b", "é 漢字 x\x00y"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            parts.append(rng.choice(phrases) if rng.random() < 0.5 else " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))))
            parts.append(rng.choice([" ", ". ", ", ", "\n", "\t", " - "]))
        rows.append((i, "".join(parts), rng.choice(["en", "fr", None]), "s", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_equal_brute_force(documents, seed):
    rows = repetitive(random.Random(seed), 200)
    got = found_collocations(collocations.collocations(documents(*rows).repartition(3), min_count=8))
    assert got == brute_collocations([(r[1], r[2]) for r in rows], 8) and len(got) > 30


def test_paths_are_unary_and_their_edges_are_all_heavy_edges(documents):
    long_phrase = " ".join(f"w{i}" for i in range(25))
    rows = [(i, f"{long_phrase}. x{i} w3 w4 w5 w6 w7", "en", "s", 1) for i in range(12)] + repetitive(random.Random(3), 100)
    edges = collocations.graph(documents(*rows), 8).cache()
    way = collocations.paths(edges, 8).collect()
    heavy = {(r["lang"], r["gram"]): r["n"] for r in edges.where("size = 4 AND n >= 8").collect()}
    read = {(r["lang"], " ".join(r["words"][i : i + 4])): r["n"] for r in way for i in range(len(r["words"]) - 3)}
    assert read == heavy
    assert sum(len(r["words"]) - 3 for r in way) == len(heavy) > len(way)
    # The inner phrase ends pieces of its own, so the long one is cut where that one starts and ends.
    lengths = sorted(len(r["words"]) for r in way if "w0" in r["words"] or "w24" in r["words"])
    assert lengths and max(lengths) < 25


def test_shorter_counts_come_from_flow_and_ends(documents):
    rows = repetitive(random.Random(4), 120)
    counts = collocations.gram_counts(collocations.graph(documents(*rows), 8))
    truth = phrase_counts([(r[1], r[2]) for r in rows])
    for k in (1, 2, 3):
        got = {(r["lang"], r["gram"]): r["n"] for r in counts[k].collect()}
        for lang, (_, f) in truth.items():
            for p, a in f.items():
                if len(p) == k and a >= 8:
                    assert got[lang, " ".join(p)] == a


def test_a_word_that_is_everywhere(documents):
    rows = [(i, "the the the the the the of the", "en", "s", 1) for i in range(50)]
    assert found_collocations(collocations.collocations(documents(*rows))) == brute_collocations([(r[1], "en") for r in rows], 30)


def test_collocations_of_odd_and_empty_tables(odd, no_documents):
    assert collocations.collocations(no_documents).count() == 0
    plain = [(r["text"], r["lang"]) for r in odd.collect()]
    got = collocations.collocations(odd.withColumn("gram", F.lit("x")).withColumn("n", F.lit(1)), min_count=2)
    assert found_collocations(got) == brute_collocations(plain, 2)


def test_products_beyond_64_bits(spark):
    edges = spark.createDataFrame([("en", 0, "", 9 * 10**17), ("en", 2, "a b", 10**17)], "lang string, size int, gram string, n bigint")
    counts = collocations.gram_counts(edges)
    assert {r["gram"]: r["n"] for r in counts[1].collect()} == {"a": 10**17}


# --- source divergence ------------------------------------------------------


def brute_divergence(rows, least, shown=50):
    """{(lang, source, part, item): (value, rank)} of (text, lang, source)."""
    held, uses = defaultdict(set), defaultdict(Counter)
    groups = set()
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = t.translate(ASCII)
            held[lang, t].add(i)
            uses[lang, source][t] += 1
    out = {}
    for lang, source in groups:
        kept = [t for (x, t), docs in held.items() if x == lang and len(docs) >= least]
        share = lambda count: {
            t: 1 + (10**9 * (count[t] + 5)) // (sum(count[u] for u in kept) + 5 * len(kept)) for t in kept
        }
        p = share(uses[lang, source])
        q = share(sum((uses[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                s = share(uses[lang, other])
                pairs.append((-sum(abs(p[t] - s[t]) for t in kept), other.encode()))
        terms = [(q[t] - p[t], t.encode()) for t in kept if uses[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:shown])):
            out |= {(lang, source, part, item.decode()): (-v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


def found_divergence(df):
    return {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in df.collect()}


def test_divergence_equals_brute_force(documents, monkeypatch):
    """Also with tiny flushes, so that chunks and documents meet from many of them."""
    rng = random.Random(5)
    monkeypatch.setattr(source_divergence, "_FLUSH_WORDS", 100)
    words = [f"w{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(60)] + ["Été", "été", "漢字", "a-b", "A,b", "x1y", "It's"]
    weights = [1 / (i + 1) for i in range(len(words))]
    marks = ["", "", ".", ",", "!", "'"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(marks) + w + rng.choice(marks) for w in rng.choices(words, weights, k=rng.randrange(0, 30)))
        rows.append((i, rng.choice([text, text, text.upper(), text.replace(" ", "\n")]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""]), 1))
    expected = brute_divergence([r[1:4] for r in rows], 9)
    assert any(k[2] == "term" for k in expected)
    assert found_divergence(source_divergence.divergence(documents(*rows).repartition(3), min_docs=9)) == expected
    table = source_divergence.factors(documents(*rows).repartition(3), 9)
    kept = {(r["lang"], r["term"]) for r in source_divergence.kept_terms(table, 9).collect()}
    held = defaultdict(set)
    for i, text, lang, *_ in rows:
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            held[lang or "", t.translate(ASCII)].add(i)
    assert kept == {k for k, docs in held.items() if len(docs) >= 9}


def test_chunks_of_a_term_in_the_same_documents_count_once(documents):
    rows = [(i, "foo foo, (foo) Foo", "en", "a", 1) for i in range(5)] + [(9, "bar", "en", "b", 1)]
    kept = lambda n: {r.term for r in source_divergence.kept_terms(source_divergence.factors(documents(*rows), n), n).collect()}
    assert kept(5) == {"foo"} and kept(6) == set()


def test_divergence_of_odd_and_empty_tables(odd, no_documents):
    assert source_divergence.divergence(no_documents).count() == 0
    clashing = odd.withColumns({c: F.lit("x") for c in ("doc", "chunk", "term", "rank", "item", "base", "total")})
    plain = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    for least in (1, 2, 30):
        assert found_divergence(source_divergence.divergence(clashing, min_docs=least)) == brute_divergence(plain, least)


# --- pivot index ------------------------------------------------------------


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def beside(rng, base, cos, n):
    """``n`` vectors at a cosine of ``cos`` to ``base``."""
    z = rng.normal(size=(n, len(base)))
    z = unit(z - np.outer(z @ base, base))
    return cos * base + np.sqrt(1 - cos * cos) * z


def brute_links(rows):
    """{row: (vec_id, n_links, component_id)} by all pairs."""
    links, n = [], Counter()
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = unit(x / np.abs(x).max())
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95:
                links.append((a, b))
                n.update((a, b))
    group = roots(range(len(rows)), links)
    least = defaultdict(list)
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[group[i]].append(vec_id)
    return Counter((vec_id, n[i], min(least[group[i]], default=None)) for i, (vec_id, _) in enumerate(rows))


def found_links(spark, rows):
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(2)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return Counter((r.vec_id, r.n_links, r.component_id) for r in got)


def test_links_equal_brute_force(spark):
    """Tight groups, loose groups that make no ball, copies, scaled copies and vectors near nothing."""
    rng = np.random.default_rng(1)
    vectors = list(unit(rng.normal(size=(150, 32))))
    for cos, n in ((0.999, 40), (0.99, 40), (0.985, 12), (0.98, 12)):
        vectors += list(beside(rng, unit(rng.normal(size=32)), cos, n))
    vectors += [vectors[0]] * 20 + [vectors[1] * 3.5, -vectors[1]]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    got, expected = found_links(spark, rows), brute_links(rows)
    linked = sum(n * c for (_, n, _), c in expected.items())
    lost = linked - sum(n * c for (_, n, _), c in got.items())
    assert linked > 3000 and 0 <= lost <= 0.01 * linked
    assert sum((got & expected).values()) >= 0.97 * len(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at cosines from 0.95 to 0.96, the hardest ones, among vectors near nothing."""
    rng = np.random.default_rng(2)
    base = unit(rng.normal(size=(300, 64)))
    near = np.concatenate([beside(rng, b, rng.uniform(0.9501, 0.96), 1) for b in base])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    found = sum(r.n_links for r in got)
    assert 0.95 * 600 <= found <= 600
    assert all(r.component_id in (r.vec_id, r.vec_id - 300) for r in got)


def test_no_link_below_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = unit(rng.normal(size=(100, 64)))
    below = np.concatenate([beside(rng, b, 0.9499, 1) for b in base])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, below]))]
    assert all(r.n_links == 0 and r.kept for r in pivot_index.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())


def test_balls_hold_only_linked_points():
    rng = np.random.default_rng(4)
    points = np.concatenate([beside(rng, unit(rng.normal(size=16)), c, 30) for c in (0.999, 0.99, 0.98, 0.96)])
    seen = []
    for members, center, radius in pivot_index._balls(points, np.zeros(len(points)), np.arccos(0.95)):
        seen += members.tolist()
        assert (points[members] @ points[members].T).min() >= 0.95
        assert np.arccos(np.clip(points[members] @ center, -1, 1)).max() <= radius + 1e-6
    assert sorted(seen) == list(range(len(points)))


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 2.0, 3.0]
    rows = [(1, a), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, nan, 3.0]), (7, [inf, 2.0, 3.0])]
    rows += [(8, [x * 1e300 for x in a]), (9, [x * 1e-300 for x in a]), (10, a), (10, a), (10, [-1.0, 0.0, 0.0]), (None, a), (None, None)]
    rows += [(11, [1.0, 2.0]), (12, [1.0, 2.0, 3.0, 0.0]), (13, [5.0]), (14, [7.0]), (15, [-7.0]), (-3, [-1.0, 1e-9, 0.0])]
    assert found_links(spark, rows) == brute_links(rows)
    empty = spark.createDataFrame([], VECTORS).withColumn("key", F.lit(1))
    assert pivot_index.near_duplicates(empty).count() == 0
    more = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("node", "key", "ball", "label", "unit")})
    assert pivot_index.near_duplicates(more.withColumn("embedding", F.col("embedding").cast("array<float>"))).count() == len(rows)
