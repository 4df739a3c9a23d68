"""Decontamination, certified rules, budget mixing, interleaving and the classifier."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage.llm import budget_mix, decontaminate, interleave, pu_classifier, risk_rules
from flowtriage.llm.running import running

SMALL = "/root/testdata/sf0.01"


# --- decontamination ----------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def leaked(rows, items):
    out = Counter()
    for doc, text in rows:
        words = decontaminate.words_of(text)
        for item, content in items:
            goal = decontaminate.words_of(content)
            n = len(goal)
            if item is None or not n or not words:
                continue
            starts = range(max(1, len(words) - n + 1))
            best = min((edits(goal, words[s : s + n]), s) for s in starts)
            if best[0] <= n // 5:
                out[doc, item, *best] += 1
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([f"z{rng.randrange(99)}"], [words[at], f"z{rng.randrange(99)}"], []))
    return words


def test_leaks_equal_brute_force(documents, benchmark_items):
    rng = random.Random(1)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400))}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(25)] + [(30, "too short"), (31, None), (None, "a b c d e f")]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randrange(60))]
        if i % 2:
            at = rng.randrange(len(words) + 1)
            goal = items[rng.randrange(25)][1].split()
            words[at:at] = edited(rng, goal, rng.randrange(0, len(goal) // 5 + 2))
        rows.append((i, " ".join(w.upper() + rng.choice(("", ",", "!?")) for w in words)))
    rows += [(200, None), (201, ""), (202, "w1 " * 500), (None, items[3][1]), (203, items[4][1]), (203, items[4][1])]
    found = Counter(tuple(r) for r in decontaminate.leaks(documents(*rows), benchmark_items(*items)).collect())
    expected = leaked(rows, items)
    assert not found - expected
    assert found.total() >= 0.95 * expected.total() and expected.total() > 40
    exact = {k for k in expected if k[2] == 0}
    assert exact <= set(found)


def test_short_items_and_scripts_without_spaces(documents, benchmark_items):
    items = [(1, "forty-two"), (2, "Paris, of course"), (3, "one two three four"), (4, "東京は日本の首都であり世界最大の都市圏です"), (5, "ภาษาไทยไม่มีช่องว่าง"), (6, " -- ")]
    rows = [
        (1, "the answer is FortyTwo."), (2, "it is paris of course!"), (3, "paris of the course"), (4, "zero one two three four five"), (5, "one two four three"),
        (6, "これは、東京は日本の首都であり世界最小の都市圏です。はい"), (7, "東京は大きい"), (8, "x ภาษาไทยไม่มีช่องว่าง y"), (9, "-- --"), (10, "4x2"), (11, "東京 は日本の 首都であり世界最大の都市圏です"),
    ]
    found = Counter(tuple(r) for r in decontaminate.leaks(documents(*rows), benchmark_items(*items)).collect())
    assert found == leaked(rows, items)
    assert {(r[0], r[1]) for r in found} == {(1, 1), (2, 2), (4, 3), (6, 4), (8, 5), (11, 4)}


def test_pieces_miss_nothing(documents, benchmark_items, monkeypatch):
    """Where no number of walks is enough the exact way gives the brute-force rows."""
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 8)
    rng = random.Random(7)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60))}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 45)))) for i in range(25)] + [(40, "a " * 30), (41, "a b " * 12)]
    rows = [(300, "a " * 90), (301, "b a " * 40), (302, "a " * 25), (303, None), (304, "")]
    for i in range(120):
        words = [word() for _ in range(rng.randrange(40))]
        goal = items[rng.randrange(len(items))][1].split()
        words[rng.randrange(len(words) + 1) : 0] = edited(rng, goal, rng.randrange(0, len(goal) // 5 + 2)) if len(goal) > 4 else goal
        rows.append((i, " ".join(words)))
    found = Counter(tuple(r) for r in decontaminate.leaks(documents(*rows), benchmark_items(*items), target=1.1).collect())
    assert found == leaked(rows, items) and found.total() > 100


@pytest.mark.parametrize("n", [300, 1000, 4200])
def test_long_items_are_found_at_the_limit(n):
    rng = random.Random(n)
    items = [(i, " ".join(f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(n))) for i in range(3)]
    index = decontaminate.Index(items, 0.8, 0.98)
    texts, planted = [], set()
    for k in range(3 if n > 1000 else 30):
        words = items[k % 3][1].split()
        for at in rng.sample(range(n), n // 5):
            words[at] = rng.choice((f"w{rng.randrange(3000)}", "unknown"))
        texts.append(" ".join([f"w{rng.randrange(3000)}" for _ in range(rng.randrange(50))] + words + ["end"] * rng.randrange(9)))
        planted.add((k, k % 3))
    found = {(d, leak["item_id"]) for d, leaks in enumerate(index.find(texts, decontaminate.Remembering(index.symbol))) for leak in leaks}
    assert found <= planted and len(found) >= 0.98 * len(planted)


def test_leaks_in_blocks_are_the_same(documents, benchmark_items, monkeypatch):
    rows = [(i, f"start{i} one two three four five six{i} seven") for i in range(6)]
    items = [(i, f"one two three four five six{i}") for i in range(6)]
    whole = set(map(tuple, decontaminate.leaks(documents(*rows), benchmark_items(*items)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert set(map(tuple, decontaminate.leaks(documents(*rows), benchmark_items(*items)).collect())) == whole
    assert len(whole) == 36 and {r[2] for r in whole} == {0, 1}
    assert decontaminate.without_leaks(documents(*rows, (9, "nothing of it in here")), benchmark_items(*items)).count() == 1


def test_leaks_on_odd_and_empty_tables(odd, no_documents, benchmark_items):
    items = benchmark_items((1, "Alpha, beta gamma delta EPSILON zeta"), (1, "Alpha, beta gamma delta EPSILON zeta"))
    assert sorted(str(r.doc_id) for r in decontaminate.leaks(odd, items).collect()) == ["5", "5", "None"]
    kept = decontaminate.without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.leaks(no_documents, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0


# --- certified rules ------------------------------------------------------------


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = defaultdict(list)
    for i in range(len(words) - 7):
        runs[tuple(words[i : i + 8])].append(i)
    covered = {k + d for at in runs.values() if len(at) > 1 for k in at for d in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark, documents):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "\n\n \x0b\n"), (3, "a b c d e f g h"), (4, " a b c"), (5, "x " * 40)]
    for i in range(80):
        words = [rng.choice("abc#<é") * rng.randrange(1, 4) for _ in range(rng.randrange(60))]
        rows.append((10 + i, "".join(w + rng.choice((" ", "  ", "\n", "\t", "\r\n", "\n\n")) for w in words * rng.randrange(1, 3))))
    got = risk_rules.counts(documents(*rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[c] for c in names) for r in got} == {i: base_counts(t) for i, t in rows}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 90), (3, 100), (2, 59), (20, 1000), (400, 10000), (10, 100), (0, 1)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    got = [r[0] for r in df.select(risk_rules.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect()]
    for (k, n), value in zip(cases, got):
        exact = sum(math.comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) if n < 2000 else None
        if k >= n * 0.05:
            assert value == 1.0
        elif exact is not None:
            assert value == pytest.approx(exact, rel=1e-9)
        else:
            assert 0 < value < 0.01


def test_levels_are_certified_per_stratum_and_stop_at_the_first_failure(spark):
    rows = [("en", 6)] * 400 + [("en", 3)] * 60 + [("de", 6)] * 60 + [("fr", 6)] * 400 + [("fr", 2)] * 3
    good = spark.createDataFrame(rows, "stratum string, level int")
    assert {r.stratum: r.chosen for r in risk_rules.certified(good).collect()} == {"en": 2, "de": -1, "fr": 5}
    assert risk_rules.certified(good.limit(0)).count() == 0


def test_risk_is_kept_over_many_draws():
    """The chance that a bad level is certified stays within the error."""
    rng = np.random.default_rng(3)
    n, limit = 500, 0.05
    draws = rng.binomial(n, risk_rules.RISK * 1.001, 4000)
    tail = np.cumsum([math.comb(n, i) * risk_rules.RISK**i * (1 - risk_rules.RISK) ** (n - i) for i in range(60)])
    assert np.mean(tail[np.minimum(draws, 59)] <= limit) <= limit * 1.2


def test_verdicts_reject_marked_junk_and_keep_clean_texts(spark, documents, labels):
    rng = random.Random(4)
    clean = [(i, " ".join(f"word{rng.randrange(5000)}" for _ in range(60))) for i in range(700)]
    junk = [(i, " ".join(f"wo{rng.randrange(5000)}***" for _ in range(60))) for i in range(1000, 1200)]
    marked = [(i, 1, 0) for i, _ in clean[:400]] + [(i, 0, 0) for i, _ in junk[:50]] + [(clean[0][0], 0, 0), (None, 1, 0), (7, None, 1)]
    rows = {r.doc_id: r for r in risk_rules.verdicts(documents(*clean, *junk), labels(*marked)).collect()}
    assert all(rows[i].kept for i, _ in clean) and not any(rows[i].kept for i, _ in junk)
    assert not any(r.base_failed for r in rows.values())


def test_verdicts_on_odd_and_empty_tables(odd, no_documents, labels):
    none = labels()
    rows = risk_rules.verdicts(odd, none).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: (r.base_failed, r.kept) for r in rows if r.doc_id in (1, 4)} == {1: (True, False), 4: (True, False)}
    assert all(r.base_failed for r in rows if r.doc_id in (1, 2, 3))
    assert risk_rules.verdicts(no_documents, none).count() == 0


# --- running sums, interleaving, mixing -------------------------------------------


def test_running_sums_over_buckets(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", i * 7919 % 64 // 8, i * 7919 % 64, rng.randrange(9)) for i in range(64)]
    df = spark.createDataFrame(rows, "g string, b int, o int, v bigint")
    for r in running(df, ["g"], "b", ["o"], "v", "before", "total").collect():
        assert r.before == sum(v for g, _, o, v in rows if g == r.g and o < r.o)
        assert r.total == sum(v for g, *_, v in rows if g == r.g)


def test_every_shard_has_the_mixture(spark, documents):
    rng = random.Random(6)
    sizes = {"big": 1500, "mid": 400, "tiny": 7, None: 60}
    rows = [(i, f"t {rng.randrange(10**6)}", "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    small = [(5000 + i, "é", "en", f"only{i}", 1) for i in range(120)]
    few = interleave.interleave(documents(*rows), shards=20).collect()
    for source, n in sizes.items():
        held = Counter(r.shard for r in few if r.source == source)
        assert all(abs(held[s] - n / 20) <= 2 for s in range(20))
    rows += small
    got = interleave.interleave(documents(*rows), shards=20).collect()
    shards = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(shards) == set(range(20)) and max(shards.values()) - min(shards.values()) <= 1
    assert max(Counter(r.shard for r in got if (r.source or "").startswith("only")).values()) < 25
    for s in range(20):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(shards[s]))
    assert all(r.size == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in got)
    again = interleave.interleave(documents(*rows[::-1]), shards=20).collect()
    place = lambda out: Counter((r.doc_id, r.shard, r.slot) for r in out)
    assert place(again) == place(got)
    assert place(interleave.interleave(documents(*rows), shards=20, seed=1).collect()) != place(got)


def test_interleave_on_odd_and_empty_tables(odd, no_documents):
    rows = interleave.interleave(odd, shards=4).collect()
    assert len(rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(16, 0)}
    assert sorted(Counter(r.shard for r in rows).values()) == [2, 2, 2, 3]
    assert interleave.interleave(no_documents).count() == 0
    with pytest.raises(ValueError):
        interleave.interleave(odd, shards=0)


def filled(budget, children):
    """Water-filling by repeatedly handing out what is left; {name: (weight, capacity)}."""
    got = dict.fromkeys(children, 0.0)
    left = min(budget, sum(c for w, c in children.values() if w))
    while left > 1e-9:
        open_ = {k for k, (w, c) in children.items() if w and c - got[k] > 1e-9}
        total = sum(children[k][0] for k in open_)
        step = {k: min(left * children[k][0] / total, children[k][1] - got[k]) for k in open_}
        for k, s in step.items():
            got[k] += s
        left -= sum(step.values())
    return got


def test_shortages_go_to_siblings_before_ancestors(spark):
    rng = random.Random(7)
    tokens = {(d, lang, s): rng.choice((0, 5, 40, 300, 5000)) for d in "pqr" for lang in "xy" for s in "stuv" if rng.random() < 0.8}
    weights = {"domain": {"p": 5, "q": 1}, "lang": {"x": 3}, "source": {"s": 7, "u": 2, "v": 0}}
    leaves = spark.createDataFrame([(f"={d}", f"={lang}", f"={s}", n) for (d, lang, s), n in tokens.items()], "_domain string, _lang string, _source string, tokens bigint")
    got = {(r[0][1:], r[1][1:], r[2][1:]): r.allotted for r in budget_mix.budgets(leaves, weights, 70, 2).collect()}
    weight = lambda level, name: weights[level].get(name, 1)
    cap = {k: 2 * n if weight("source", k[2]) else 0 for k, n in tokens.items()}

    def descend(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        level = budget_mix.LEVELS[len(prefix)]
        names = {k[len(prefix)] for k in tokens if k[: len(prefix)] == prefix}
        children = {n: (weight(level, n), sum(c for k, c in cap.items() if k[: len(prefix) + 1] == (*prefix, n))) for n in names}
        out = {}
        for n, b in filled(budget, children).items():
            out |= descend((*prefix, n), b)
        return out

    expected = descend((), sum(tokens.values()) * 70 // 100)
    assert set(got) == set(expected)
    for k, b in expected.items():
        assert b - 8 <= got[k] <= b + 1e-6 or got[k] == pytest.approx(b, abs=8)
    assert sum(got.values()) <= sum(tokens.values()) * 70 // 100


def test_mix_draws_prefixes_of_seeded_epochs(spark, documents):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(("en", "de", None)), f"src{min(rng.randrange(9), rng.randrange(9))}", 0) for i in range(500)]
    docs = documents(*rows)
    got = budget_mix.mix(docs).collect()
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    drawn, held = Counter(), Counter()
    for r in got:
        drawn[r.domain, r.lang, r.source] += r.n_tokens
        assert r.n_tokens == tokens[r.doc_id] and r.epoch < budget_mix.MAX_EPOCHS
    names = {s: r.domain for r in got for s in [r.source]}
    for i, _, lang, source, _ in rows:
        if source in names:
            held[names[source], lang, source] += tokens[i]
    whole = sum(tokens.values()) * budget_mix.BUDGET_PERCENT // 100
    assert 0.93 * whole <= sum(drawn.values()) <= whole
    per_row = defaultdict(set)
    for r in got:
        per_row[r.doc_id].add(r.epoch)
    assert all(e == set(range(len(e))) for e in per_row.values())
    by_leaf = defaultdict(list)
    for r in got:
        by_leaf[r.domain, r.lang, r.source].append(r)
    for leaf, out in by_leaf.items():
        full = max(r.epoch for r in out)
        for e in range(full):
            assert sum(r.n_tokens for r in out if r.epoch == e) == held[leaf]
    assert Counter(map(tuple, got)) == Counter(map(tuple, budget_mix.mix(docs.orderBy("text")).collect()))


def test_mix_on_odd_and_empty_tables(odd, no_documents):
    rows = budget_mix.mix(odd, budget_percent=400, max_epochs=1).collect()
    assert {str(r.doc_id) for r in rows} == {"-6", "4", "5", "None"}
    assert all(r.epoch == 0 for r in rows)
    assert budget_mix.mix(no_documents).count() == 0
    assert budget_mix.mix(odd, budget_percent=0).count() == 0


# --- classifier -------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs, marks = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = pu_classifier.scores(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, marks = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = marks.withColumn("quality", F.when(pu_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (pu_classifier.fit(docs, x).weights for x in (marks, turned))
    assert np.allclose(one, two)


def test_best_bin_prior_recovers_the_share():
    rng = np.random.default_rng(9)
    bins = np.arange(101) - 0.5
    positive = np.histogram(rng.normal(70, 8, 20000), bins)[0]
    mixed = np.histogram(np.concatenate((rng.normal(70, 8, 14000), rng.normal(30, 8, 6000))), bins)[0]
    assert pu_classifier.best_bin_prior(positive, mixed) == pytest.approx(0.7, abs=0.03)


def test_measures_of_odd_texts():
    for text in (None, "", " \n", "a", "\U0001f600" * 5, "é" * 100_000, "x " * 100_000):
        values = pu_classifier.measures(text)
        assert len(values) == len(pu_classifier.EDGES) and all(math.isfinite(v) for v in values)
        assert len(pu_classifier.codes_of(text)) == len(pu_classifier.EDGES)
    assert pu_classifier.codes_of(None) == pu_classifier.codes_of("")


def test_classifier_on_odd_and_empty_tables(odd, no_documents, labels):
    rows = pu_classifier.scores(odd, labels((5, 1, 0), (4, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 0))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    unlearnt = pu_classifier.scores(odd, labels()).collect()
    assert {(r.score, r.predicted) for r in unlearnt} == {(0.5, 1)}
    assert pu_classifier.scores(no_documents, labels((1, 1, 0))).count() == 0
