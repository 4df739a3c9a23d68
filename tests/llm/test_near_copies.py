"""SimHash groups, components, repeated passages and fuzzy lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flowtriage.llm import components, fuzzy_lines, simhash, suffix_dedup


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def prose(rng, n, words=400):
    return " ".join(f"{rng.choice('bcdfg')}{rng.randrange(words)}" for _ in range(n))


def changed(rng, text, n=1):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (5, 4), (4, 5)]
    rng.shuffle(links)
    edges = spark.createDataFrame([*links, (None, 3), (3, None)], "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == roots({x for e in links for x in e if e[0] != e[1]}, links)
    assert components.components(edges.limit(0)).count() == 0


def test_bucket_components_find_links_that_the_star_misses(spark):
    # 1 is near nothing; 2-3 and 3-4 are near: the star around 1 finds no link.
    near = {(2, 3), (3, 4), (10, 11)}
    members = spark.createDataFrame([("x", n) for n in (1, 2, 3, 4)] + [("y", n) for n in (10, 11)] + [("y", 10)], "bucket string, node bigint")
    table = spark.createDataFrame(sorted(near), "a bigint, b bigint")
    got = components.bucket_components(members, lambda pairs: pairs.join(table, ["a", "b"]))
    assert {r.node: r.component for r in got.collect()} == {2: 2, 3: 2, 4: 2, 10: 10, 11: 10}


def test_fingerprint_is_the_majority_of_shingle_bits():
    text = "One  two\tTHREE four\nFÜNF one two three"
    words = ["one", "two", "three", "four", "fÜnf", "one", "two", "three"]
    votes = Counter()
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    expected = sum(1 << b for b, v in votes.items() if 2 * v > len(words) - 2)
    assert simhash.fingerprint_of(text) % (1 << 64) == expected
    assert simhash.fingerprint_of("a B") % (1 << 64) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0


def test_block_keys_meet_for_every_close_pair(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    met = df.select(F.arrays_overlap(simhash.block_keys(F.col("a")), simhash.block_keys(F.col("b"))).alias("met"), simhash.distance(F.col("a"), F.col("b")).alias("d"))
    assert {(r.met, r.d) for r in met.collect()} == {(True, 3)}
    with pytest.raises(ValueError):
        simhash.block_keys(F.col("a"), 3, 3)


def test_simhash_groups_equal_brute_force(spark, documents):
    rng = random.Random(3)
    base = [prose(rng, 300) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for _ in range(120):
        rows.append((len(rows), changed(rng, rng.choice(base[:4]), rng.randrange(3))))
    rows += [(900, None), (901, ""), (902, base[0]), (902, base[0]), (None, base[1])]
    got = simhash.near_duplicates(documents(*rows)).collect()
    prints = [simhash.fingerprint_of(t) for _, t in rows]
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    root = roots(set(prints), links)
    first = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            first[root[p]].append(i)
    expected = Counter((i, p, min(first[root[p]])) for (i, _), p in zip(rows, prints))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_simhash_on_odd_and_empty_tables(odd, no_documents):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r.doc_id: r.component_id for r in rows if r.fingerprint == 0}
    assert empty == {1: 1, 2: 1, 3: 1}
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [-6, 1, 4, 5, 5]


def repeats(rows, n):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for s in range(len(words) - n + 1):
            w = tuple(words[s : s + n])
            if i is not None:
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - n + 1):
            if i is not None and least[tuple(words[s : s + n])] < i:
                gone.update(range(s, s + n))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("group_rows", [suffix_dedup.GROUP_ROWS, 10])
def test_repeated_passages_equal_brute_force(documents, group_rows):
    rng = random.Random(4)
    passages = [prose(rng, rng.randrange(49, 90)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randrange(0, 70)), rng.choice(passages), prose(rng, rng.randrange(0, 30)), rng.choice(passages)]
        rows.append((i * 3 % 80, "  ".join(rng.sample(parts, rng.randrange(1, 5)))))
    rows += [(200 + i, rows[5][1]) for i in range(10)] + [(300, "x " * 200), (301, "x " * 120), (5, rows[9][1]), (302, None), (None, rows[7][1])]
    got = suffix_dedup.remove_repeats(documents(*rows), group_rows=group_rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeats(rows, 50)
    texts = got.where("doc_id = 201").first()
    assert texts.kept_text == "" and texts.n_removed == texts.n_words


def test_repeated_passages_on_odd_and_empty_tables(odd, no_documents):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = suffix_dedup.remove_repeats(odd)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeats(rows, 50)
    assert suffix_dedup.remove_repeats(no_documents).count() == 0


def line_groups(rows):
    def normal(line):
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")

    places = [(i, at, normal(line)) for i, t in rows for at, line in enumerate((t or "").split("\n")) if normal(line)]
    lines = sorted({line for *_, line in places})
    parts = {line: {line[k : k + 8] for k in range(max(1, len(line) - 7))} for line in lines}
    links = [(a, b) for k, a in enumerate(lines) for b in lines[:k] if len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b])]
    root = roots(set(lines), links)
    first, gone = {}, defaultdict(set)
    for i, at, line in sorted(places, key=lambda p: (p[0] is None, p[0] or 0, p[1])):
        if first.setdefault(root[line], (i, at)) != (i, at):
            gone[i].add(at)
    return gone


def test_fuzzy_lines_equal_brute_force(documents):
    rng = random.Random(5)
    base = [prose(rng, 60, 3000) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [rng.choice(base) if rng.random() < 0.5 else prose(rng, 40, 3000) for _ in range(rng.randrange(1, 6))]
        lines = [changed(rng, x) if rng.random() < 0.4 else x for x in lines]
        rows.append((i, "\n".join([*lines, "short", "", "  Short "])))
    got = fuzzy_lines.duplicate_lines(documents(*rows))
    expected = line_groups(rows)
    assert {r.doc_id: set(r.removed) for r in got.collect() if r.removed} == {i: x for i, x in expected.items() if x}


def test_fuzzy_lines_on_odd_and_empty_tables(odd, no_documents, documents):
    rows = fuzzy_lines.duplicate_lines(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.n_lines) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    assert [list(r.removed) for r in rows if r.doc_id is None] == [[0]]
    assert fuzzy_lines.duplicate_lines(no_documents).count() == 0
    texts = fuzzy_lines.without_duplicate_lines(documents((1, "a line here\nb"), (2, "A  line here\nc\n"), (3, None)))
    assert {r.doc_id: r.text for r in texts.collect()} == {1: "a line here\nb", 2: "c\n", 3: None}


def test_bands_catch_pairs_at_the_threshold():
    rng = random.Random(6)
    found = total = 0
    while total < 300:
        a = prose(rng, 50, 9000)
        b = changed(rng, a, 3)
        x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
        if 0.78 <= len(x & y) / len(x | y) <= 0.84:
            one, two = fuzzy_lines.band_keys([a, b])
            total += 1
            found += bool((one == two).any())
    assert found / total > 0.96


@pytest.mark.parametrize("tail", [1, 2, 3, 6])
def test_bands_catch_short_pairs_as_often_as_long_ones(tail):
    """Pairs of 16 to 61 characters at exactly 0.8, which differ in their last ``tail`` characters."""
    rng = random.Random(tail)
    lines = []
    for _ in range(1500):
        start = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(8 * tail + 7))
        lines += [start + "A" * tail, start + "B" * tail]
    parts = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines[:2]]
    assert len(parts[0] & parts[1]) == 0.8 * len(parts[0] | parts[1])
    keys = fuzzy_lines.band_keys(lines)
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() > 0.975


def test_representatives_leave_no_pair_of_similar_texts(documents):
    rng = random.Random(7)
    base = [prose(rng, 130, 9000) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, changed(rng, base[i % 15], rng.randrange(1, 4))) for i in range(45)]
    rows += [(200, "few words"), (201, "Few  words"), (202, "other words"), (203, None), (204, "")]
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append(set(zip(*(words[k:] for k in range(max(1, min(5, len(words))))))))
    prints = [simhash.fingerprint_of(t) for _, t in rows]
    links, missed = [], 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            near = ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 3
            alike = bool(a | b) and len(a & b) >= 0.8 * len(a | b)
            missed += alike and not near
            if near or alike:
                links.append((rows[j][0], rows[i][0]))
    expected = set(roots([i for i, _ in rows], links).values())
    assert missed > 10
    kept = simhash.representatives(documents(*rows), widen=True)
    assert {r.doc_id for r in kept.collect()} == expected
    assert len(expected) < simhash.representatives(documents(*rows)).count()


def test_similar_texts_on_odd_and_empty_tables(odd, no_documents):
    kept = simhash.representatives(odd, widen=True)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [-6, 1, 4, 5, 5]
    assert simhash.representatives(no_documents, widen=True).count() == 0


def shingles_of(line):
    return {line[i : i + fuzzy_lines.SHINGLE] for i in range(max(1, len(line) - fuzzy_lines.SHINGLE + 1))}


def jaccard(a, b):
    x, y = shingles_of(a), shingles_of(b)
    return len(x & y) / len(x | y)


def test_sketches_differ_in_no_more_bits_than_the_lines_in_shingles():
    rng = random.Random(11)
    lines = ["", "abc", "x" * 50] + [prose(rng, rng.randrange(1, 60)) for _ in range(60)]
    lines += [changed(rng, line) for line in lines[3:]]
    counts, words = fuzzy_lines.sketches(lines)
    for a in range(len(lines)):
        assert counts[a] == len(shingles_of(lines[a]))
        for b in range(a):
            bits = sum(int(x ^ y).bit_count() for x, y in zip(words[a], words[b]))
            assert bits <= len(shingles_of(lines[a]) ^ shingles_of(lines[b]))


@pytest.mark.parametrize("compared", [3, 1000])
def test_pairs_across_components_keep_every_similar_pair(spark, monkeypatch, compared):
    monkeypatch.setattr(fuzzy_lines, "MOST_COMPARED", compared)
    rng = random.Random(12)
    frame = "the value of sensor {} in hall {} was read at noon and again at night, then stored as {}"
    lines = list(dict.fromkeys(frame.format(rng.randrange(99), rng.randrange(9), rng.randrange(10**6)) for _ in range(120)))
    lines += list(dict.fromkeys(changed(rng, line) for line in lines[:30]))
    counts, words = fuzzy_lines.sketches(lines)
    signed = words.view("int64")
    schema = "node bigint, other bigint, line string, n int, " + ", ".join(f"s{i} bigint" for i in range(fuzzy_lines.SKETCH))
    rows = [(i, i, line, int(counts[i]), *map(int, signed[i])) for i, line in enumerate(lines)]
    texts = spark.createDataFrame(rows, schema)
    component = {i: 0 if i in (4, 5) else i for i in range(len(lines))}
    rest = spark.createDataFrame([(b, i, component[i]) for b in (1, 2) for i in range(len(lines)) if b == 1 or i < 2], "bucket bigint, node bigint, component bigint")
    got = [(r.a, r.b) for r in fuzzy_lines.across_components(rest, texts).collect()]
    near = {(a, b) for b in range(len(lines)) for a in range(b) if jaccard(lines[a], lines[b]) >= 0.8 and component[a] != component[b]}
    assert near and near <= set(got) and len(got) == len(set(got))
    assert (4, 5) not in got


def test_fuzzy_lines_split_a_very_common_line(documents, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "LINES_PER_COPY", 3)
    shared = "this very line stands in all of the documents of the table"
    rows = [(i, f"{shared}\nown line of number {i * 7919} only") for i in range(20)] + [(50, shared + "s")]
    got = {r.doc_id: r.removed for r in fuzzy_lines.duplicate_lines(documents(*rows)).collect()}
    assert got == {0: []} | {i: [0] for i in range(1, 20)} | {50: [0]}


def test_pairs_of_long_lines_well_under_the_threshold_are_ruled_out_before_texts_are_joined(spark):
    rng = random.Random(14)
    base = prose(rng, 400, 9000)
    lines = [changed(rng, base, 20) for _ in range(24)]
    alike = [jaccard(a, b) for i, a in enumerate(lines) for b in lines[:i]]
    assert 0.5 < min(alike) and max(alike) < 0.74
    counts, words = fuzzy_lines.sketches(lines)
    schema = "node bigint, other bigint, line string, n int, " + ", ".join(f"s{i} bigint" for i in range(fuzzy_lines.SKETCH))
    rows = [(i, i, line, int(counts[i]), *map(int, words.view("int64")[i])) for i, line in enumerate(lines)]
    rest = spark.createDataFrame([(1, i, i) for i in range(len(lines))], "bucket bigint, node bigint, component bigint")
    found = fuzzy_lines.across_components(rest, spark.createDataFrame(rows, schema)).count()
    assert found <= 0.2 * len(alike)


@pytest.mark.parametrize("held", [5, 1 << 21])
def test_members_travel_as_bytes_and_none_of_a_shared_bucket_is_lost(monkeypatch, held):
    rng = random.Random(15)
    lines = [prose(rng, 30, 3000) for _ in range(40)]
    lines += [changed(rng, line) for line in lines[:20]] + lines[5:9]
    nodes = [xxhash.xxh64_intdigest(line) >> 1 for line in lines]
    batches = [
        pa.RecordBatch.from_pydict({"node": pa.array(nodes[i : i + 9], pa.int64()), "line": pa.array(lines[i : i + 9])})
        for i in range(0, len(lines), 9)
    ]
    keys = fuzzy_lines.band_keys(lines).view("int64")
    buckets = defaultdict(set)
    for node, own in zip(nodes, keys):
        for bucket in own.tolist():
            buckets[bucket].add(node)
    expected = {(b, n) for b, own in buckets.items() if len(own) > 1 for n in own}
    monkeypatch.setattr(fuzzy_lines, "DEALT_MEMBERS", 200)
    monkeypatch.setattr(fuzzy_lines, "HELD_MEMBERS", held)
    dealt = sorted((r for b in fuzzy_lines._dealt(iter(batches), 3) for r in b.to_pylist()), key=lambda r: r["part"])
    assert {r["part"] for r in dealt} == {0, 1, 2} and len(dealt) < len(lines)
    schema = pa.schema([("part", pa.int32()), ("buckets", pa.binary()), ("nodes", pa.binary())])
    sent = [pa.RecordBatch.from_pylist(dealt[i : i + 2], schema) for i in range(0, len(dealt), 2)]
    got = [(r["bucket"], r["node"]) for b in fuzzy_lines._shared(iter(sent)) for r in b.to_pylist()]
    assert expected and set(got) == expected
    assert held == 5 or len(got) == len(expected)


def test_counts_by_hash_decide_as_the_sets_of_shingles_do():
    rng = random.Random(16)
    lines = ["", "ab", "ab\0", "abcdefgh", "abcdefghi", "x" * 40, "x" * 50, "abcdefghabcdefgh"]
    for _ in range(40):
        a = prose(rng, rng.randrange(2, 60), 900)
        lines += [a, changed(rng, a, rng.randrange(1, 4))]
    start = "".join(rng.choice("abcdefghij") for _ in range(15))
    lines += [start + "A", start + "B"]  # exactly 0.8
    pairs = [(a, b) for a in lines for b in lines]
    got = fuzzy_lines.similar_pairs(*map(list, zip(*pairs)))
    assert got == [jaccard(a, b) >= 0.8 for a, b in pairs] and sum(got) > len(lines)


def test_texts_are_lower_cased_and_split_once(documents, monkeypatch):
    seen = []
    kept = fuzzy_lines.stored
    monkeypatch.setattr(fuzzy_lines, "stored", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, *a))
    rows = documents((1, "A line of text\nB\t\tb"), (2, "a line OF text"), (3, None)).withColumn("text", F.concat("text", F.lit("")))
    assert {r.doc_id: r.n_lines for r in fuzzy_lines.duplicate_lines(rows).collect()} == {1: 2, 2: 1, 3: 0}
    assert seen[0].count("lower(") == 1 and seen[0].count("split(") == 1
