"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from flowtriage.llm import budget_mix, collocations, interleave, risk_rules, source_divergence, suffix_dedup

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"


def _op3() -> str:
    # Each # that two more follow is escaped: a run of n >= 3 has n - 2 of them, each one character longer.
    grown = (
        r"(length({0}) - length(replace({0}, '\', '')) + length({0}) - length(replace({0}, '</turn>', '</turn'))"
        r" + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda r: length(r) - 2)), 0))"
    )
    return rf"""
WITH both_tables AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM both_tables
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss,
    sum(4 + length(role) + {grown.format("role")} + length(role) - length(replace(role, ':', '')) + 2
        + length(text) + {grown.format("text")} + 8) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined"""


def _op4() -> str:
    first = []
    for name, cutoffs in risk_rules.RULES.items():
        first.append("(" + " + ".join(f"CASE WHEN {name} <= {c!r} THEN 1 ELSE 0 END" for c in cutoffs) + ")")
    tally = ", ".join(f"count(*) FILTER (WHERE level <= {t}) AS k{t}" for t in range(risk_rules.LEVELS))
    p = risk_rules.RISK
    tail = (
        "CASE WHEN {k} < n * {p} THEN list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1)"
        " - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) ELSE 1.0 END"
    )
    tests = " ".join(
        f"WHEN {tail.format(k=f'k{t}', p=p)} > {risk_rules.ERROR} / strata THEN {t - 1}" for t in range(risk_rules.LEVELS)
    )
    run, percent = risk_rules.RUN, risk_rules.REPEAT_PERCENT
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), runs AS (
  SELECT rid, i, array_to_string(words[i:i + {run - 1}], ' ') AS h
  FROM (SELECT rid, words, unnest(range(1, len(words) - {run - 2})) AS i FROM w WHERE len(words) >= {run})
), starts AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT rid, sum(least({run}, after - i)) AS n_repeat_words
  FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + {run}) AS after FROM starts) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), c AS (
  SELECT doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters,
    len(regexp_extract_all(text, '!')) AS n_exclaims
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
), v AS (
  SELECT *,
    CASE WHEN word_chars > 0 THEN CAST(n_symbols AS DOUBLE) / word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_letters > 0 THEN CAST(n_upper AS DOUBLE) / n_letters ELSE 0 END AS upper_share,
    CASE WHEN n_words > 0 THEN CAST(n_exclaims AS DOUBLE) / n_words ELSE 0 END AS exclaims_per_word,
    CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words ELSE 0 END AS word_length,
    n_words < {risk_rules.MIN_WORDS} OR 100 * n_repeat_words > {percent} * n_words AS base_failed
  FROM c
), j AS (SELECT *, least({", ".join(first)}) AS level FROM v
), trusted AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), tally AS (
  SELECT coalesce(lang, '') AS stratum, lang IS NULL AS missing, count(*) AS n, {tally}
  FROM j JOIN trusted USING (doc_id) WHERE NOT base_failed GROUP BY ALL
), chosen AS (
  SELECT stratum, missing, CASE {tests} ELSE {risk_rules.LEVELS - 1} END AS chosen
  FROM (SELECT *, count(*) OVER () AS strata FROM tally))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND level > coalesce(chosen, -1) AS kept, CAST(level AS INTEGER) AS broken_level
FROM j LEFT JOIN chosen ON coalesce(j.lang, '') = stratum AND (j.lang IS NULL) = missing"""


def _op5() -> str:
    seed, shards = interleave.SEED, interleave.SHARDS
    return rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS crcs
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
), bytes AS (
  SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), sums AS (
  SELECT doc_id, source, n + {interleave.ROW_BYTES} AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table
), ordered AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
    md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', CAST(text_crc32 AS VARCHAR))) AS o
  FROM sums
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, size) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM ordered
), placed AS (
  SELECT *, (r + CAST(CAST('0x' || substr(md5(concat('{seed}:', s)), 1, 5) AS BIGINT) AS DOUBLE) / 1048576) / n AS fraction FROM ranked
), dealt AS (SELECT *, row_number() OVER (ORDER BY fraction, s, o, size) - 1 AS place, count(*) OVER () AS total FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST((place * {shards}) // total AS INTEGER) AS shard,
  CAST(place - (((place * {shards}) // total) * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt"""


def _weight(level: str) -> str:
    weights = budget_mix.WEIGHTS.get(level, {})
    cases = " ".join(f"WHEN '={name}' THEN {max(0, weight)}" for name, weight in weights.items())
    return f"CAST(CASE {level[0]} {cases} ELSE 1 END AS HUGEINT)" if cases else "CAST(1 AS HUGEINT)"


def _share(nodes: str, parent: str, name: str) -> str:
    """Water-filling of one level, as the operator does it."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT *, CASE WHEN is_full THEN capacity ELSE (weight * (spend - taken)) // heavy END AS allotted FROM (
    SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({by}), 0) AS taken,
      coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}), 0) AS heavy FROM (
      SELECT *, capacity * (all_weight - coalesce(weight_before, 0)) <= weight * (spend - coalesce(spent_before, 0)) AS is_full FROM (
        SELECT *, least(budget, sum(capacity) OVER ({by})) AS spend, sum(weight) OVER ({by}) AS all_weight,
          sum(weight) OVER before AS weight_before, sum(capacity) OVER before AS spent_before
        FROM ({nodes})
        WINDOW before AS ({by} ORDER BY CASE WHEN weight > 0 THEN CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE) ELSE 0 END, {name}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""


def _op8() -> str:
    epochs, percent, seed = budget_mix.MAX_EPOCHS, budget_mix.BUDGET_PERCENT, budget_mix.SEED
    number = r"TRY_CAST(nullif(regexp_extract(source, '^src(\d{1,9})$', 1), '') AS BIGINT)"
    keyed = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE '=' || {c} END"
    return rf"""
WITH r AS (
  SELECT doc_id, lang, source, CASE WHEN {number} = 0 THEN 'crawl' WHEN {number} % 3 = 0 THEN 'books' WHEN {number} % 3 = 1 THEN 'code'
    WHEN {number} % 3 = 2 THEN 'news' ELSE 'other' END AS domain, len({_WORDS}) AS n_tokens
  FROM documents
), k AS (SELECT *, '=' || domain AS d, {keyed("lang")} AS l, {keyed("source")} AS s FROM r
), leaf AS (
  SELECT d, l, s, sum(n_tokens) AS tokens, {_weight("source")} AS weight,
    CAST(CASE WHEN {_weight("source")} > 0 THEN sum(n_tokens) * {epochs} ELSE 0 END AS HUGEINT) AS capacity
  FROM k GROUP BY d, l, s
), lang_node AS (
  SELECT d, l, {_weight("lang")} AS weight, CASE WHEN {_weight("lang")} > 0 THEN sum(capacity) ELSE 0 END AS capacity FROM leaf GROUP BY d, l
), domain_node AS (
  SELECT d, {_weight("domain")} AS weight, CASE WHEN {_weight("domain")} > 0 THEN sum(capacity) ELSE 0 END AS capacity
  FROM lang_node GROUP BY d
), top AS ({_share(f"SELECT *, (SELECT CAST(sum(tokens) AS HUGEINT) * {percent} // 100 FROM leaf) AS budget FROM domain_node", "", "d")}
), mid AS ({_share("SELECT lang_node.*, top.allotted AS budget FROM lang_node JOIN top USING (d)", "d", "l")}
), low AS ({_share("SELECT leaf.*, mid.allotted AS budget FROM leaf JOIN mid USING (d, l)", "d, l", "s")}
), plan AS (SELECT d, l, s, CAST(allotted // tokens AS BIGINT) AS whole, CAST(allotted % tokens AS BIGINT) AS rest FROM low WHERE tokens > 0
), o AS (
  SELECT k.*, whole, rest, md5(concat('{seed}:', whole, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS ord FROM k JOIN plan USING (d, l, s)
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY ord, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o
)
SELECT doc_id, domain, lang, source, CAST(unnest(range(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch,
  CAST(n_tokens AS BIGINT) AS n_tokens
FROM c"""


def _op9() -> str:
    n = suffix_dedup.WINDOW
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents
), windows AS (
  SELECT rid, doc_id, i, md5(array_to_string(words[i:i + {n - 1}], ' ')) AS h
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w WHERE len(words) >= {n})
), repeated AS (
  SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE doc_id > first
), covered AS (SELECT DISTINCT rid, i + k AS pos FROM repeated, range({n}) t(k)
), words AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN covered USING (rid, pos) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)"""


def _ascii_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op11() -> str:
    least, percent, scale = collocations.MIN_COUNT, collocations.COVERED_PERCENT, collocations.SCALE
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})"
        for k in (1, 2, 3, 4)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, k, phrase, a, ws, {cut} AS cut, array_to_string(ws[1:{cut}], ' ') AS first, array_to_string(ws[{cut + 1}:], ' ') AS rest FROM cand WHERE k > {cut}"
        for cut in (1, 2, 3)
    )
    inner = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[{at}:{at + k - 1}], ' ') AS phrase, a FROM cand WHERE k = {n}"
        for n in (3, 4) for k in range(2, n) for at in range(1, n - k + 2)
    )
    return rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ascii_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (SELECT lang, k, phrase, count(*) AS a FROM ({grams}) GROUP BY lang, k, phrase
), cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= {least}
), cuts AS ({cuts}
), scored AS (
  SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, CAST({scale}::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (SELECT lang, phrase, max(a) AS most FROM ({inner}) GROUP BY lang, phrase
), kept AS (
  SELECT best.* FROM best LEFT JOIN covered USING (lang, phrase) WHERE most IS NULL OR 100 * most < {percent} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= {collocations.SHOWN}"""


def _op13() -> str:
    least, smooth, scale = source_divergence.MIN_DOCS, source_divergence.SMOOTHING, source_divergence.SCALE
    share = f"1 + CAST({scale}::HUGEINT * ({{n}} + {smooth}) // ({{total}} + {smooth} * n_terms) AS BIGINT)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all({_ascii_lower("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {least}
), sizes AS (SELECT lang, count(*) AS n_terms FROM kept GROUP BY lang
), uses AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT g.lang, g.source, coalesce(total, 0) AS total, coalesce(n_terms, 0) AS n_terms
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM uses GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n, {share.format(n="coalesce(n, 0)", total="total")} AS p
  FROM grp JOIN kept USING (lang) LEFT JOIN uses USING (lang, source, term)
), q AS (
  SELECT lang, term, {share.format(n="t.n", total="l.total")} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM uses GROUP BY lang, term) t
  JOIN (SELECT lang, sum(n) AS total FROM uses GROUP BY lang) l USING (lang) JOIN sizes USING (lang)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), every AS (
  SELECT * FROM pair UNION ALL
  SELECT p.lang, source, 'term', p.term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {source_divergence.TERMS_SHOWN}"""


STATEMENTS = {
    "op3_reply_trees": _op3(),
    "op4_risk_rules": _op4(),
    "op5_interleave": _op5(),
    "op8_budget_mix": _op8(),
    "op9_substring_dedup": _op9(),
    "op11_collocations": _op11(),
    "op13_source_divergence": _op13(),
}
