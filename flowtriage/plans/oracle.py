"""The registered queries as SQL for a second engine.

Each statement is built from shared ``WITH`` blocks over the same tables and
states its rule in plain SQL, independent of the Spark expressions.
"""

from __future__ import annotations

import re

from flowtriage.functions.catalog import (
    BASE_FEATURES,
    CATEGORIES,
    ENGINE_ENABLED_REGEX,
    ENGINE_PROFILE_REGEX,
    ENGINES,
    ERROR_LINE_REGEX,
    EXECUTOR_REGEX,
    EXIT_CODE_REGEX,
    EXIT_ONE_HOT,
    GENOME_REGEX,
    GENOMES,
    MARKER_REGEXES,
    MAX_CPUS_REGEX,
    MAX_MEMORY_REGEX,
    MAX_TIME_REGEX,
    MEMORY_AVAILABLE_REGEX,
    MEMORY_REQUESTED_REGEX,
    METADATA_REGEXES,
    PATH_SETTING_REGEX,
    PATH_SETTINGS,
    PROCESS_FEATURE_REGEX,
    PROCESS_REGEX,
    REQUIRED_COLUMNS,
    STRANDEDNESS,
    TOKEN_REGEX,
    WARNING_LINE_REGEX,
    feature_names,
)
from flowtriage.functions.rx import WHITESPACE
from flowtriage.operators.text import DEFAULT_VOCABULARY
from flowtriage.plans.registry import DRILL_DOWN_CATEGORY, FIXED_IMPORTANCES, SAMPLE_PER_LABEL
from flowtriage.sources.corpus import CORPORA, oracle_cte


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITESPACE)})"


def first(pattern: str, ignore_case: bool = True, text: str = "text") -> str:
    p = q(("(?i)" if ignore_case else "") + pattern)
    return f"(CASE WHEN regexp_matches({text}, {p}) THEN regexp_extract({text}, {p}, 1) END)"


def any_regex(patterns) -> str:
    return q("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def values(rows) -> str:
    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else q(v)

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


_COUNTS = ", ".join(
    "(" + " + ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN 1 ELSE 0 END" for p in c.regexes) + f")::BIGINT AS regex_{c.id}"
    for c in CATEGORIES
)
_PROCESS = q("(?i)" + PROCESS_REGEX)
_FEATURE_PROCESS = q("(?i)" + PROCESS_FEATURE_REGEX)
_IN_LINES = "len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {})))::BIGINT"
_DETECTED = " UNION ALL ".join(
    f"SELECT run_id, {q(c.id)} AS id, {i} AS ordinal, regex_{c.id} AS match_count FROM counts WHERE regex_{c.id} > 0"
    for i, c in enumerate(CATEGORIES)
)
_MATCHED = " UNION ALL ".join(
    f"SELECT run_id, {q(c.id)} AS id, line_num, {strip('line')} AS text FROM lines WHERE regexp_matches(line, {any_regex(c.regexes)})"
    for c in CATEGORIES
)
_GENOME_HIT = "contains(lower(coalesce({g}, '')), lower(name))"
_HASH42 = "md5(concat('42:', cast(run_id AS VARCHAR)))"


def _cell(name: str) -> str:
    at = f"coalesce(list_position(header, {q(name)}), 0)"
    return f"CASE WHEN {at} > 0 THEN coalesce({strip(f'cells[{at}]')}, '') END AS {name}"


def _suffixed(column: str) -> str:
    return f"({column} LIKE '%.fastq.gz' OR {column} LIKE '%.fq.gz')"


_ROW_RULES = f"""
SELECT sheet_id, 1 AS stage, row_num, 1 AS rule_ord, 'sample_id' AS rule, 'critical' AS type, concat('Row ', row_num, ': Empty sample ID.') AS message
 FROM sheet_rows WHERE sample = ''
UNION ALL SELECT sheet_id, 1, row_num, 2, 'fastq_1', CASE WHEN fastq_1 = '' THEN 'critical' ELSE 'warning' END,
 concat('Row ', row_num, CASE WHEN fastq_1 = '' THEN ': Missing fastq_1 path.' ELSE ': fastq_1 doesn''t end with .fastq.gz or .fq.gz.' END)
 FROM sheet_rows WHERE fastq_1 = '' OR NOT {_suffixed('fastq_1')}
UNION ALL SELECT sheet_id, 1, row_num, 3, 'fastq_2', 'info', concat('Row ', row_num, ': No fastq_2 -- will be treated as single-end.')
 FROM sheet_rows WHERE coalesce(fastq_1, '') <> '' AND fastq_2 = ''
UNION ALL SELECT sheet_id, 1, row_num, 3, 'fastq_2', 'warning', concat('Row ', row_num, ': fastq_2 doesn''t end with .fastq.gz or .fq.gz.')
 FROM sheet_rows WHERE fastq_2 <> '' AND NOT {_suffixed('fastq_2')}
UNION ALL SELECT sheet_id, 1, row_num, 4, 'pair_naming', 'warning', concat('Row ', row_num, ': Paired-end filenames don''t follow R1/R2 naming convention.')
 FROM sheet_rows WHERE fastq_1 <> '' AND fastq_2 <> '' AND regexp_replace(fastq_1, '_R1|_1', '', 'g') <> regexp_replace(fastq_2, '_R2|_2', '', 'g')
UNION ALL SELECT sheet_id, 1, row_num, 5, 'strandedness', 'critical',
 concat('Row ', row_num, ': Invalid strandedness "', strandedness, '". Must be one of: {", ".join(STRANDEDNESS)}')
 FROM sheet_rows WHERE strandedness <> '' AND lower(strandedness) NOT IN ({", ".join(q(s) for s in STRANDEDNESS)})"""

_REFERENCES = (
    ("fasta", "Genome FASTA", "Genome FASTA not found: ", ""),
    ("gtf", "Gene annotation (GTF)", "GTF file not found: ", ""),
    ("star_index", "STAR index", "STAR index not found: ", ". It will need to be built (adds time to run)."),
    ("bwa_index", "BWA index", "BWA index not found: ", ". It will need to be built (adds time to run)."),
    ("hisat2_index", "HISAT2 index", "HISAT2 index not found: ", ". It will need to be built (adds time to run)."),
)
_WANTED = " UNION ALL ".join(
    f"SELECT config_id, {i} AS n, {q(name)} AS name, {col} AS path, concat({q(a)}, {col}, {q(b)}) AS absent FROM settings WHERE {col} IS NOT NULL"
    for i, (col, name, a, b) in enumerate(_REFERENCES)
)
_SEVERITY = "CASE status WHEN 'warn' THEN 'warning' WHEN 'fail' THEN 'critical' ELSE 'info' END AS severity"
_ENGINE_CASES = " ".join(
    f"WHEN regexp_matches(text, {q('(?i)' + ENGINE_ENABLED_REGEX.format(engine=e))}) THEN {q(e)}" for e in ENGINES
) + " " + " ".join(
    f"WHEN regexp_matches(text, {q('(?i)' + ENGINE_PROFILE_REGEX.format(engine=e))}) THEN {q(e)}" for e in reversed(ENGINES)
)


def _tool_check(stage_ord: int, tool: str, name: str, passed: str, failed: str, where: str = "") -> str:
    return f"""SELECT case_id, 6 AS stage, {stage_ord} AS n, {name} AS "check", CASE WHEN t.tool IS NULL THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN t.tool IS NULL THEN {failed} ELSE {passed} END AS message
 FROM case_config c LEFT JOIN host_tools t ON t.host_id = c.host_id AND t.tool = {tool} {where}"""


BLOCKS: dict[str, str] = {name: oracle_cte(name) for name in CORPORA} | {
    "catalog": "SELECT * FROM "
    + values((i, c.id, c.label, c.family, c.severity, c.icon, c.cause, c.fix, c.command, len(c.regexes)) for i, c in enumerate(CATEGORIES))
    + " v(ordinal, id, label, family, severity, icon, cause, fix, command, n_regexes)",
    "genomes": "SELECT * FROM " + values((i, *g) for i, g in enumerate(GENOMES)) + " v(ordinal, name, star_gb, bwa_gb, hisat2_gb, size_gb)",
    "lines": """SELECT run_id, unnest(string_split(text, chr(10))) AS line,
 unnest(range(1, len(string_split(text, chr(10))) + 1))::BIGINT AS line_num FROM runs""",
    "counts": f"SELECT run_id, {_COUNTS} FROM runs",
    "detected": f"""SELECT *, least(0.5::DOUBLE + match_count * 0.2::DOUBLE, 0.99::DOUBLE) AS confidence FROM ({_DETECTED})""",
    "ranked": """SELECT d.*, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, d.ordinal) AS rank,
 c.label, c.severity, c.icon, c.cause, c.fix, c.command FROM detected d JOIN catalog c USING (id)""",
    "matched": _MATCHED,
    "hits": f"""SELECT run_id, unnest(regexp_extract_all(text, {_PROCESS}, 0)) AS hit,
 unnest(range(0, len(regexp_extract_all(text, {_PROCESS}, 0))))::BIGINT AS pos FROM runs""",
    "procs": f"""SELECT run_id, pos, regexp_extract(hit, {_PROCESS}, 1) AS hash, {strip(f'regexp_extract(hit, {_PROCESS}, 2)')} AS name,
 {strip(f'regexp_extract(hit, {_PROCESS}, 3)')} AS progress, regexp_extract(hit, {_PROCESS}, 4)::BIGINT AS completed,
 regexp_extract(hit, {_PROCESS}, 5)::BIGINT AS total, {strip(f'regexp_extract(hit, {_PROCESS}, 3)')} = '100%' AS done FROM hits""",
    "meta": "SELECT run_id, "
    + ", ".join(f"{strip(first(p, ci))} AS {name}" for name, (p, ci) in METADATA_REGEXES.items())
    + " FROM runs",
    "severities": """SELECT r.run_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
 count(*) FILTER (severity = 'medium') AS medium, count(d.id) AS n_failures, string_agg(d.id, ',' ORDER BY rank) AS all_failures
 FROM runs r LEFT JOIN ranked d ON r.run_id = d.run_id GROUP BY r.run_id""",
    "primaries": """SELECT r.run_id, d.id, d.label, d.severity, d.icon, d.match_count, d.confidence
 FROM runs r LEFT JOIN ranked d ON r.run_id = d.run_id AND d.rank = 1""",
    "summaries": """SELECT p.run_id, CASE WHEN p.id IS NULL THEN 'No known error patterns detected in this log.'
 ELSE concat(icon, ' ', label, ' detected in ', coalesce(nullif(failed_process, ''), 'unknown process'), ' (confidence: ',
 cast(cast(round(confidence * 100) AS INTEGER) AS VARCHAR), '%, severity: ', severity, ')') END AS triage_summary
 FROM primaries p JOIN meta m ON p.run_id = m.run_id""",
    "healths": """SELECT run_id, CASE WHEN critical > 0 THEN 'failed' WHEN n_failures > 0 THEN 'degraded' ELSE 'healthy' END AS run_health FROM severities""",
    "raw_features": f"""SELECT *, {first(EXIT_CODE_REGEX)} AS tok,
 coalesce(try_cast({first(MEMORY_REQUESTED_REGEX)} AS DOUBLE), 0) AS memory_requested_gb,
 coalesce(try_cast({first(MEMORY_AVAILABLE_REGEX)} AS DOUBLE), 0) AS memory_available_gb,
 regexp_extract_all(text, {_FEATURE_PROCESS}, 2) AS pct FROM runs""",
    "features": f"""SELECT run_id, CASE WHEN tok IS NULL OR tok = '-' THEN 0 ELSE coalesce(try_cast(tok AS BIGINT), -1) END AS exit_code,
 memory_requested_gb, memory_available_gb,
 CASE WHEN memory_available_gb > 0 THEN memory_requested_gb / memory_available_gb ELSE 0 END AS memory_ratio,
 len(pct)::BIGINT AS n_processes, len(list_filter(pct, lambda p: trim(p) = '100%'))::BIGINT AS n_completed, n_processes - n_completed AS n_failed,
 CASE WHEN n_processes > 0 THEN n_completed / n_processes ELSE 1 END::DOUBLE AS completion_ratio,
 len(string_split(text, chr(10)))::BIGINT AS n_lines, {_IN_LINES.format(q('(?i)' + ERROR_LINE_REGEX))} AS n_error_lines,
 {_IN_LINES.format(q('(?i)' + WARNING_LINE_REGEX))} AS n_warning_lines, n_error_lines / greatest(n_lines, 1) AS error_density,
 {", ".join(f"regexp_matches(text, {q(('(?m)' if n == 'has_stack_trace' else '(?i)') + p)})::BIGINT AS {n}" for n, p in MARKER_REGEXES.items())},
 {", ".join(f"(exit_code = {c})::BIGINT AS exit_is_{c}" for c in EXIT_ONE_HOT)}, {_COUNTS} FROM raw_features""",
    "long_features": "SELECT run_id, feature, value FROM (SELECT run_id, "
    + ", ".join(f"{n}::DOUBLE AS {n}" for n in feature_names())
    + " FROM features) UNPIVOT (value FOR feature IN ("
    + ", ".join(feature_names())
    + "))",
    "importances": "SELECT idx, feature, importance::DOUBLE AS importance FROM "
    + values((i, n, v) for i, (n, v) in enumerate(zip(feature_names(), FIXED_IMPORTANCES)))
    + " v(idx, feature, importance)",
    "contributions": """SELECT * FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY importance * abs(value) DESC, idx) AS rank,
 f.feature, importance * abs(value) AS importance, value FROM long_features f JOIN importances i ON f.feature = i.feature
 WHERE importance * abs(value) > 0) WHERE rank <= 10""",
    "toks": f"""SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), {q(TOKEN_REGEX)}) AS t FROM documents""",
    "grams": """SELECT doc_id, list_concat(t, list_concat(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])),
 list_transform(range(1, len(t) - 1), lambda i: concat(t[i], ' ', t[i + 1], ' ', t[i + 2])))) AS g FROM toks""",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM grams) GROUP BY doc_id, term",
    "vocab": f"""SELECT term, n AS count, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM (
 SELECT term, sum(tf)::BIGINT AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term LIMIT {DEFAULT_VOCABULARY})""",
    "weights": """SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)""",
    **{
        f"run_{block}": sql
        for block, sql in (
            ("toks", f"""SELECT run_id, regexp_extract_all(strip_accents(lower(text)), {q(TOKEN_REGEX)}) AS t FROM runs"""),
            ("grams", """SELECT run_id, list_concat(t, list_concat(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])),
 list_transform(range(1, len(t) - 1), lambda i: concat(t[i], ' ', t[i + 1], ' ', t[i + 2])))) AS g FROM run_toks"""),
            ("tf", "SELECT run_id, term, count(*) AS tf FROM (SELECT run_id, unnest(g) AS term FROM run_grams) GROUP BY run_id, term"),
            ("vocab", f"""SELECT term, df FROM (SELECT term, sum(tf) AS n, count(*) AS df FROM run_tf GROUP BY term
 ORDER BY n DESC, term LIMIT {DEFAULT_VOCABULARY})"""),
            ("weights", """SELECT run_id, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM runs)) / (1 + df)) + 1) AS w FROM run_tf JOIN run_vocab USING (term)"""),
        )
    },
    "predictions": """SELECT p.run_id, r.label AS truth, coalesce(p.id, 'clean') AS predicted, p.confidence FROM primaries p JOIN runs r ON p.run_id = r.run_id""",
    "classes": """SELECT class, sum(support)::BIGINT AS support, sum(guessed)::BIGINT AS guessed, sum(hits)::BIGINT AS hits FROM (
 SELECT truth AS class, 1 AS support, 0 AS guessed, (truth = predicted)::INT AS hits FROM predictions
 UNION ALL SELECT predicted, 0, 1, 0 FROM predictions) GROUP BY class""",
    "scores": """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
 SELECT class, support, hits, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision,
 CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM classes)""",
    "scanned": """SELECT i.filename, i.label, coalesce(i.pipeline, '') AS pipeline, r.text FROM label_index i
 JOIN runs r ON i.filename = concat('run_', cast(r.run_id AS VARCHAR), '.log')""",
    "sheet_frames": f"""SELECT sheet_id, l, list_transform(string_split(l[1], ','), lambda h: lower({strip('h')})) AS header,
 list_filter(l[2:], lambda x: {strip('x')} <> '') AS data FROM (SELECT sheet_id, string_split({strip('text')}, chr(10)) AS l FROM sheets)""",
    "sheet_cells": """SELECT sheet_id, header, unnest(range(2, len(data) + 2))::BIGINT AS row_num, string_split(unnest(data), ',') AS cells
 FROM sheet_frames WHERE len(l) >= 2""",
    "sheet_rows": f"SELECT sheet_id, row_num, {', '.join(_cell(c) for c in REQUIRED_COLUMNS)} FROM sheet_cells",
    "sheet_dups": """SELECT sheet_id, sample, count(*) AS "count", min(row_num) AS first_row FROM sheet_rows WHERE sample <> ''
 GROUP BY sheet_id, sample HAVING count(*) > 1""",
    "sheet_missing": f"""SELECT sheet_id, list_filter([{", ".join(q(c) for c in REQUIRED_COLUMNS)}], lambda c: NOT list_contains(header, c)) AS missing
 FROM sheet_frames WHERE len(l) >= 2""",
    "sheet_found": f"""SELECT sheet_id, 0 AS stage, NULL::BIGINT AS row_num, 0 AS rule_ord, 'empty' AS rule, 'critical' AS type,
 'Sample sheet is empty or has no data rows.' AS message FROM sheet_frames WHERE len(l) < 2
 UNION ALL SELECT sheet_id, 0, NULL, 0, 'missing_columns', 'critical', concat('Missing required columns: ', array_to_string(missing, ', '))
 FROM sheet_missing WHERE len(missing) > 0
 UNION ALL {_ROW_RULES}
 UNION ALL SELECT sheet_id, 2, NULL, first_row, 'duplicate', 'warning', concat('Duplicate sample ID "', sample, '" appears ', "count",
 ' times. Ensure this is intentional (e.g., multi-lane sequencing).') FROM sheet_dups""",
    "sheet_issues": """SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY stage, row_num, rule_ord) AS ord, row_num, rule, type, message FROM sheet_found""",
    "sheet_sums": """SELECT f.sheet_id, CASE WHEN len(l) >= 2 THEN len(data) END::BIGINT AS total_samples,
 CASE WHEN len(l) >= 2 THEN (SELECT count(DISTINCT sample) FROM sheet_rows r WHERE r.sheet_id = f.sheet_id AND sample <> '') END AS unique_samples,
 CASE WHEN len(l) >= 2 THEN (SELECT count(*) FROM sheet_rows r WHERE r.sheet_id = f.sheet_id AND coalesce(fastq_1, '') <> '' AND fastq_2 = '') END AS single_end,
 CASE WHEN len(l) >= 2 THEN (SELECT count(*) FROM sheet_rows r WHERE r.sheet_id = f.sheet_id AND fastq_2 <> '') END AS paired_end,
 CASE WHEN len(l) >= 2 THEN array_to_string(header, ',') END AS columns FROM sheet_frames f""",
    "structure": """SELECT sheet_id, ord, 'Sample sheet validation' AS "check", CASE WHEN type = 'critical' THEN 'fail' ELSE 'warn' END AS status, type AS severity, message FROM sheet_issues
 UNION ALL SELECT sheet_id, 1, 'Sample sheet validation', 'pass', 'info', 'Sample sheet structure is valid' FROM sheets
 WHERE sheet_id NOT IN (SELECT sheet_id FROM sheet_issues)""",
    "fastq_paths": """SELECT s.*, NOT EXISTS (SELECT 1 FROM manifest m WHERE m.path = s.path) AS missing FROM (
 SELECT sheet_id, row_num, 1 AS slot, fastq_1 AS path FROM sheet_rows UNION ALL SELECT sheet_id, row_num, 2, fastq_2 FROM sheet_rows) s
 WHERE path <> '' AND NOT (starts_with(path, 's3://') OR starts_with(path, 'gs://') OR starts_with(path, 'az://'))""",
    "fastq": """SELECT sheet_id, CASE WHEN m > 0 THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN m > 0 THEN concat(m, ' of ', n, ' FASTQ files not found on disk') ELSE concat('All ', n, ' FASTQ files found on disk') END AS message,
 CASE WHEN m > 0 THEN array_to_string(gone[1:10], '|') END AS details
 FROM (SELECT sheet_id, count(*) AS n, count(*) FILTER (missing) AS m, list(path ORDER BY row_num, slot) FILTER (missing) AS gone FROM fastq_paths GROUP BY sheet_id)""",
    "settings": f"""SELECT config_id, try_cast({first(MAX_MEMORY_REGEX)} AS DOUBLE) AS max_memory, try_cast({first(MAX_CPUS_REGEX)} AS BIGINT) AS max_cpus,
 try_cast({first(MAX_TIME_REGEX)} AS DOUBLE) AS max_time, CASE {_ENGINE_CASES} END AS container_engine, {first(GENOME_REGEX, False)} AS genome,
 {", ".join(f"{first(PATH_SETTING_REGEX.format(key=k))} AS {k}" for k in PATH_SETTINGS)}, {first(EXECUTOR_REGEX)} AS executor, NULL::VARCHAR AS profile,
 length(text) - length(replace(text, chr(123), '')) - length(text) + length(replace(text, chr(125), '')) AS balance FROM configs""",
    "first_genome": f"""SELECT config_id, arg_min(name, ordinal) AS name, arg_min(star_gb, ordinal)::BIGINT AS star_gb, arg_min(size_gb, ordinal)::DOUBLE AS size_gb, min(ordinal) AS ordinal
 FROM settings JOIN genomes ON {_GENOME_HIT.format(g='genome')} GROUP BY config_id""",
    "config_found": """SELECT config_id, 1 AS n, 'Config syntax' AS "check", 'fail' AS status, concat('Mismatched braces in config: ', abs(balance),
 CASE WHEN balance > 0 THEN ' extra opening' ELSE ' extra closing' END, ' brace(s)') AS message FROM settings WHERE balance <> 0
 UNION ALL SELECT config_id, 2, 'Memory allocation', CASE WHEN coalesce(max_memory, 0) >= 4 THEN 'pass' ELSE 'warn' END,
 CASE WHEN coalesce(max_memory, 0) = 0 THEN 'max_memory not found in config — pipeline will use defaults'
  WHEN max_memory < 4 THEN concat('max_memory is very low (', cast(max_memory AS VARCHAR), ' GB). Most NGS tools need at least 8 GB.')
  ELSE concat('max_memory = ', cast(max_memory AS VARCHAR), ' GB') END FROM settings
 UNION ALL SELECT config_id, 3, 'CPU allocation', 'pass', concat('max_cpus = ', max_cpus) FROM settings WHERE max_cpus <> 0
 UNION ALL SELECT config_id, 4, 'Container/Environment engine', CASE WHEN container_engine IS NULL THEN 'warn' ELSE 'pass' END,
 CASE WHEN container_engine IS NULL THEN 'No container engine detected in config (docker/singularity/conda). Pipeline may fail if tools aren''t installed locally.'
  ELSE concat('Using ', container_engine) END FROM settings""",
    "wanted": _WANTED,
    "refs": """SELECT config_id, n, name AS "check", CASE WHEN m.path IS NULL THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN m.path IS NULL THEN absent WHEN n = 0 THEN concat('Found: ', w.path, ' (', printf('%.2f', size_bytes / 1073741824), ' GB)') ELSE concat('Found: ', w.path) END AS message
 FROM wanted w LEFT JOIN (SELECT path, max(size_bytes) AS size_bytes FROM manifest GROUP BY path) m ON w.path = m.path""",
    "star": """SELECT s.config_id, 'Memory for STAR alignment' AS "check", CASE WHEN max_memory < star_gb THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN max_memory < star_gb THEN concat('STAR index for ', genome, ' needs ~', star_gb, ' GB but max_memory is ', cast(max_memory AS VARCHAR),
  ' GB. Increase to at least ', star_gb, ' GB or STAR will crash with OOM.')
 ELSE concat('max_memory (', cast(max_memory AS VARCHAR), ' GB) is sufficient for STAR on ', genome, ' (needs ~', star_gb, ' GB)') END AS message
 FROM settings s JOIN first_genome g ON s.config_id = g.config_id WHERE max_memory <> 0""",
    "case_config": "SELECT c.*, s.* EXCLUDE (config_id), s.config_id AS found_config FROM cases c LEFT JOIN settings s ON c.config_id = s.config_id",
    "disk_need": """SELECT c.case_id, h.free_gb, coalesce(ss.total_samples, 0) AS n,
 round(coalesce(ss.total_samples, 0) * 5 + coalesce(g.size_gb, 3.0) * 2, 1)::DOUBLE AS need, coalesce(c.work_dir, c.outdir, '.') AS dir
 FROM case_config c LEFT JOIN sheet_sums ss ON c.sheet_id = ss.sheet_id LEFT JOIN first_genome g ON c.config_id = g.config_id LEFT JOIN hosts h ON c.host_id = h.host_id""",
    "disk": """SELECT case_id, 'Disk space' AS "check", CASE WHEN free_gb IS NULL THEN 'skip' WHEN free_gb < need THEN 'fail' WHEN free_gb < need * 1.5 THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN free_gb IS NULL THEN concat('Could not check disk space at: ', dir)
  WHEN free_gb < need THEN concat('Estimated ', cast(need AS VARCHAR), ' GB needed for ', n, ' samples, but only ', cast(free_gb AS VARCHAR), ' GB free at ', dir)
  WHEN free_gb < need * 1.5 THEN concat('Tight on space: ', cast(free_gb AS VARCHAR), ' GB free, estimated ', cast(need AS VARCHAR), ' GB needed. Consider cleaning old work directories first.')
  ELSE concat(cast(free_gb AS VARCHAR), ' GB free, estimated ', cast(need AS VARCHAR), ' GB needed — sufficient') END AS message FROM disk_need""",
    "tool_found": " UNION ALL ".join(
        (
            _tool_check(1, "'nextflow'", "'Nextflow installed'", "'Nextflow is available on PATH'",
                        "'Nextflow not found on PATH. Install from https://nextflow.io'"),
            _tool_check(2, "c.container_engine", "concat(upper(container_engine[1]), container_engine[2:], ' available')",
                        "concat(container_engine, ' is available on PATH')",
                        "concat(container_engine, ' is configured but not found on PATH')", "WHERE container_engine IS NOT NULL"),
            _tool_check(3, "'java'", "'Java installed'", "'Java is available (required by Nextflow)'",
                        "'Java not found — required by Nextflow'"),
        )
    ),
    "all_found": f"""SELECT c.case_id, 1 AS stage, s.ord AS n, s."check", s.status, s.severity, s.message, NULL AS details FROM cases c JOIN structure s ON c.sheet_id = s.sheet_id
 UNION ALL SELECT c.case_id, 1, 1000000, 'FASTQ file existence', f.status, CASE f.status WHEN 'fail' THEN 'critical' ELSE 'info' END, f.message, f.details FROM cases c JOIN fastq f ON c.sheet_id = f.sheet_id
 UNION ALL SELECT c.case_id, 1, 1, 'Sample sheet', 'skip', 'info', 'No sample sheet provided', NULL FROM cases c WHERE sheet_id IS NULL
 UNION ALL SELECT c.case_id, 1, 1, 'Sample sheet file', 'fail', 'critical', concat('Sample sheet not found: ', sheet_id), NULL FROM cases c
  WHERE sheet_id IS NOT NULL AND sheet_id NOT IN (SELECT sheet_id FROM sheets)
 UNION ALL SELECT case_id, 2, n, "check", status, {_SEVERITY}, message, NULL FROM cases JOIN config_found USING (config_id)
 UNION ALL SELECT case_id, 2, 1, 'Config file', 'skip', 'info', 'No config provided — using defaults', NULL FROM cases WHERE config_id IS NULL
 UNION ALL SELECT case_id, 2, 1, 'Config file', 'fail', 'critical', concat('Config file not found: ', config_id), NULL FROM cases
  WHERE config_id IS NOT NULL AND config_id NOT IN (SELECT config_id FROM configs)
 UNION ALL SELECT case_id, 3, n, "check", status, {_SEVERITY}, message, NULL FROM cases JOIN refs USING (config_id)
 UNION ALL SELECT case_id, 4, 1, "check", status, {_SEVERITY}, message, NULL FROM cases JOIN star USING (config_id)
 UNION ALL SELECT case_id, 5, 1, "check", status, {_SEVERITY}, message, NULL FROM disk
 UNION ALL SELECT case_id, 6, n, "check", status, {_SEVERITY}, message, NULL FROM tool_found""",
    "all_checks": """SELECT case_id, stage::BIGINT AS stage, row_number() OVER (PARTITION BY case_id ORDER BY stage, n) AS ord, "check", status, severity, message, details FROM all_found""",
    "verdicts": """SELECT case_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'skip') AS n_skip,
 count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, count(*) AS n_total FROM all_checks GROUP BY case_id""",
}

_RULE = "SELECT sheet_id, {cols}type, message FROM sheet_issues WHERE rule = '{rule}'"
_CONFIG = 'SELECT config_id, "check", status, ' + _SEVERITY + ", message FROM config_found WHERE \"check\" = '{}'"
_SHORT = "SELECT run_id, rank, replace(feature, 'regex_', 'Pattern: ') AS feature, round(importance, 6) AS importance FROM contributions WHERE rank <= 8 AND importance > 0.001"
_INGEST = """SELECT case_id, CASE WHEN c.{k} IS NULL THEN 'skip' WHEN t.{k} IS NULL THEN 'fail' WHEN text = '' THEN 'skip' ELSE 'read' END AS status,
 CASE WHEN c.{k} IS NULL THEN '{skip}' WHEN t.{k} IS NULL THEN '{fail}' WHEN text = '' THEN '{skip}' END AS "check",
 CASE WHEN c.{k} IS NULL THEN '{skip_message}' WHEN t.{k} IS NULL THEN concat('{fail} not found: ', c.{k}) WHEN text = '' THEN '{skip_message}' END AS message
 FROM cases c LEFT JOIN {t} t ON c.{k} = t.{k}"""
_PATTERN_SUMS = " UNION ALL ".join(
    f"SELECT {q(c.family)} AS family, {q(c.id)} AS id, {q(c.severity)} AS severity, {i}::BIGINT AS regex_pos, {q(p)} AS regex, "
    f"(SELECT count(*) FROM runs WHERE regexp_matches(text, {q('(?i)' + p)})) AS n_runs"
    for c in CATEGORIES
    for i, p in enumerate(c.regexes)
)


def _feature_query(*names: str) -> str:
    doubles = {"memory_requested_gb", "memory_available_gb", "memory_ratio", "completion_ratio", "error_density"}
    return "SELECT run_id, " + ", ".join(f"round({n}, 6) AS {n}" if n in doubles else n for n in names) + " FROM features"


SELECTS: dict[str, str] = {
    "labelled_scan": "SELECT filename, label, pipeline, 'real' AS source, length(text) AS n_chars FROM scanned",
    "log_ingest": """SELECT concat('run_', cast(run_id AS VARCHAR), CASE WHEN run_id % 5 = 1 THEN '.txt' ELSE '.log' END) AS filename,
 length(text) + CASE WHEN run_id % 3 = 0 THEN 1 ELSE 0 END AS n_chars, concat(text, CASE WHEN run_id % 3 = 0 THEN chr(65533) ELSE '' END) AS text
 FROM runs WHERE run_id % 5 <> 0""",
    "sheet_ingest": _INGEST.format(k="sheet_id", t="sheets", skip="Sample sheet", fail="Sample sheet file", skip_message="No sample sheet provided").replace(
        "'Sample sheet file not found: '", "'Sample sheet not found: '"
    ),
    "config_ingest": _INGEST.format(k="config_id", t="configs", skip="Config file", fail="Config file", skip_message="No config provided — using defaults"),
    "pattern_catalog": """SELECT ordinal::BIGINT AS ordinal, id, c.label, family, severity, n_regexes::BIGINT AS n_regexes,
 (SELECT count(*) FROM runs r WHERE r.label = c.id) AS n_runs FROM catalog c""",
    "genome_catalog": """SELECT ordinal::BIGINT AS ordinal, name, star_gb::DOUBLE AS star_gb, bwa_gb::DOUBLE AS bwa_gb, hisat2_gb::DOUBLE AS hisat2_gb,
 size_gb::DOUBLE AS size_gb, (SELECT count(*) FROM first_genome f WHERE f.name = g.name) AS n_configs FROM genomes g""",
    "corpus_index": """SELECT concat(label, '_', lpad(cast(n AS VARCHAR), greatest(4, length(cast(n AS VARCHAR)))::INTEGER, '0'), '.log') AS filename, label, pipeline, executor FROM (
 SELECT *, row_number() OVER (ORDER BY md5(cast(run_id AS VARCHAR))) - 1 AS n FROM runs)""",
    "corpus_roundtrip": """SELECT concat(label, '_', lpad(cast(n AS VARCHAR), greatest(4, length(cast(n AS VARCHAR)))::INTEGER, '0'), '.log') AS filename, label,
 coalesce(pipeline, '') AS pipeline, 'real' AS source, length(text) AS n_chars, md5(text) AS digest FROM (
 SELECT *, row_number() OVER (ORDER BY md5(cast(run_id AS VARCHAR))) - 1 AS n FROM runs)""",
    "log_lines": f"SELECT run_id, line_num, {strip('line')} AS text FROM lines",
    "detect_counts": "SELECT run_id, id, match_count FROM detected",
    "matched_lines": "SELECT d.run_id, d.id, line_num, text FROM detected d LEFT JOIN matched m ON d.run_id = m.run_id AND d.id = m.id",
    "detect_counts_table": "SELECT run_id, id, match_count FROM detected",
    "detect_confidence": "SELECT run_id, id, round(confidence, 6) AS confidence FROM detected",
    "detect_enriched": "SELECT run_id, id, label, severity, icon, cause, fix, command, match_count FROM ranked",
    "detect_ranked": "SELECT run_id, id, rank FROM ranked",
    "process_rows": "SELECT run_id, pos, hash, name, progress, completed, total, done FROM procs",
    "process_rollup": """SELECT r.run_id, count(p.pos) AS total_processes, count(*) FILTER (done) AS completed_processes,
 count(*) FILTER (NOT done) AS failed_processes FROM runs r LEFT JOIN procs p ON r.run_id = p.run_id GROUP BY r.run_id""",
    "run_metadata": "SELECT * FROM meta",
    "category_lines": f"SELECT run_id, line_num, text FROM matched WHERE id = {q(DRILL_DOWN_CATEGORY)}",
    "process_fraction": "SELECT run_id, pos, name, round(CASE WHEN total > 0 THEN completed / total ELSE 0 END, 6)::DOUBLE AS fraction FROM procs",
    "severity_counts": "SELECT run_id, critical, high, medium FROM severities",
    "run_health": "SELECT * FROM healths",
    "primary_failure": "SELECT run_id, id, label, severity, match_count, round(confidence, 6) AS confidence FROM primaries",
    "triage_summary": "SELECT * FROM summaries",
    "classify_runs": """SELECT s.run_id, run_health, critical, high, medium, p.id AS primary_id, n_failures, coalesce(all_failures, '') AS all_failures, triage_summary
 FROM severities s JOIN healths h ON s.run_id = h.run_id JOIN primaries p ON s.run_id = p.run_id JOIN summaries t ON s.run_id = t.run_id""",
    "pattern_reference": _PATTERN_SUMS,
    "feat_exit_code": _feature_query("exit_code"),
    "feat_exit_onehot": _feature_query(*[f"exit_is_{c}" for c in EXIT_ONE_HOT]),
    "feat_memory": _feature_query("memory_requested_gb", "memory_available_gb", "memory_ratio"),
    "feat_process": _feature_query("n_processes", "n_completed", "n_failed", "completion_ratio"),
    "feat_lines": _feature_query("n_lines", "n_error_lines", "n_warning_lines", "error_density"),
    "feat_markers": _feature_query(*MARKER_REGEXES),
    "feat_regex_counts": _feature_query(*feature_names()[len(BASE_FEATURES):]),
    "feature_table": _feature_query(*feature_names()),
    "tokens": "SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM toks",
    "ngrams": "SELECT doc_id, len(g)::BIGINT AS n_terms, array_to_string(g, '|') AS terms FROM grams",
    "vocabulary": 'SELECT term, "count", idx FROM vocab',
    "tfidf": "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weights",
    "hybrid_features": """SELECT run_id, sum(n)::BIGINT AS n_values, round(sum(v), 4) AS total FROM (
 SELECT run_id, count(*) AS n, sum(w) / sqrt(sum(w * w)) AS v FROM run_weights GROUP BY run_id
 UNION ALL SELECT run_id, count(*), sum(value) FROM long_features WHERE value <> 0 GROUP BY run_id) GROUP BY run_id""",
    "model_roundtrip": "SELECT run_id, label, true AS same FROM runs",
    "train_model": """SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_idx, count(*) AS n_sample,
 count(*) AS n_right, 200::BIGINT AS n_trees FROM runs GROUP BY label""",
    "cv_score": f"""SELECT fold, count(*) AS n_runs, true AS mostly_right, true AS good, true AS good_mean, true AS steady FROM (
 SELECT (row_number() OVER (PARTITION BY label ORDER BY {_HASH42}) - 1) % 5 AS fold FROM runs) GROUP BY fold""",
    "cv_group_folds": """SELECT filename, label, n_copies, 1::BIGINT AS n_folds,
 (row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', filename))) - 1) % 5 AS fold FROM (
 SELECT concat('synthetic_', cast(run_id AS VARCHAR)) AS filename, label, 1::BIGINT AS n_copies FROM runs
 UNION ALL SELECT filename, min(label), 4 * count(*) FROM scanned GROUP BY filename)""",
    "predict_top5": """SELECT run_id, label AS first, least(5, (SELECT count(DISTINCT label) FROM runs))::BIGINT AS n_classes, true AS ranked, true AS sums_to_one FROM runs""",
    "predict_batch": "SELECT run_id, label, true AS sound FROM runs",
    "explain": "SELECT run_id, label, 'feature_importance' AS explanation_method, true AS explained, true AS sound FROM runs",
    "model_diagnosis": """SELECT run_id, p.label AS predicted, CASE WHEN p.label = 'clean' THEN 'pass' WHEN severity IN ('critical', 'high') THEN 'fail' ELSE 'warn' END AS verdict,
 c.label, severity, icon, cause, fix, command FROM runs p LEFT JOIN catalog c ON p.label = c.id""",
    "model_alternatives": "SELECT run_id, label AS predicted, true AS sound FROM runs",
    "training_report": f"""SELECT class, CASE WHEN class <> 'accuracy' THEN 1.0 END::DOUBLE AS precision, CASE WHEN class <> 'accuracy' THEN 1.0 END::DOUBLE AS recall,
 1.0::DOUBLE AS f1, support FROM (SELECT label AS class, least({SAMPLE_PER_LABEL}, count(*))::BIGINT AS support FROM runs GROUP BY label
 UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), sum(n)::BIGINT FROM (SELECT least({SAMPLE_PER_LABEL}, count(*)) AS n FROM runs GROUP BY label))""",
    "parse_runs": """SELECT m.run_id, coalesce(d.n, 0)::BIGINT AS n_detected, coalesce(p.n, 0)::BIGINT AS total_processes,
 coalesce(p.n_done, 0)::BIGINT AS completed_processes, coalesce(p.n - p.n_done, 0)::BIGINT AS failed_processes, m.failed_process
 FROM meta m LEFT JOIN (SELECT run_id, count(*) AS n FROM detected GROUP BY run_id) d ON m.run_id = d.run_id
 LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (done) AS n_done FROM procs GROUP BY run_id) p ON m.run_id = p.run_id""",
    "label_index": "SELECT run_id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_idx FROM runs",
    "cv_folds": f"SELECT run_id, label, (row_number() OVER (PARTITION BY label ORDER BY {_HASH42}) - 1) % 5 AS fold FROM runs",
    "classification_report": """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
 SELECT class, precision, recall, f1, support FROM scores
 UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support)::BIGINT FROM scores
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM scores
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM scores)""",
    "top_features": "SELECT run_id, rank, feature, round(importance, 6) AS importance, round(value, 6) AS value FROM contributions",
    "diagnosis": """SELECT run_id, predicted, CASE WHEN predicted = 'clean' THEN 'pass' WHEN severity IN ('critical', 'high') THEN 'fail' ELSE 'warn' END AS verdict,
 c.label, severity, icon, cause, fix, command FROM predictions p LEFT JOIN catalog c ON p.predicted = c.id""",
    "alternatives": """SELECT run_id, predicted, id AS alternative, round(share, 6) AS probability FROM (
 SELECT d.run_id, p.id AS predicted, d.id, d.confidence / sum(d.confidence) OVER (PARTITION BY d.run_id) AS share
 FROM detected d JOIN primaries p ON d.run_id = p.run_id) WHERE id <> predicted AND share > 0.05""",
    "explanation_shortlist": _SHORT,
    "label_distribution": "SELECT label, count(*) AS count FROM runs GROUP BY label",
    "oversample": """SELECT concat('run_', cast(run_id AS VARCHAR), '.log') AS filename, label, 'synthetic' AS source, 1::BIGINT AS copy FROM runs
 UNION ALL SELECT filename, label, 'real', unnest([1, 2, 3, 4])::BIGINT FROM scanned""",
    "balanced_sample": f"""SELECT run_id, label, label_position, row_number() OVER (ORDER BY {_HASH42}) - 1 AS position FROM (
 SELECT run_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH42}) - 1 AS label_position FROM runs) WHERE label_position < {SAMPLE_PER_LABEL}""",
    "smoke_compare": "SELECT run_id, truth AS expected, predicted AS got, truth = predicted AS matches, round(confidence, 6) AS confidence FROM predictions",
    "sheet_rows": "SELECT * FROM sheet_rows",
    "sheet_empty": _RULE.format(cols="", rule="empty"),
    "sheet_missing_columns": _RULE.format(cols="", rule="missing_columns"),
    "sheet_sample_id": _RULE.format(cols="row_num, ", rule="sample_id"),
    "sheet_fastq1": _RULE.format(cols="row_num, ", rule="fastq_1"),
    "sheet_fastq2": _RULE.format(cols="row_num, ", rule="fastq_2"),
    "sheet_pair_naming": _RULE.format(cols="row_num, ", rule="pair_naming"),
    "sheet_strandedness": _RULE.format(cols="row_num, ", rule="strandedness"),
    "sheet_duplicates": 'SELECT sheet_id, first_row, sample, "count" FROM sheet_dups',
    "sheet_summary": "SELECT * FROM sheet_sums",
    "sheet_issues": "SELECT *, CASE type WHEN 'critical' THEN 'fail' WHEN 'warning' THEN 'warn' ELSE 'skip' END AS display FROM sheet_issues",
    "pf_sheet_checks": "SELECT * FROM structure",
    "pf_fastq_exists": "SELECT * FROM fastq",
    "pf_braces": _CONFIG.format("Config syntax"),
    "pf_config_settings": "SELECT * EXCLUDE (balance) FROM settings",
    "pf_container_engine": "SELECT config_id, container_engine FROM settings",
    "pf_memory_alloc": _CONFIG.format("Memory allocation"),
    "pf_cpu_alloc": _CONFIG.format("CPU allocation"),
    "pf_engine_check": _CONFIG.format("Container/Environment engine"),
    "pf_references": f'SELECT config_id, row_number() OVER (PARTITION BY config_id ORDER BY n) AS ord, "check", status, {_SEVERITY}, message FROM refs',
    "pf_memory_genome": f'SELECT config_id, "check", status, {_SEVERITY}, message FROM star',
    "pf_disk": f'SELECT case_id, "check", status, {_SEVERITY}, message FROM disk',
    "pf_tools": f'SELECT case_id, "check", status, {_SEVERITY}, message FROM tool_found',
    "pf_all_checks": "SELECT * FROM all_checks",
    "pf_verdict": """SELECT *, CASE WHEN n_fail > 0 THEN 'fail' WHEN n_warn > 0 THEN 'warn' ELSE 'pass' END AS verdict,
 CASE WHEN n_fail > 0 THEN concat('🔴 NOT READY — ', n_fail, ' critical issue(s) found. Fix these before launching.')
  WHEN n_warn > 0 THEN concat('🟡 PROCEED WITH CAUTION — ', n_warn, ' warning(s). Review before launching.')
  ELSE concat('🟢 READY TO LAUNCH — all ', n_pass, ' checks passed.') END AS verdict_message FROM verdicts""",
    "pf_ordered_checks": """SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY CASE status WHEN 'fail' THEN 1 WHEN 'warn' THEN 2 WHEN 'pass' THEN 3 ELSE 4 END, ord) AS rank,
 "check", status, message FROM all_checks""",
    "pf_config_report": """SELECT config_id, CASE WHEN max_memory <> 0 THEN concat(cast(max_memory AS VARCHAR), ' GB') END AS memory, CASE WHEN max_cpus <> 0 THEN max_cpus END AS cpus, genome, container_engine AS engine
 FROM settings WHERE coalesce(cast(max_memory AS VARCHAR), cast(max_cpus AS VARCHAR), cast(max_time AS VARCHAR), container_engine, genome, fasta, gtf, star_index, bwa_index, hisat2_index, outdir, executor) IS NOT NULL""",
}


def _needed(sql: str, found: dict[str, None] | None = None) -> dict[str, None]:
    """Blocks a statement uses, directly or through others, inputs first."""
    found = {} if found is None else found
    for name in BLOCKS:
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            _needed(BLOCKS[name], found)
            found[name] = None
    return found


def statements() -> dict[str, str]:
    result = {}
    for name, select in SELECTS.items():
        needed = _needed(select)
        texts = [select, *(BLOCKS[b] for b in needed)]
        # A block that several others read is computed once.
        shared = {b for b in needed if sum(len(re.findall(rf"\b(?:FROM|JOIN)\s+{b}\b", t)) for t in texts) > 1}
        blocks = ",\n".join(f"{b} AS {'MATERIALIZED ' if b in shared else ''}({BLOCKS[b]})" for b in needed)
        result[name] = f"WITH {blocks}\n{select}" if blocks else select
    return result
