import re

import pytest
from pyspark.sql import functions as F

from flowtriage.functions import rx
from flowtriage.functions.catalog import CATEGORIES, Category, feature_names
from flowtriage.operators import classification, detection, features, processes
from flowtriage.sources import dimensions

# The demo log whose results are golden data.
DEMO = """N E X T F L O W  ~  version 23.10.0
Launching `nf-core/rnaseq` [happy_darwin] DSL2 - revision: 3.12.0
executor >  local (24)
[2a/f8c3b1] process > RNASEQ:SAMPLESHEET_CHECK (samplesheet.csv) [100%] 1 of 1
[5d/a12e89] process > RNASEQ:FASTQC (SAMPLE_01)                  [100%] 6 of 6
[e3/b7d412] process > RNASEQ:TRIMGALORE (SAMPLE_01)              [100%] 6 of 6
[8f/c91a23] process > RNASEQ:ALIGN_STAR (SAMPLE_01)              [  0%] 0 of 6
Error executing process > 'RNASEQ:ALIGN_STAR (SAMPLE_03)'

Caused by:
  Process requirement exceeds available memory -- req: 36 GB; avail: 15.8 GB

Command executed:
  STAR --runMode alignReads --genomeDir star_index

Command exit status: -
Command output: (empty)

Work dir: /home/user/work/8f/c91a234567890abcdef

Tip: you can replicate the issue by changing to the process work dir

 -- Check the log file for details
"""

POSITIVE = [
    ("memory_exceeded", "worker 7: java.lang.OutOfMemoryError after 12 tasks"),
    ("missing_file", "lane4: Path does not exist (sheet_9.tsv)"),
    ("container_issue", "node4 says: OCI runtime create failed"),
    ("starsolo_memory", "02:11 node9 STARsolo killed with exit code 137"),
    ("barcode_whitelist_missing", "soloCBwhitelist file not found: /lists/v9.txt"),
    ("wrong_chemistry", "Chemistry SC9P not recognized"),
    ("empty_cell_output", "lane 4: no cells detected"),
    ("cellranger_fastq_naming", "cellranger: invalid fastq name lane4.fq"),
    ("kallisto_empty_bus", "lane 4: BUS file is empty"),
    ("anndata_version_mismatch", "reader 0.99: anndata version incompatible"),
    ("scrna_genome_mismatch", "contig scaffold_9 not in genome"),
]


def ids(df, run_id=0):
    return [r.id for r in df.where(F.col("run_id") == run_id).orderBy("rank").collect()]


def test_demo_log_golden(runs):
    found = {r.id: r for r in detection.detections(runs(DEMO)).collect()}
    assert set(found) == {"failed_process", "memory_exceeded"}
    assert (found["failed_process"].match_count, found["failed_process"].confidence, found["failed_process"].rank) == (2, 0.9, 1)
    assert (found["memory_exceeded"].match_count, found["memory_exceeded"].confidence, found["memory_exceeded"].rank) == (1, 0.7, 2)
    matched = {r.id: [m.line_num for m in r.matched] for r in detection.matched_lines(runs(DEMO)).collect()}
    assert matched == {"failed_process": [8, 16], "memory_exceeded": [11]}
    rollup = processes.process_rollup(runs(DEMO)).first()
    assert (rollup.total_processes, rollup.completed_processes, rollup.failed_processes) == (4, 3, 1)
    meta = processes.run_metadata(runs(DEMO)).first()
    assert (meta.nf_version, meta.pipeline, meta.revision, meta.exit_status) == ("23.10.0", "nf-core/rnaseq", "3.12.0", "-")
    assert meta.failed_process == "RNASEQ:ALIGN_STAR (SAMPLE_03)"
    assert meta.command == "STAR --runMode alignReads --genomeDir star_index"
    row = features.features(runs(DEMO)).first()
    assert (row.exit_code, row.memory_requested_gb, row.memory_available_gb, row.n_error_lines) == (0, 36.0, 15.8, 1)
    assert row.n_lines == DEMO.count("\n") + 1
    verdict = classification.classify(runs(DEMO)).first()
    assert (verdict.run_health, verdict.primary.id) == ("failed", "failed_process")
    assert verdict.triage_summary == (
        "💥 Failed Process detected in RNASEQ:ALIGN_STAR (SAMPLE_03) (confidence: 90%, severity: critical)"
    )
    parsed = classification.parse(runs(DEMO)).first()
    assert (parsed.total_processes, parsed.meta.pipeline, len(parsed.detected)) == (4, "nf-core/rnaseq", 2)


def test_positive_strings(runs):
    df = detection.detections(runs(*[t for _, t in POSITIVE]))
    found = {(r.run_id, r.id) for r in df.collect()}
    assert all((i, cid) in found for i, (cid, _) in enumerate(POSITIVE))


def test_clean_and_empty_logs(runs):
    texts = ("", "N E X T F L O W  ~  version 23.10.0\nAll done.", "Pipeline completed successfully. 95% reads mapped.")
    df = runs(*texts)
    assert detection.detections(df).count() == 0
    verdicts = classification.classify(df).collect()
    assert {v.run_health for v in verdicts} == {"healthy"}
    assert {v.triage_summary for v in verdicts} == {"No known error patterns detected in this log."}
    assert all(v.primary is None and (v.critical, v.high, v.medium) == (0, 0, 0) for v in verdicts)
    assert {r.total_processes for r in processes.process_rollup(df).collect()} == {0}


def test_confidence_grows_and_stops(runs):
    lines = ["Cannot allocate memory", "SIGKILL", "oom-kill", "memory limit"]
    df = detection.detections(runs(*["\n".join(lines[: n + 1]) for n in range(4)]))
    got = {r.run_id: round(r.confidence, 6) for r in df.where("id = 'memory_exceeded'").collect()}
    assert got == {0: 0.7, 1: 0.9, 2: 0.99, 3: 0.99}


def test_ties_rank_in_catalogue_order(runs):
    text = "No space left on device\nEACCES\nno cells detected"
    assert ids(detection.detections(runs(text))) == ["permission_issue", "disk_space", "empty_cell_output"]


def test_health_and_severities(runs):
    got = {r.run_id: r for r in classification.classify(runs("EACCES", "not a valid thing", "ENOSPC")).collect()}
    assert [got[i].run_health for i in range(3)] == ["degraded", "degraded", "failed"]
    assert [(got[i].critical, got[i].high, got[i].medium) for i in range(3)] == [(0, 1, 0), (0, 0, 1), (1, 0, 0)]
    assert "unknown process" in got[0].triage_summary


def test_every_regex_agrees_with_python(spark, runs):
    """The gated tests on folded text equal a plain case-insensitive search."""
    tricky = [
        "exit code \n1", "exit code 0", "Command exit status: -", "terminated with error exit status (0)",
        "PROCESS x TERMINATED WITH AN error EXIT STATUS (1)", "Killed process", "killed\n process", "SIGKILL",
        "ſIGKILL", "Acceſs denied", "docker\nnot found", "docker\rnot found", "docker not found",
        "Missing output file", "MISSING INPUT FILE", "0 cell found", "0 cells PASSED", "java.lang.OutOfMemoryError",
        "javaXlang.OutOfMemoryError", "Unable to pull container y", "x.fai was not found", "condaerror CREATE failed",
        "conda.create.failed", "a.fail not found", "İnvalid option", "ınvalid option", "cell number: 10", "kb run failed",
    ]
    texts = tricky + [t for _, t in POSITIVE] + [DEMO]
    folded = runs(*texts).withColumn("_folded", rx.fold(F.col("text")))
    patterns = [p for c in CATEGORIES for p in c.regexes]
    got = folded.select("run_id", *[F.expr(rx.hits("_folded", p)).alias(f"h{i}") for i, p in enumerate(patterns)]).collect()
    for row in got:
        expected = [bool(re.search(p, texts[row.run_id], re.I)) for p in patterns]
        assert list(row)[1:] == expected, texts[row.run_id]


def test_matched_lines_may_be_empty(runs):
    """A hit across a line break is a detection without lines."""
    row = detection.matched_lines(runs("job killed\n  process gone")).first()
    assert (row.id, row.matched) == ("memory_exceeded", [])


def test_lines_split_and_strip(runs):
    got = detection.lines(runs(" a\r\n b c \x1f\n")).orderBy("line_num").collect()
    assert [(r.line_num, r.text) for r in got] == [(1, "a"), (2, "b c"), (3, "")]


def test_category_lines(runs):
    df = runs("ok\n  EACCES here\nOperation NOT permitted\nfine")
    assert [r.line_num for r in detection.category_lines(df, "permission_issue").collect()] == [2, 3]
    assert detection.category_lines(df, "no_such_id").count() == 0


def test_process_lines(runs):
    text = "[2a/f8c3b1] process > FASTQC (S1) [100%] 6 of 6  [5D/A12E89] process > TRIM [  0%] 0 of 0\n[xx/123456] process > NO [1%] 1 of 2"
    got = processes.processes(runs(text)).orderBy("pos").collect()
    assert [(r.pos, r.hash, r.name, r.progress, r.completed, r.total, r.done) for r in got] == [
        (0, "2a/f8c3b1", "FASTQC (S1)", "100%", 6, 6, True),
        (1, "5D/A12E89", "TRIM", "0%", 0, 0, False),
    ]
    shares = processes.process_fraction(processes.processes(runs(text))).orderBy("pos").collect()
    assert [r.fraction for r in shares] == [1.0, 0.0]
    counted = features.features(runs(text)).first()
    assert (counted.n_processes, counted.n_completed, counted.n_failed) == (1, 0, 1)  # one greedy hit per line


def test_metadata_absent_is_null(runs):
    row = processes.run_metadata(runs("nothing here")).first()
    assert all(row[c] is None for c in ("nf_version", "pipeline", "revision", "failed_process", "work_dir", "command", "exit_status"))


@pytest.mark.parametrize(
    "text, code",
    [("Command exit status: 137", 137), ("COMMAND EXIT STATUS:\n1", 1), ("Command exit status: -", 0), ("", 0),
     ("Command exit status: 1)", -1), ("Command exit status: 127\nCommand exit status: 1", 127)],
)
def test_exit_code(runs, text, code):
    row = features.features(runs(text)).first()
    assert row.exit_code == code
    assert [row.exit_is_137, row.exit_is_1, row.exit_is_127] == [int(code == c) for c in (137, 1, 127)]


def test_feature_oddities(runs):
    rows = features.features(
        runs("", "associated", "a .fail b", "  at x.Y\n AT", "req: 8. GB avail: 0 GB", "req: 1.2.3 GB", "Error\nfatal WARN\nok warning")
    ).orderBy("run_id").collect()
    assert rows[0].completion_ratio == 1.0 and rows[0].n_lines == 1 and rows[0].error_density == 0.0
    assert rows[1].has_container == 1 and rows[2].has_index == 1
    assert rows[3].has_stack_trace == 1
    assert (rows[4].memory_requested_gb, rows[4].memory_ratio) == (8.0, 0.0)
    assert rows[5].memory_requested_gb == 0.0
    assert (rows[6].n_error_lines, rows[6].n_warning_lines, rows[6].n_lines) == (2, 2, 3)


def test_feature_names_match(runs):
    assert features.features(runs("test")).columns == ["run_id", *feature_names()]
    assert len(feature_names()) == 42
    row = features.features(runs("Permission denied: /data/file\nEACCES")).first()
    assert row.regex_permission_issue == 2 and row.has_permission == 1


def test_catalogue_keys_and_extension(spark, runs):
    assert len(CATEGORIES) == 16 and sum(len(c.regexes) for c in CATEGORIES) == 95
    assert all(all(c) for c in CATEGORIES)
    extra = Category("licence", "Licence", "site", "high", "🔑", "cause", "fix's", "cmd", (r"licen[cs]e (server )?down|no seats", "o'clock"))
    catalog = [*CATEGORIES, extra]
    found = detection.detections(runs("LICENSE server down\nsix O'Clock"), catalog)
    assert [(r.id, r.match_count) for r in found.collect()] == [("licence", 2)]
    assert detection.enriched(found, dimensions.categories(spark, catalog)).first().fix == "fix's"


def test_a_seventeenth_category_given_as_a_table(spark, runs):
    """Detections, features and the relational form follow the table."""
    built_in = dimensions.categories(spark)
    own = [(16, "quota", "Quota", "general", "high", "Q", None, "ask", "", ["user quota (exceeded|reached)", "Quota\\s+EXCEEDED"])]
    table = built_in.unionByName(spark.createDataFrame(own, built_in.schema))
    catalog = dimensions.catalog_of(table)
    assert [c.id for c in catalog][-1] == "quota" and len(catalog) == 17
    df = runs("User quota  exceeded, user QUOTA reached", "all fine", "No space left on device\nENOSPC, quota exceeded")
    by_row = {(r.run_id, r.id): r.match_count for r in detection.detections(df, catalog).collect()}
    rows = table.select("id", F.explode("regexes").alias("regex"))
    by_table = {(r.run_id, r.id): r.match_count for r in detection.counts_by_table(df, rows).collect()}
    assert by_row == by_table and by_row[0, "quota"] == 2 and (2, "quota") in by_row and not any(k[0] == 1 for k in by_row)
    assert "regex_quota" in features.features(df, catalog).columns
    assert classification.classify(df, catalog).where("run_id = 0").first().primary.id == "quota"
