import pytest
from pyspark.sql import functions as F

from flowtriage.operators import preflight as ops
from flowtriage.operators import sheets as sheet_ops

GOOD_SHEET = "strandedness,sample,fastq_1,fastq_2\nauto,k7,/lab/k7_R1.fastq.gz,/lab/k7_R2.fastq.gz\n"
CONFIG = "params { max_memory = '32.GB'\n max_cpus = 16\n genome = 'GRCh38' }\ndocker { enabled = true }"


def settings(configs, text):
    return ops.config_settings(configs(text)).first()


@pytest.mark.parametrize(
    "text, name, value",
    [
        ("params { outdir = 'o'; max_memory = '23.GB' }", "max_memory", 23.0),
        ("max_memory = 7.5 gb", "max_memory", 7.5),
        ("max_memory = '1.2.3 GB'", "max_memory", None),
        ("max_cpus = 11", "max_cpus", 11),
        ("max_time = '7.h'", "max_time", 7.0),
        ("params { genome = 'GRCh38' }", "genome", "GRCh38"),
        ("GENOME = 'GRCh38'", "genome", None),
        ("params { fasta = '/data/genome.fa' }", "fasta", "/data/genome.fa"),
        ("transcript_fasta=/t.fa\nfasta=/g.fa", "fasta", "/t.fa"),
        ("executor = 'slurm'", "executor", "slurm"),
        ("docker { enabled = true }", "container_engine", "docker"),
        ("conda { enabled = true }", "container_engine", "conda"),
        ("mamba{enabled=true}\nprofile = 'docker'", "container_engine", "mamba"),
        ("profile = 'docker,conda'", "container_engine", "conda"),
        ("profile x docker\nsingularity { enabled = true }\nprofile conda", "container_engine", "singularity"),
        ("nothing", "container_engine", None),
    ],
)
def test_config_setting(configs, text, name, value):
    assert settings(configs, text)[name] == value


def report(spark, sheet=None, config=None, manifest=(), free_gb=100.0, tools=("nextflow", "java", "docker"), work_dir=None):
    cases = spark.createDataFrame(
        [(1, None if sheet is None else 1, None if config is None else 1, 1, work_dir)],
        "case_id bigint, sheet_id bigint, config_id bigint, host_id bigint, work_dir string",
    )
    rows = lambda text: [] if text in (None, "absent") else [(1, text)]
    return ops.run(
        cases,
        spark.createDataFrame(rows(sheet), "sheet_id bigint, text string"),
        spark.createDataFrame(rows(config), "config_id bigint, text string"),
        spark.createDataFrame(list(manifest), "path string, size_bytes bigint"),
        spark.createDataFrame([(1, free_gb)], "host_id bigint, free_gb double"),
        spark.createDataFrame([(1, t) for t in tools], "host_id bigint, tool string"),
    )


FILES = (("/lab/k7_R1.fastq.gz", 10), ("/lab/k7_R2.fastq.gz", 10))


def test_ready_case(spark):
    row = report(spark, GOOD_SHEET, CONFIG, FILES).first()
    assert [(c.stage, c.check, c.status) for c in row.checks] == [
        (1, "Sample sheet validation", "pass"), (1, "FASTQ file existence", "pass"),
        (2, "Memory allocation", "pass"), (2, "CPU allocation", "pass"), (2, "Container/Environment engine", "pass"),
        (4, "Memory for STAR alignment", "pass"), (5, "Disk space", "pass"),
        (6, "Nextflow installed", "pass"), (6, "Docker available", "pass"), (6, "Java installed", "pass"),
    ]
    assert (row.verdict, row.n_pass, row.n_total) == ("pass", 10, 10)
    assert row.verdict_message == "🟢 READY TO LAUNCH — all 10 checks passed."
    text = {c.check: c.message for c in row.checks}
    assert text["Memory allocation"] == "max_memory = 32.0 GB"
    assert text["Memory for STAR alignment"] == "max_memory (32.0 GB) is sufficient for STAR on GRCh38 (needs ~32 GB)"
    assert text["Disk space"] == "100.0 GB free, estimated 11.2 GB needed — sufficient"


def test_failures_and_missing_files(spark):
    bad = "sample,fastq_1\nS1,/d/f.fastq.gz\n"
    row = report(spark, bad, "params { max_memory = '8.GB'\n genome = 'GRCh38'\n fasta = '/r.fa'", tools=("java",), free_gb=1.0).first()
    text = {c.check: (c.status, c.message, c.details) for c in row.checks}
    assert text["FASTQ file existence"] == ("fail", "1 of 1 FASTQ files not found on disk", ["/d/f.fastq.gz"])
    assert text["Config syntax"][1] == "Mismatched braces in config: 1 extra opening brace(s)"
    assert text["Memory for STAR alignment"][1] == (
        "STAR index for GRCh38 needs ~32 GB but max_memory is 8.0 GB. Increase to at least 32 GB or STAR will crash with OOM."
    )
    assert text["Genome FASTA"][:2] == ("fail", "Genome FASTA not found: /r.fa")
    assert text["Disk space"][1] == "Estimated 11.2 GB needed for 1 samples, but only 1.0 GB free at ."
    assert text["Nextflow installed"][0] == "fail"
    assert row.verdict == "fail" and row.verdict_message.startswith("🔴 NOT READY — ")


def test_inputs_absent_empty_or_not_requested(spark):
    row = report(spark, None, None).first()
    assert [(c.check, c.status) for c in row.checks][:2] == [("Sample sheet", "skip"), ("Config file", "skip")]
    assert row.verdict == "pass" and row.settings is None
    row = report(spark, "absent", "absent").first()
    assert [c.message for c in row.checks][:2] == ["Sample sheet not found: 1", "Config file not found: 1"]
    row = report(spark, "", "").first()
    assert [c.message for c in row.checks][:2] == ["No sample sheet provided", "No config provided — using defaults"]


def test_warnings_and_display_order(spark):
    df = report(spark, GOOD_SHEET, "params { max_memory = '2.GB' }", FILES, free_gb=None)
    row = df.first()
    assert row.verdict == "warn" and row.verdict_message.startswith("🟡 PROCEED WITH CAUTION — 2 warning(s).")
    shown = [r.status for r in ops.ordered_checks(df).orderBy("rank").collect()]
    assert shown == sorted(shown, key=["fail", "warn", "pass", "skip"].index)
    assert shown[-1] == "skip"  # unknown disk space


def test_work_dir_precedence(spark):
    disk = lambda **kw: [c.message for c in report(spark, free_gb=None, **kw).first().checks if c.check == "Disk space"][0]
    assert disk().endswith(": .")
    assert disk(config="outdir = '/o'").endswith(": /o")
    assert disk(config="outdir = '/o'", work_dir="/w").endswith(": /w")


def test_fastq_details_are_first_ten_in_sheet_order(spark, sheets):
    n = 30
    text = "sample,fastq_1,fastq_2\n" + "".join(f"S{i},/d/{i}_R1.fq.gz,s3://b/{i}.fq.gz\n" for i in range(n))
    manifest = spark.createDataFrame([("/d/0_R1.fq.gz", 1), ("/d/0_R1.fq.gz", 1), ("/d/3_R1.fq.gz", 1)], "path string, size_bytes bigint")
    row = ops.fastq_checks(sheet_ops.validate(sheets(text)), manifest).first().fastq_check
    assert row.message == "28 of 30 FASTQ files not found on disk"
    assert row.details == [f"/d/{i}_R1.fq.gz" for i in range(n) if i not in (0, 3)][:10]


def test_first_known_genome_wins(spark):
    names = ["custom_mm10_hg38", "GRCm39", "none", None, "GRCm39", ""]
    df = spark.createDataFrame(list(enumerate(names)), "config_id bigint, genome string")
    got = {r.config_id: r.known_genome and r.known_genome.ordinal for r in ops.with_genome(df).collect()}
    assert got == {0: 2, 1: 4, 2: None, 3: None, 4: 4, 5: None}


def test_genomes_of_a_table(spark, configs):
    """A genome of one's own, matched by the least ordinal, then name; nothing of the built-in list."""
    columns = "ordinal int, name string, star_gb double, bwa_gb double, hisat2_gb double, size_gb double"
    own = [(7, "Axolotl", 300.0, 1.0, 1.0, 32.0), (7, "Axo", 12.0, 1.0, 1.0, 3.0), (2, "lotl", 100.0, 1.0, 1.0, 9.0), (1, "", 1.0, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(own, columns)
    df = spark.createDataFrame([(1, "AXOLOTL_v2"), (2, "axon"), (3, "GRCh38")], "config_id bigint, genome string")
    got = {r.config_id: (r.star_gb, r.genome_size_gb) for r in ops.with_genome_figures(df, table).collect()}
    assert got == {1: (100.0, 9.0), 2: (12.0, 3.0), 3: (None, None)}
    settings = ops.config_settings(configs("params { genome = 'axon' \n max_memory = '8.GB' }"))
    row = ops.with_genome_figures(settings, table).select(F.expr(ops.memory_genome_check()).alias("c")).first().c
    assert row.status == "fail" and "~12 GB" in row.message
    used = {r.name: r.n_configs for r in ops.genome_usage(df, table.where("name != ''")).collect()}
    assert used["lotl"] == 1


def test_number_text(spark):
    df = spark.createDataFrame([(16.0,), (0.1,), (12345678.5,), (20000000.0,)], "x double")
    assert [r[0] for r in df.select(F.expr(ops.number_text("x"))).collect()] == ["16.0", "0.1", "12345678.5", "20000000.0"]
    odd = [0.0005, 0.00012345, 5e-05, 1.5e-10, 1e16, 1.25e17, 9999999999999998.0, 0.001, 0.0, -0.0005]
    df = df.sparkSession.createDataFrame([(x,) for x in odd], "x double")
    assert [r[0] for r in df.select(F.expr(ops.number_text("x"))).collect()] == [repr(x) for x in odd]


def test_config_report_needs_a_setting(spark, configs):
    df = ops.config_report(ops.config_settings(configs("nothing set", CONFIG)))
    row = df.first()
    assert df.count() == 1 and (row.memory, row.cpus, row.genome, row.engine) == ("32.0 GB", 16, "GRCh38", "docker")
