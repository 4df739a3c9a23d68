"""Corpora of logs, sheets and configs derived from the star-schema tables.

Each document is rendered from its own source row, so building a corpus is one
narrow projection: nothing is grouped or collected, and a hot key cannot make a
document or a task grow.  The text is portable SQL because the correctness
check renders the same corpus in a second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROCESS_LINES = 5
# Rows of a narrow table that one task renders to texts, some 1 KB each.
TASK_ROWS = 20_000


def _process_line(k: int) -> str:
    """One progress line; every 7th order puts two processes on one line."""
    done = f"(o_orderkey * 7 + o_custkey * 3 + {k} * 11) % 51"
    return f"""CASE WHEN o_orderkey % 6 < {k} THEN '' ELSE concat(
  '[', lpad(lower(hex((o_custkey + {k}) % 256)), 2, '0'), '/', lpad(lower(hex(o_orderkey % 16777216)), 6, '0'),
  '] process > STEP_{k} (S', cast(o_custkey as string), ') [', lpad(cast({done} * 2 as string), 3, ' '), '%] ',
  cast({done} as string), ' of ', CASE WHEN o_orderkey % 41 = 0 THEN '0' ELSE '50' END,
  CASE WHEN o_orderkey % 7 = 3 THEN '  ' ELSE chr(10) END) END"""


RUNS_SQL = f"""
SELECT o_orderkey AS run_id,
 concat('nf-core/pipe', cast(o_custkey % 7 as string)) AS pipeline,
 CASE o_orderstatus WHEN 'F' THEN 'local' WHEN 'O' THEN 'slurm' ELSE 'k8s' END AS executor,
 CASE o_orderkey % 18 WHEN 0 THEN 'clean' WHEN 1 THEN 'memory_exceeded' WHEN 2 THEN 'missing_file'
  WHEN 3 THEN 'container_issue' WHEN 4 THEN 'reference_index' WHEN 5 THEN 'permission_issue'
  WHEN 6 THEN 'failed_process' WHEN 7 THEN 'invalid_parameter' WHEN 8 THEN 'disk_space'
  WHEN 9 THEN 'starsolo_memory' WHEN 10 THEN 'barcode_whitelist_missing' WHEN 11 THEN 'wrong_chemistry'
  WHEN 12 THEN 'empty_cell_output' WHEN 13 THEN 'cellranger_fastq_naming' WHEN 14 THEN 'kallisto_empty_bus'
  WHEN 15 THEN 'anndata_version_mismatch' WHEN 16 THEN 'scrna_genome_mismatch' ELSE 'memory_exceeded' END AS label,
 concat('N E X T F L O W  ~  version 23.10.', cast(o_orderkey % 7 as string), chr(10),
  'Launching `nf-core/pipe', cast(o_custkey % 7 as string), '` [run] DSL2 - revision: 3.', cast(o_custkey % 5 as string), chr(10),
  {",".join(_process_line(k) for k in range(1, _PROCESS_LINES + 1))},
  CASE WHEN o_orderkey % 7 = 3 THEN chr(10) ELSE '' END,
  CASE WHEN o_orderkey % 18 = 0 THEN '' ELSE concat('Error executing process > ''STEP_', cast(1 + o_orderkey % 7 as string), '''', chr(10), 'Caused by:', chr(10)) END,
  CASE o_orderkey % 18 WHEN 0 THEN 'Pipeline completed successfully!'
   WHEN 1 THEN concat('  Process requirement exceeds available memory -- req: ', cast(16 + o_orderkey % 48 as string), ' GB; avail: ', cast(4 + o_orderkey % 9 as string), '.5 GB')
   WHEN 2 THEN concat('  No such file or directory: /data/', cast(o_custkey as string), '.fa', chr(10), '  Path does not exist')
   WHEN 3 THEN concat('  Unable to pull image x', chr(10), '  OCI runtime create failed')
   WHEN 4 THEN concat('  incompatible genome index', chr(10), '  samtools faidx first')
   WHEN 5 THEN concat('  EACCES: Permission denied', chr(13), chr(10), '  Operation not permitted')
   WHEN 6 THEN '  Task STEP failed with exit code 1'
   WHEN 7 THEN concat('  ERROR ~ Schema validation of params', chr(10), '  Unknown parameter: --x')
   WHEN 8 THEN concat('  No space left on device', chr(10), '  ENOSPC: full')
   WHEN 9 THEN '  STARsolo killed with exit code 137' WHEN 10 THEN '  soloCBwhitelist file not found: /w.txt'
   WHEN 11 THEN '  Chemistry 10xv2 not recognized' WHEN 12 THEN '  no cells detected' WHEN 13 THEN '  cellranger: invalid fastq name'
   WHEN 14 THEN '  BUS file is empty' WHEN 15 THEN '  anndata version incompatible' WHEN 16 THEN '  contig chr1 not in genome'
   ELSE concat('  java.lang.OutOfMemoryError: heap', chr(10), '    at a.b.C(D.java:1)', chr(10), '  Cannot allocate memory', chr(10), '  SIGKILL', chr(10), '  WARN: Disk quota exceeded') END, chr(10),
  CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN concat('Command exit status: -', chr(10))
   WHEN o_orderkey % 4 = 2 THEN concat('Command exit status: ', CASE o_orderkey % 5 WHEN 0 THEN '137' WHEN 1 THEN '1' WHEN 2 THEN '127' WHEN 3 THEN '126' ELSE '139' END, chr(10))
   ELSE concat('Command exit status: 1)', chr(10)) END,
  CASE WHEN o_orderkey % 18 = 0 THEN '' ELSE concat('Command executed:', chr(10), '  STAR --x ', cast(o_custkey as string), chr(10), 'Work dir: /w/', cast(o_orderkey as string), chr(10)) END) AS text
FROM {{orders}}"""


# One data line of a sheet; the row key ``n`` also names its FASTQ files in the manifest.
_SHEET_ROW = """CASE WHEN c_custkey % 9 < k THEN '' ELSE concat(
  CASE WHEN c_custkey % 23 = 0 THEN concat(<strand>, ', ', <sample>, ',', <fq2>, ',', <fq1>)
   WHEN c_custkey % 31 = 0 THEN <sample>
   ELSE concat(<sample>, ',', <fq1>, ',', <fq2>, ',', <strand>) END, chr(10)) END"""
_SHEET_CELLS = {
    "<sample>": "CASE WHEN <n> % 11 = 0 THEN '' ELSE concat('S', cast(<n> * 7 % 5 as string)) END",
    "<fq1>": """CASE WHEN <n> % 13 = 0 THEN '' WHEN <n> % 7 = 0 THEN concat('/d/', cast(<n> as string), '_R1.bam')
  WHEN <n> % 9 = 0 THEN concat('s3://b/', cast(<n> as string), '_R1.fastq.gz') ELSE concat('/d/', cast(<n> as string), '_R1.fastq.gz') END""",
    "<fq2>": """CASE WHEN <n> % 3 = 0 THEN '' WHEN <n> % 10 = 1 THEN concat('/d/x', cast(<n> as string), '_R2.fq.gz')
  WHEN <n> % 17 = 0 THEN concat('/d/', cast(<n> as string), '_R2.bam') ELSE concat('/d/', cast(<n> as string), '_R2.fastq.gz') END""",
    "<strand>": """CASE <n> % 6 WHEN 0 THEN 'forward' WHEN 1 THEN 'Reverse' WHEN 2 THEN 'unstranded' WHEN 3 THEN 'auto'
  WHEN 4 THEN '' ELSE 'banana' END""",
    "<n>": "(c_custkey * 10 + k)",
}
for _cell, _sql in _SHEET_CELLS.items():
    _SHEET_ROW = _SHEET_ROW.replace(_cell, _sql)

SHEETS_SQL = """
SELECT c_custkey AS sheet_id, concat(
  CASE WHEN c_custkey % 19 = 0 THEN 'sample,fastq_1' WHEN c_custkey % 23 = 0 THEN 'Strandedness, Sample ,fastq_2,fastq_1'
   WHEN c_custkey % 37 = 0 THEN 'sample,fastq_1,fastq_2,strandedness,sample'
   ELSE 'sample,fastq_1,fastq_2,strandedness' END, chr(10),
  CASE WHEN c_custkey % 5 = 0 THEN concat('  ', chr(10)) ELSE '' END,
  CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 29 = 0 THEN 'S1,/d/1_R1.fastq.gz,/d/1_R2.fastq.gz,auto'
   ELSE <rows> END, chr(10)) AS text
FROM {customer}"""
_SPARK_ROWS = f"array_join(transform(sequence(1, 8), k -> {_SHEET_ROW}), '')"
_ORACLE_ROWS = f"array_to_string(list_transform(range(1, 9), lambda k: {_SHEET_ROW}), '')"

CONFIGS_SQL = """
SELECT p_partkey AS config_id, concat('params ', chr(123), chr(10),
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('  max_memory = ''', cast(2 + p_partkey % 60 as string), '.GB''', chr(10)) END,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('  max_cpus = ', cast(p_partkey % 16 as string), chr(10)) END,
  CASE WHEN p_partkey % 7 = 0 THEN concat('  max_time = "', cast(p_partkey % 48 as string), '.5 h"', chr(10)) ELSE '' END,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '  genome = ''GRCh38''' WHEN 2 THEN '  genome = "mm10_v2"'
   WHEN 3 THEN '  genome = ''TAIR10''' WHEN 4 THEN '  genome = ''hg19''' ELSE '  genome = ''custom''' END, chr(10),
  CASE WHEN p_partkey % 3 = 0 THEN concat('  fasta = ''/ref/', cast(p_partkey as string), '.fa''', chr(10), '  gtf = ''/ref/', cast(p_partkey as string), '.gtf''', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 8 = 1 THEN concat('  STAR_index = /ref/', cast(p_partkey as string), '.fa', chr(10), '  bwa_index = "/ref/none"', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 8 = 2 THEN concat('  hisat2_index = /ref/', cast(p_partkey as string), '.gtf', chr(10), '  transcript_fasta = ''/ref/t.fa''', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 11 = 0 THEN concat('  outdir = ''/out/', cast(p_partkey as string), '''', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 9 = 0 THEN concat('process.executor = ''slurm''', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 9 THEN concat(chr(125), chr(125), chr(10)) ELSE concat(chr(125), chr(10)) END,
  CASE p_partkey % 5 WHEN 0 THEN concat('docker ', chr(123), ' enabled = true ', chr(125)) WHEN 1 THEN concat('conda ', chr(123), ' enabled = true ', chr(125)) WHEN 2 THEN 'profile = ''docker,conda'''
   WHEN 3 THEN concat('profile = ''podman''', chr(10), 'singularity ', chr(123), ' enabled = true ', chr(125)) ELSE '' END, chr(10)) AS text
FROM {part}"""

MANIFEST_SQL = """
SELECT concat('/d/', cast(o_orderkey as string), '_R1.fastq.gz') AS path, o_orderkey * 1000 AS size_bytes FROM {orders} WHERE o_orderkey % 4 <> 0
UNION ALL SELECT concat('/d/', cast(o_orderkey as string), '_R2.fastq.gz'), o_orderkey * 1000 FROM {orders} WHERE o_orderkey % 4 <> 0
UNION ALL SELECT concat('/ref/', cast(p_partkey as string), '.fa'), p_partkey * 45678901 FROM {part} WHERE p_partkey % 5 <> 0
UNION ALL SELECT concat('/ref/', cast(p_partkey as string), '.gtf'), p_partkey * 1000 FROM {part} WHERE p_partkey % 7 <> 0"""

# A case names a sheet, a config and a host by key.  Negative keys are in no
# other table, like a request for a file that does not exist.  Cases are dealt
# to all hosts, and one number beyond them names none.
CASES_SQL = """
SELECT c_custkey AS case_id,
 CASE WHEN c_custkey % 12 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN -1 - c_custkey ELSE c_custkey END AS sheet_id,
 CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 50 = 3 THEN -1 - c_custkey ELSE c_custkey END AS config_id,
 CAST(c_custkey % (1 + (SELECT count(*) FROM {supplier})) AS bigint) AS host_id,
 CASE WHEN c_custkey % 7 = 0 THEN '/scratch' ELSE NULL END AS work_dir
FROM {customer}"""

HOSTS_SQL = """
SELECT s_suppkey AS host_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(5 + s_suppkey * 7 % 60 AS double) END AS free_gb FROM {supplier}"""

HOST_TOOLS_SQL = " UNION ALL ".join(
    f"SELECT s_suppkey AS host_id, '{tool}' AS tool FROM {{supplier}} WHERE s_suppkey % 3 = 0 OR (s_suppkey + {i}) % 5 <> 0"
    for i, tool in enumerate(("nextflow", "java", "docker", "singularity", "podman", "conda", "mamba"))
)

# Index rows of files beside the corpus, some of them naming absent files.
LABEL_INDEX_SQL = """
SELECT concat('run_', cast(CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey ELSE o_orderkey END as string), '.log') AS filename,
 CASE WHEN o_orderkey % 2 = 0 THEN 'failed_process' ELSE 'clean' END AS label,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('custom/p', cast(o_custkey % 4 as string)) END AS pipeline,
 CASE o_orderstatus WHEN 'F' THEN 'local' ELSE 'docker' END AS executor
FROM {orders}"""

CORPORA = {  # name: (SQL, keys of the tables it reads)
    "runs": (RUNS_SQL, {"orders": "o_orderkey"}),
    "sheets": (SHEETS_SQL, {"customer": "c_custkey"}),
    "configs": (CONFIGS_SQL, {"part": "p_partkey"}),
    "manifest": (MANIFEST_SQL, {"orders": "o_orderkey", "part": "p_partkey"}),
    "cases": (CASES_SQL, {"customer": "c_custkey", "supplier": "s_suppkey"}),
    "hosts": (HOSTS_SQL, {"supplier": "s_suppkey"}),
    "host_tools": (HOST_TOOLS_SQL, {"supplier": "s_suppkey"}),
    "label_index": (LABEL_INDEX_SQL, {"orders": "o_orderkey"}),
}
_TEXT_CORPORA = ("runs", "sheets", "configs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """Spread a scan some of whose tasks would hold more than ``rows`` rows, or that has fewer tasks than the cluster has cores.

    Text work costs far more CPU than its input costs I/O, and a Parquet row
    group is read by one task however many splits its file is cut into.  So
    what counts is the rows of a task, which the footers tell without reading
    a column; the number of tasks grows with the rows, not with the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"))
    total, most, tasks = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    if most <= rows and tasks >= cores:
        return df
    return df.repartition(max(cores, -(-total // rows)), key)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of :data:`CORPORA`, lazily rendered from its star-schema tables."""
    sql, keys = CORPORA[name]
    sql = sql.replace("<rows>", _SPARK_ROWS)
    tables = {t: table(spark, sf_dir, t) for t in keys}
    if name in _TEXT_CORPORA:
        tables = {t: spread(df, keys[t]) for t, df in tables.items()}
    return spark.sql(sql, **tables)


def oracle_cte(name: str) -> str:
    """The same corpus as SQL over the registered tables."""
    sql, keys = CORPORA[name]
    sql = sql.replace("<rows>", _ORACLE_ROWS)
    return sql.format(**{t: t for t in keys})
