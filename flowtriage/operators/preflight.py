"""Launch readiness of cases: sheet, config, references, memory, disk and tools.

Facts about files and hosts come from inventory tables.  Checks of one sheet,
config or case stay in arrays of its row, so the shuffles are the look-ups
themselves: paths in the manifest, and cases with their sheet, config and host.
Those joins carry no text, and a path, sheet, config or host that many rows
share is split (:func:`flowtriage.functions.joins.lookup`).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtriage.functions import rx, sql
from flowtriage.functions.arrays import computed
from flowtriage.functions.catalog import (
    DEFAULT_GENOME_SIZE_GB,
    DISK_PER_SAMPLE_GB,
    ENGINE_ENABLED_REGEX,
    ENGINE_PROFILE_REGEX,
    ENGINES,
    EXECUTOR_REGEX,
    GENOME_REGEX,
    MAX_CPUS_REGEX,
    MAX_MEMORY_REGEX,
    MAX_TIME_REGEX,
    PATH_SETTING_REGEX,
    PATH_SETTINGS,
    REMOTE_SCHEMES,
)
from flowtriage.functions.joins import lookup
from flowtriage.operators import sheets as sheet_ops
from flowtriage.session import checkpoint_dir
from flowtriage.sources import dimensions

CHECK_TYPE = "struct<check: string, status: string, severity: string, message: string, details: array<string>>"
CHECKS_TYPE = f"array<{CHECK_TYPE}>"
SHOWN_MISSING = 10
REQUIRED_TOOLS = ("nextflow", "java")
_SEVERITY = {"pass": "info", "skip": "info", "warn": "warning", "fail": "critical"}
_REFERENCES = (  # setting, check name, message when missing
    ("fasta", "Genome FASTA", "Genome FASTA not found: {}"),
    ("gtf", "Gene annotation (GTF)", "GTF file not found: {}"),
    ("star_index", "STAR index", "STAR index not found: {}. It will need to be built (adds time to run)."),
    ("bwa_index", "BWA index", "BWA index not found: {}. It will need to be built (adds time to run)."),
    ("hisat2_index", "HISAT2 index", "HISAT2 index not found: {}. It will need to be built (adds time to run)."),
)


def check(name: str, status: str, message: str, severity: str | None = None) -> str:
    """SQL of a check struct; name and message are SQL expressions."""
    return sql.struct(
        check=name,
        status=sql.string(status),
        severity=severity or sql.string(_SEVERITY[status]),
        message=message,
        details="CAST(NULL AS ARRAY<STRING>)",
    )


def message(template: str) -> str:
    """SQL of a message whose ``{...}`` parts are SQL expressions."""
    parts = re.split(r"\{(.*?)\}", template)
    return "concat(" + ", ".join(p if i % 2 else sql.string(p) for i, p in enumerate(parts) if p) + ")"


def _found(name: str, status: str, template: str) -> str:
    return check(sql.string(name), status, message(template))


def check_array(*checks: str) -> Column:
    """The checks that apply, as an array column; a check is NULL if it does not."""
    return F.expr(f"CAST(array_compact(array({', '.join(checks)})) AS {CHECKS_TYPE})")


def number_text(value: str) -> str:
    """SQL of a double as text: an exponent of two digits from 1e16 and below 1e-4, none in between."""
    text = f"CAST({value} AS STRING)"
    short = f"regexp_replace(regexp_replace({text}, r'[.]0E', 'E'), r'E-(\\d)$', 'E-0$1')"
    scientific = f"replace(regexp_replace({short}, r'E(\\d)', 'e+$1'), 'E', 'e')"
    large = rf"regexp_replace(CAST(CAST({value} AS DECIMAL(38, 10)) AS STRING), r'([.]\d*[1-9]|[.]0)0+$', '$1')"
    small = f"regexp_replace(CAST(CAST({value} AS DECIMAL(38, 24)) AS STRING), r'0+$', '')"
    size = f"abs({value})"
    return (
        f"CASE WHEN {size} >= 1e16D OR {size} > 0 AND {size} < 1e-4D THEN {scientific} WHEN {size} >= 1e7D THEN {large}"
        f" WHEN {size} > 0 AND {size} < 1e-3D THEN {small} ELSE {text} END"
    )


# --- inputs ---------------------------------------------------------------


def ingest_status(cases: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """Join requested ids with the texts found; ``status`` is read, fail or skip.

    A text that is absent fails, no request or an empty text is skipped.
    """
    known = texts.select(key, F.lit(True).alias("_found"), (F.length("text") > 0).alias("_filled"))
    requested = F.col(key).isNotNull()
    return (
        lookup(cases.select("case_id", key), known, key, ["case_id"])
        .select(
            "case_id",
            key,
            F.when(requested & F.col("_found").isNull(), "fail")
            .when(F.coalesce("_filled", F.lit(False)), "read")
            .otherwise("skip")
            .alias("status"),
        )
    )


def sheet_input_check(status: str, path: str) -> str:
    return (
        f"CASE {status} WHEN 'fail' THEN {_found('Sample sheet file', 'fail', f'Sample sheet not found: {{{path}}}')}"
        f" WHEN 'skip' THEN {_found('Sample sheet', 'skip', 'No sample sheet provided')} END"
    )


def config_input_check(status: str, path: str) -> str:
    return (
        f"CASE {status} WHEN 'fail' THEN {_found('Config file', 'fail', f'Config file not found: {{{path}}}')}"
        f" WHEN 'skip' THEN {_found('Config file', 'skip', 'No config provided — using defaults')} END"
    )


# --- sample sheets --------------------------------------------------------


def _structure_array() -> Column:
    name = sql.string("Sample sheet validation")
    of_issue = (
        f"CASE WHEN i.type = 'critical' THEN {check(name, 'fail', 'i.message', 'i.type')}"
        f" ELSE {check(name, 'warn', 'i.message', 'i.type')} END"
    )
    passed = check(name, "pass", sql.string("Sample sheet structure is valid"))
    return F.expr(
        f"CASE WHEN size(issues) > 0 THEN CAST(transform(issues, i -> {of_issue}) AS {CHECKS_TYPE})"
        f" ELSE CAST(array({passed}) AS {CHECKS_TYPE}) END"
    )


def structure_checks(validated: DataFrame) -> DataFrame:
    """Issues of a validated sheet as checks, or one pass check."""
    return validated.select("sheet_id", _structure_array().alias("checks"))


def _written(rows: DataFrame) -> DataFrame:
    """Slim rows read several times, checkpointed so that their texts are parsed once."""
    checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def manifest_paths(manifest: DataFrame) -> DataFrame:
    """One row per known path."""
    return manifest.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))


def fastq_checks(validated: DataFrame, manifest: DataFrame) -> DataFrame:
    """Existence check of the local FASTQ paths of each sheet.

    Counts are aggregated before the shuffle on the sheet; of the missing
    paths only the first ten, in sheet order, are ever carried along.
    """
    slots = F.array(
        *[
            F.struct(F.col("row_num"), F.lit(i).alias("slot"), F.col(c).alias("path"))
            for i, c in enumerate(("fastq_1", "fastq_2"))
        ]
    )
    remote = reduce(lambda a, b: a | b, [F.col("path").startswith(s) for s in REMOTE_SCHEMES])
    paths = _written(
        sheet_ops.sheet_rows(validated)
        .select("sheet_id", F.inline(slots))
        .where((F.col("path") != "") & ~remote)
    )
    known = manifest_paths(manifest).select("path", F.lit(True).alias("_found"))
    looked_up = lookup(paths, known, "path", ["sheet_id", "row_num", "slot"]).select(
        "sheet_id", "row_num", "slot", "path", F.col("_found").isNull().alias("missing")
    )
    counts = looked_up.groupBy("sheet_id").agg(F.count("*").alias("n"), F.count_if("missing").alias("m"))
    order = Window.partitionBy("sheet_id").orderBy("row_num", "slot")
    first_missing = (
        looked_up.where("missing")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= SHOWN_MISSING)
        .groupBy("sheet_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "path"))).alias("_shown"))
    )
    name = "FASTQ file existence"
    result = (
        f"CASE WHEN m > 0 THEN {_found(name, 'fail', '{m} of {n} FASTQ files not found on disk')}"
        f" ELSE {_found(name, 'pass', 'All {n} FASTQ files found on disk')} END"
    )
    shown = F.transform("_shown", lambda s: s["path"])
    return counts.join(first_missing, "sheet_id", "left").select(
        "sheet_id", F.expr(f"CAST({result} AS {CHECK_TYPE})").withField("details", shown).alias("fastq_check")
    )


# --- configs --------------------------------------------------------------


def _engine(text: Column) -> Column:
    """First enabled engine in order of precedence, else the last one in a profile."""
    def found(template: str, engine: str) -> Column:
        return F.when(text.rlike(rx.IGNORE_CASE + template.format(engine=engine)), F.lit(engine))

    return F.coalesce(
        *[found(ENGINE_ENABLED_REGEX, e) for e in ENGINES], *[found(ENGINE_PROFILE_REGEX, e) for e in reversed(ENGINES)]
    )


def config_settings(configs: DataFrame) -> DataFrame:
    """The thirteen settings of each config, NULL when not set."""
    return _settings(configs)


def _settings(configs: DataFrame, *extra: Column) -> DataFrame:
    text = F.col("text")
    return configs.select(
        "config_id",
        rx.as_double(rx.first(text, MAX_MEMORY_REGEX)).alias("max_memory"),
        rx.as_long(rx.first(text, MAX_CPUS_REGEX)).alias("max_cpus"),
        rx.as_double(rx.first(text, MAX_TIME_REGEX)).alias("max_time"),
        _engine(text).alias("container_engine"),
        rx.first(text, GENOME_REGEX, ignore_case=False).alias("genome"),
        *[rx.first(text, PATH_SETTING_REGEX.format(key=k)).alias(k) for k in PATH_SETTINGS],
        rx.first(text, EXECUTOR_REGEX).alias("executor"),
        F.lit(None).cast("string").alias("profile"),
        *extra,
    )


SETTINGS = ("max_memory", "max_cpus", "max_time", "container_engine", "genome", *PATH_SETTINGS, "executor", "profile")


def brace_balance(text: Column) -> Column:
    """Opening minus closing braces."""

    def count(brace: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(brace), F.lit("")))

    return count("{") - count("}")


def brace_check() -> str:
    direction = "CASE WHEN balance > 0 THEN 'extra opening' ELSE 'extra closing' END"
    mismatch = _found("Config syntax", "fail", f"Mismatched braces in config: {{abs(balance)}} {{{direction}}} brace(s)")
    return f"CASE WHEN balance <> 0 THEN {mismatch} END"


def memory_check() -> str:
    name, gb = "Memory allocation", number_text("max_memory")
    return (
        "CASE WHEN coalesce(max_memory, 0) = 0 THEN "
        + _found(name, "warn", "max_memory not found in config — pipeline will use defaults")
        + " WHEN max_memory < 4 THEN "
        + _found(name, "warn", f"max_memory is very low ({{{gb}}} GB). Most NGS tools need at least 8 GB.")
        + " ELSE "
        + _found(name, "pass", f"max_memory = {{{gb}}} GB")
        + " END"
    )


def cpu_check() -> str:
    return f"CASE WHEN max_cpus <> 0 THEN {_found('CPU allocation', 'pass', 'max_cpus = {max_cpus}')} END"


def engine_check() -> str:
    name = "Container/Environment engine"
    none = (
        "No container engine detected in config (docker/singularity/conda). "
        "Pipeline may fail if tools aren't installed locally."
    )
    return (
        f"CASE WHEN container_engine IS NOT NULL THEN {_found(name, 'pass', 'Using {container_engine}')}"
        f" ELSE {_found(name, 'warn', none)} END"
    )


def reference_checks(settings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Existence checks of the configured reference files, one array per config."""
    wanted = ", ".join(
        f"CASE WHEN {setting} IS NOT NULL THEN "
        + sql.struct(ord=str(i), name=sql.string(name), path=setting, absent=message(absent.replace("{}", f"{{{setting}}}")))
        + " END"
        for i, (setting, name, absent) in enumerate(_REFERENCES)
    )
    size = "format_string('%.2f', size_bytes / 1073741824D)"
    result = (
        f"CASE WHEN size_bytes IS NULL THEN {check('name', 'fail', 'absent')}"
        f" WHEN ord = 0 THEN {check('name', 'pass', message(f'Found: {{path}} ({{{size}}} GB)'))}"
        f" ELSE {check('name', 'pass', message('Found: {path}'))} END"
    )
    # At most one entry per reference setting is collected for a config.
    paths = _written(settings.select("config_id", F.expr(f"inline(array_compact(array({wanted})))")))
    return (
        lookup(paths, manifest_paths(manifest), "path", ["config_id", "ord"])
        .groupBy("config_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", F.expr(f"CAST({result} AS {CHECK_TYPE})").alias("c")))).alias("_c"))
        .select("config_id", F.transform("_c", lambda x: x["c"]).alias("reference_checks"))
    )


def with_genome(settings: DataFrame, genomes: DataFrame | None = None) -> DataFrame:
    """Add ``known_genome``: the first row of ``genomes`` whose name the configured genome contains, or NULL.

    ``genomes`` (ordinal, name and figures) may be any table, so an installation
    can bring its own.  Each distinct configured name is held against all of
    them once, and the least ordinal wins, by name where that is equal; configs
    then look their own name up, however many share it.
    """
    genomes = dimensions.genomes(settings.sparkSession) if genomes is None else genomes
    names = settings.where(F.col("genome").isNotNull()).select("genome").distinct()
    row = F.struct(*[F.col(c) for c in ("ordinal", "name", *[c for c in genomes.columns if c not in ("ordinal", "name")])])
    held = names.join(genomes.where(F.col("name") != ""), F.contains(F.lower("genome"), F.lower("name")))
    first = held.groupBy("genome").agg(F.min(row).alias("known_genome"))
    return lookup(settings, first, "genome", ["config_id"])


def genome_usage(settings: DataFrame, genomes: DataFrame) -> DataFrame:
    """Known genomes with the number of configs that resolve to each."""
    resolved = F.coalesce(F.col("known_genome.ordinal"), F.lit(-1))
    used = with_genome(settings.select("config_id", "genome"), genomes).groupBy(resolved.alias("ordinal")).agg(F.count("*").alias("n_configs"))
    return genomes.join(used, "ordinal", "left").select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "name", "star_gb", "bwa_gb", "hisat2_gb", "size_gb",
        F.coalesce("n_configs", F.lit(0)).alias("n_configs"),
    )


def memory_genome_check() -> str:
    """Needs ``star_gb`` of the configured genome beside the settings."""
    name, gb, need = "Memory for STAR alignment", number_text("max_memory"), "CAST(star_gb AS BIGINT)"
    low = (
        f"STAR index for {{genome}} needs ~{{{need}}} GB but max_memory is {{{gb}}} GB. "
        f"Increase to at least {{{need}}} GB or STAR will crash with OOM."
    )
    enough = f"max_memory ({{{gb}}} GB) is sufficient for STAR on {{genome}} (needs ~{{{need}}} GB)"
    return (
        "CASE WHEN max_memory <> 0 AND star_gb IS NOT NULL THEN CASE WHEN max_memory < star_gb THEN "
        + _found(name, "fail", low)
        + " ELSE "
        + _found(name, "pass", enough)
        + " END END"
    )


# --- hosts ----------------------------------------------------------------


def with_disk_need(frame: DataFrame) -> DataFrame:
    """Add the estimated need, its sample count and the folder of each case; ``frame`` has ``genome_size_gb``."""
    sized = frame.withColumns(
        {
            "disk_samples": F.coalesce("n_samples", F.lit(0).cast("bigint")),
            "disk_dir": F.expr("coalesce(nullif(work_dir, ''), nullif(outdir, ''), '.')"),
            "_size": F.coalesce("genome_size_gb", F.lit(DEFAULT_GENOME_SIZE_GB)),
        }
    )
    need = F.bround(F.col("disk_samples") * DISK_PER_SAMPLE_GB + F.col("_size") * 2, 1)
    return sized.withColumn("disk_need_gb", need).drop("_size")


def disk_check() -> str:
    name, free, need = "Disk space", number_text("free_gb"), number_text("disk_need_gb")
    return (
        "CASE WHEN free_gb IS NULL THEN "
        + _found(name, "skip", "Could not check disk space at: {disk_dir}")
        + " WHEN free_gb < disk_need_gb THEN "
        + _found(name, "fail", f"Estimated {{{need}}} GB needed for {{disk_samples}} samples, but only {{{free}}} GB free at {{disk_dir}}")
        + " WHEN free_gb < disk_need_gb * 1.5D THEN "
        + _found(name, "warn", f"Tight on space: {{{free}}} GB free, estimated {{{need}}} GB needed. Consider cleaning old work directories first.")
        + " ELSE "
        + _found(name, "pass", f"{{{free}}} GB free, estimated {{{need}}} GB needed — sufficient")
        + " END"
    )


def host_tool_sets(host_tools: DataFrame) -> DataFrame:
    """Tools of interest per host; at most one entry per known tool."""
    known = F.col("tool").isin(*REQUIRED_TOOLS, *ENGINES)
    return host_tools.where(known).groupBy("host_id").agg(F.collect_set("tool").alias("tools"))


def tool_checks() -> list[str]:
    """Manager, engine (if configured) and Java against the host's ``tools``."""

    def probe(name: str, tool: str, passed: str, failed: str) -> str:
        return (
            f"CASE WHEN coalesce(array_contains(tools, {tool}), false) THEN {check(name, 'pass', message(passed))}"
            f" ELSE {check(name, 'fail', message(failed))} END"
        )

    engine = probe(
        "concat(initcap(container_engine), ' available')", "container_engine",
        "{container_engine} is available on PATH", "{container_engine} is configured but not found on PATH",
    )
    return [
        probe("'Nextflow installed'", "'nextflow'", "Nextflow is available on PATH",
              "Nextflow not found on PATH. Install from https://nextflow.io"),
        f"CASE WHEN container_engine IS NOT NULL THEN {engine} END",
        probe("'Java installed'", "'java'", "Java is available (required by Nextflow)",
              "Java not found — required by Nextflow"),
    ]


# --- reports --------------------------------------------------------------


def sheet_side(sheets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per sheet: whether it holds text, its number of samples and all its checks."""
    validated = sheet_ops.validate(sheets)
    base = validated.select("sheet_id", "given", _samples().alias("n_samples"), _structure_array().alias("_structure"))
    return base.join(fastq_checks(validated, manifest), "sheet_id", "left").select(
        "sheet_id",
        F.col("given").alias("sheet_given"),
        "n_samples",
        F.when(F.col("fastq_check").isNull(), F.col("_structure"))
        .otherwise(F.concat("_structure", F.array("fastq_check")))
        .alias("sheet_checks"),
    )


def _samples() -> Column:
    return F.coalesce(F.col("summary.total_samples"), F.lit(0).cast("bigint"))


def sample_side(sheets: DataFrame) -> DataFrame:
    """The part of :func:`sheet_side` that the disk estimate needs."""
    return sheet_ops.validate(sheets).select(
        "sheet_id", F.col("given").alias("sheet_given"), _samples().alias("n_samples")
    )


def config_side(configs: DataFrame, manifest: DataFrame, genomes: DataFrame | None = None) -> DataFrame:
    """Per config: whether it holds text, its settings and its checks."""
    given = configs.withColumn("config_given", F.length("text") > 0)
    settings = _settings(given, F.col("config_given"), brace_balance(F.col("text")).alias("balance"))
    side = with_genome_figures(settings, genomes).withColumns(
        {
            "config_checks": check_array(brace_check(), memory_check(), cpu_check(), engine_check()),
            "genome_checks": check_array(memory_genome_check()),
        }
    )
    return side.drop("balance", "star_gb").join(reference_checks(side, manifest), "config_id", "left")


def with_genome_figures(settings: DataFrame, genomes: DataFrame | None = None) -> DataFrame:
    """Add ``star_gb`` and ``genome_size_gb`` of the configured genome."""
    known = with_genome(settings, genomes)
    return known.withColumns({"star_gb": F.col("known_genome.star_gb"), "genome_size_gb": F.col("known_genome.size_gb")}).drop("known_genome")


def host_side(hosts: DataFrame, host_tools: DataFrame) -> DataFrame:
    return hosts.join(host_tool_sets(host_tools), "host_id", "left")


def case_frame(cases: DataFrame, sheet: DataFrame | None, config: DataFrame, host: DataFrame) -> DataFrame:
    """Cases with what is known about their sheet, config and host."""
    framed = cases if sheet is None else lookup(cases, sheet, "sheet_id", ["case_id"])
    framed = lookup(framed, config, "config_id", ["case_id"], keys=cases)
    return lookup(framed, host, "host_id", ["case_id"], keys=cases)


def _status(requested: str, given: str) -> Column:
    return F.expr(f"CASE WHEN {requested} IS NOT NULL AND {given} IS NULL THEN 'fail' WHEN {given} THEN 'read' ELSE 'skip' END")


def _no_checks() -> Column:
    return F.expr(f"CAST(array() AS {CHECKS_TYPE})")


def _with_stage(checks: Column, number: int) -> Column:
    return F.transform(checks, lambda c: c.withField("stage", F.lit(number).cast("bigint")))


def _with_status(status: str) -> Column:
    return F.filter("checks", lambda c: c["status"] == status)


def report(frame: DataFrame) -> DataFrame:
    """One report per case: ``checks`` in stage order, counts and verdict."""
    known = with_disk_need(frame).withColumns(
        {"sheet_status": _status("sheet_id", "sheet_given"), "config_status": _status("config_id", "config_given")}
    )
    has_config = F.col("config_status") == "read"
    stages = [
        F.when(F.col("sheet_status") == "read", F.col("sheet_checks")).otherwise(
            check_array(sheet_input_check("sheet_status", "sheet_id"))
        ),
        F.when(has_config, F.col("config_checks")).otherwise(
            check_array(config_input_check("config_status", "config_id"))
        ),
        F.coalesce(F.when(has_config, F.col("reference_checks")), _no_checks()),
        F.coalesce(F.when(has_config, F.col("genome_checks")), _no_checks()),
        check_array(disk_check()),
        check_array(*tool_checks()),
    ]
    numbered = [_with_stage(checks, number) for number, checks in enumerate(stages, start=1)]
    settings = F.when(has_config, F.struct(*SETTINGS))
    reported = known.select("case_id", F.concat(*numbered).alias("checks"), settings.alias("settings"))
    counted = reported.withColumns(
        {f"n_{status}": F.size(_with_status(status)).cast("bigint") for status in _SEVERITY}
    ).withColumn("n_total", F.size("checks").cast("bigint"))
    failing, warning = F.col("n_fail") > 0, F.col("n_warn") > 0
    return counted.withColumns(
        {
            "verdict": F.when(failing, "fail").when(warning, "warn").otherwise("pass"),
            "verdict_message": F.when(
                failing,
                F.format_string("🔴 NOT READY — %d critical issue(s) found. Fix these before launching.", "n_fail"),
            )
            .when(
                warning,
                F.format_string("🟡 PROCEED WITH CAUTION — %d warning(s). Review before launching.", "n_warn"),
            )
            .otherwise(F.format_string("🟢 READY TO LAUNCH — all %d checks passed.", "n_pass")),
        }
    )


def run(
    cases: DataFrame,
    sheets: DataFrame,
    configs: DataFrame,
    manifest: DataFrame,
    hosts: DataFrame,
    host_tools: DataFrame,
    genomes: DataFrame | None = None,
) -> DataFrame:
    """All checks of all cases, against the known or the given ``genomes``; see :func:`report`."""
    config = config_side(configs, manifest, genomes)
    return report(case_frame(cases, sheet_side(sheets, manifest), config, host_side(hosts, host_tools)))


def all_checks(reports: DataFrame) -> DataFrame:
    """One row per check, ``ord`` from 1 in emission order."""
    return reports.select("case_id", F.posexplode(computed("checks")).alias("pos", "c")).select(
        "case_id", "c.stage", (F.col("pos") + 1).cast("bigint").alias("ord"), "c.check", "c.status", "c.severity",
        "c.message", "c.details",
    )


def ordered_checks(reports: DataFrame) -> DataFrame:
    """Checks ranked for display: fail, warn, pass, skip, then emission order."""
    by_status = F.concat(*[_with_status(status) for status in ("fail", "warn", "pass", "skip")])
    return reports.select("case_id", F.posexplode(by_status).alias("pos", "c")).select(
        "case_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "c.check", "c.status", "c.message"
    )


def config_report(settings: DataFrame) -> DataFrame:
    """Memory, CPUs, genome and engine of the configs that set anything."""
    anything = F.coalesce(*[F.col(c).cast("string") for c in SETTINGS]).isNotNull()
    memory = F.when(F.col("max_memory") != 0, F.concat(F.expr(number_text("max_memory")), F.lit(" GB")))
    return settings.where(anything).select(
        "config_id",
        memory.alias("memory"),
        F.when(F.col("max_cpus") != 0, F.col("max_cpus")).alias("cpus"),
        "genome",
        F.col("container_engine").alias("engine"),
    )
