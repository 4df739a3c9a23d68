"""Failure catalogue and domain constants.

The catalogue is plain data: sources turn it into a dimension table, operators
turn it into Column expressions.  Callers extend it by passing a longer list.
"""

from __future__ import annotations

from typing import NamedTuple


class Category(NamedTuple):
    id: str
    label: str
    family: str
    severity: str
    icon: str
    cause: str
    fix: str
    command: str
    regexes: tuple[str, ...]


# ---------------------------------------------------------------------------
# Identifiers, texts and regexes of the sixteen categories.
# Matching is case-insensitive; list order breaks ranking ties.
# ---------------------------------------------------------------------------
CATEGORIES: list[Category] = [
    Category(
        id="memory_exceeded",
        label="Memory Exceeded",
        family="general",
        severity="critical",
        icon="🧠",
        cause="Process requires more RAM than allocated or available on the execution node.",
        fix="Increase memory in nextflow.config (e.g., process { memory = '16.GB' }), use a larger instance, or enable retry with errorStrategy 'retry' and maxRetries 3.",
        command="""# In nextflow.config:
process {
  memory = { 8.GB * task.attempt }
  errorStrategy = 'retry'
  maxRetries = 3
}""",
        regexes=(
            r"Process requirement exceeds available memory",
            r"java\.lang\.OutOfMemoryError",
            r"Cannot allocate memory",
            r"oom-kill",
            r"Killed\s+process",
            r"memory limit",
            r"SIGKILL",
            r"exceeded memory",
        ),
    ),
    Category(
        id="missing_file",
        label="Missing File",
        family="general",
        severity="critical",
        icon="📁",
        cause="An expected input file, reference, or index is missing or the path is incorrect.",
        fix="Verify file paths in your sample sheet and config. Check that reference genomes and indices exist. Ensure symlinks are valid.",
        command="""# Check file existence:
ls -la /path/to/missing/file

# Verify sample sheet paths:
awk -F',' '{print $2}' samplesheet.csv | while read f; do
  [ ! -f "$f" ] && echo "MISSING: $f"
done""",
        regexes=(
            r"No such file or directory",
            r"FileNotFoundException",
            r"Missing (input|output) file",
            r"Path does not exist",
            r"Unable to access",
            r"file not found",
        ),
    ),
    Category(
        id="container_issue",
        label="Container / Environment Issue",
        family="general",
        severity="high",
        icon="🐳",
        cause="Docker/Singularity container or Conda/Mamba environment failed to pull, create, or execute.",
        fix="For containers: check the engine is installed and running, verify network access. For Conda/Mamba: check conda is installed, channels are reachable, and there are no dependency conflicts. Try creating the environment manually first.",
        command="""# Test container pull:
docker pull nfcore/rnaseq:latest
# Or Singularity:
singularity pull docker://nfcore/rnaseq:latest

# Test Conda environment:
conda create -n test_env bioconda::star
# Check Conda config:
conda config --show channels
conda info""",
        regexes=(
            r"Unable to pull (image|container)",
            r"docker.*not found",
            r"singularity.*error",
            r"Container.*failed",
            r"OCI runtime",
            r"permission denied.*docker",
            r"FATAL.*container",
            r"Failed to create Conda environment",
            r"CondaError",
            r"conda.*create.*failed",
            r"mamba.*error",
            r"Failed to create.*environment",
        ),
    ),
    Category(
        id="reference_index",
        label="Reference / Index Issue",
        family="general",
        severity="high",
        icon="🧬",
        cause="Reference genome index is missing, incompatible, or corrupted.",
        fix="Rebuild the genome index with the correct tool version. Ensure reference FASTA matches the index.",
        command="""# Rebuild STAR index:
STAR --runMode genomeGenerate \\
  --genomeDir /path/to/star_index \\
  --genomeFastaFiles /path/to/genome.fa \\
  --sjdbGTFfile /path/to/genes.gtf

# Rebuild samtools index:
samtools faidx genome.fa""",
        regexes=(
            r"genome index",
            r"STAR.*genomeGenerate",
            r"hisat2-build",
            r"bowtie2-build",
            r"faidx",
            r"\.fai.*not found",
            r"index.*missing",
            r"incompatible genome",
        ),
    ),
    Category(
        id="permission_issue",
        label="Permission Denied",
        family="general",
        severity="high",
        icon="🔒",
        cause="Insufficient file system permissions to read inputs, write outputs, or execute binaries.",
        fix="Check ownership and permissions on work dir, output dir, and input files.",
        command="""# Fix work directory permissions:
chmod -R 755 work/
chown -R $USER:$GROUP work/

# Check output directory:
ls -la results/""",
        regexes=(
            r"Permission denied",
            r"Operation not permitted",
            r"Access denied",
            r"cannot open.*permission",
            r"EACCES",
        ),
    ),
    Category(
        id="failed_process",
        label="Failed Process",
        family="general",
        severity="critical",
        icon="💥",
        cause="A pipeline process exited with a non-zero status code.",
        fix="Check .command.err and .command.log in the work directory for the specific tool error.",
        command="""# Find the failed task work directory:
nextflow log last -f workdir,name,status | grep FAILED

# Check error logs:
cat work/xx/yyyyyy/.command.err
cat work/xx/yyyyyy/.command.log""",
        regexes=(
            r"Process.*terminated with.*exit status [^0]",
            r"Command exit status: [^0]",
            r"Error executing process",
            r"Task.*failed",
            r"exit code [^0]",
            r"non-zero exit",
        ),
    ),
    Category(
        id="invalid_parameter",
        label="Invalid Parameter",
        family="general",
        severity="medium",
        icon="⚙️",
        cause="An invalid or unrecognized parameter was passed to the pipeline or a tool.",
        fix="Review your nextflow run command and params file. Run with --help to see available options.",
        command="""# List valid parameters:
nextflow run nf-core/rnaseq --help

# Validate params file:
nextflow run nf-core/rnaseq -params-file params.yaml --validate_params""",
        regexes=(
            r"Unknown.*parameter",
            r"invalid.*option",
            r"unrecognized.*argument",
            r"not a valid",
            r"ERROR.*params",
            r"Schema validation",
        ),
    ),
    Category(
        id="disk_space",
        label="Disk Space",
        family="general",
        severity="critical",
        icon="💾",
        cause="The filesystem ran out of space during execution.",
        fix="Clean up old work directories with nextflow clean. Remove unnecessary intermediate files. Increase disk allocation.",
        command="""# Check disk usage:
df -h .
du -sh work/

# Clean old runs:
nextflow clean -f -before last""",
        regexes=(
            r"No space left on device",
            r"Disk quota exceeded",
            r"ENOSPC",
            r"cannot write",
        ),
    ),
    Category(
        id="starsolo_memory",
        label="STARsolo Memory Exceeded",
        family="single_cell",
        severity="critical",
        icon="🧠",
        cause="STARsolo requires ~32GB RAM to load the human genome index plus barcode whitelist simultaneously. Allocated memory is insufficient.",
        fix="Increase memory to at least 32GB in nextflow.config. For mouse genome minimum 28GB. Enable retry with escalating memory.",
        command="""# In nextflow.config:
process {
  withName: 'STARSOLO' {
    memory = { 32.GB * task.attempt }
    errorStrategy = 'retry'
    maxRetries = 2
  }
}""",
        regexes=(
            r"STARsolo.*exit code.*137",
            r"STAR.*killed.*signal 9",
            r"solo.*out of memory",
            r"genome load.*failed",
            r"STAR.*cannot allocate",
        ),
    ),
    Category(
        id="barcode_whitelist_missing",
        label="Barcode Whitelist Missing",
        family="single_cell",
        severity="critical",
        icon="🔖",
        cause="The 10x Chromium barcode whitelist file is missing or path is incorrect. STARsolo needs this file to identify valid cell barcodes. v2 and v3 chemistry use different whitelists.",
        fix="Download the correct whitelist for your chemistry version. Specify path with --soloCBwhitelist in your params.",
        command="""# Download 10x v3 whitelist:
wget https://raw.githubusercontent.com/10XGenomics/cellranger/master/lib/python/cellranger/barcodes/3M-february-2018.txt.gz
gunzip 3M-february-2018.txt.gz

# In params.yaml:
barcode_whitelist: '/path/to/3M-february-2018.txt'""",
        regexes=(
            r"soloCBwhitelist.*not found",
            r"whitelist.*file.*does not exist",
            r"barcode.*whitelist.*missing",
            r"--soloCBwhitelist.*error",
            r"CB whitelist.*cannot open",
        ),
    ),
    Category(
        id="wrong_chemistry",
        label="Wrong 10x Chemistry Specified",
        family="single_cell",
        severity="high",
        icon="🧪",
        cause="The specified 10x chemistry version does not match the library preparation. Using 10xv2 params on a v3 library (or vice versa) causes near-zero cell detection.",
        fix="Check your library preparation protocol for the chemistry version. Valid options: 10xv2, 10xv3, 10xv3_5prime. Use --chemistry auto if unsure.",
        command="""# In nextflow run command:
nextflow run nf-core/scrnaseq \\
  --chemistry 10xv3 \\
  --input samplesheet.csv

# Valid chemistry options: 10xv2, 10xv3, 10xv3_5prime""",
        regexes=(
            r"chemistry.*not recognized",
            r"invalid.*chemistry",
            r"soloType.*invalid",
            r"unknown chemistry.*10x",
            r"--chemistry.*error",
        ),
    ),
    Category(
        id="empty_cell_output",
        label="Empty Cell Output",
        family="single_cell",
        severity="critical",
        icon="🕳️",
        cause="Pipeline ran successfully but detected zero or near-zero cells. Common causes: wrong chemistry version, incorrect barcode whitelist, or reads in wrong orientation.",
        fix="Check chemistry version matches library prep. Verify barcode whitelist matches chemistry. Check FASTQ orientation (R1 should be barcode+UMI, R2 should be cDNA).",
        command="""# Check your FASTQ orientation:
zcat sample_R1.fastq.gz | head -8
# R1 should be short (28bp for 10xv3: 16bp barcode + 12bp UMI)

# Check cell count in output:
wc -l outs/filtered_feature_bc_matrix/barcodes.tsv.gz""",
        regexes=(
            r"no cells detected",
            r"0 cells? (passed|found|detected)",
            r"empty barcode.*matrix",
            r"cell number.*0",
            r"filtered.*matrix.*empty",
        ),
    ),
    Category(
        id="cellranger_fastq_naming",
        label="Cell Ranger FASTQ Naming Error",
        family="single_cell",
        severity="high",
        icon="📄",
        cause="Cell Ranger requires FASTQ files named exactly as: SampleName_S1_L001_R1_001.fastq.gz. Any deviation from this format causes Cell Ranger to fail silently or not find files.",
        fix="Rename FASTQ files to Cell Ranger format. R1 = barcode+UMI read (28bp), R2 = cDNA read.",
        command="""# Rename FASTQs to Cell Ranger format:
mv sample_1.fastq.gz sample_S1_L001_R1_001.fastq.gz
mv sample_2.fastq.gz sample_S1_L001_R2_001.fastq.gz

# Verify naming:
ls -la *.fastq.gz""",
        regexes=(
            r"cellranger.*invalid.*fastq",
            r"fastq.*naming.*convention",
            r"could not.*detect.*fastq.*cellranger",
            r"no input FASTQs.*cellranger",
            r"_R1_001\.fastq.*not found",
        ),
    ),
    Category(
        id="kallisto_empty_bus",
        label="kallisto-bustools Empty BUS File",
        family="single_cell",
        severity="critical",
        icon="🚌",
        cause="kallisto produced an empty BUS file — zero reads pseudoaligned. Usually caused by wrong genome index (species mismatch), incorrect chemistry flag, or corrupted index.",
        fix="Verify genome index matches your species. Rebuild index if corrupted. Check chemistry flag matches library prep.",
        command="""# Rebuild kallisto index:
kb ref -d human -i index.idx -g t2g.txt

# Check pseudoalignment rate:
cat run_info.json | grep pseudoaligned
# Expect >40% — if <10% the index or chemistry is wrong""",
        regexes=(
            r"bus file.*empty",
            r"kallisto.*0 records",
            r"kb.*run.*failed",
            r"bustools.*empty",
            r"no reads.*pseudoaligned",
        ),
    ),
    Category(
        id="anndata_version_mismatch",
        label="AnnData Version Mismatch",
        family="single_cell",
        severity="high",
        icon="📦",
        cause="The .h5ad file was written by a newer version of AnnData than is installed in the current environment. AnnData format changes between major versions.",
        fix="Update AnnData to latest version, or convert the file using the version that created it.",
        command="""# Update AnnData:
pip install --upgrade anndata

# Check current version:
python -c "import anndata; print(anndata.__version__)"

# Convert h5ad if needed:
python -c "import anndata as ad; adata = ad.read_h5ad('old_file.h5ad'); adata.write_h5ad('new_file.h5ad')\"""",
        regexes=(
            r"anndata.*version.*incompatible",
            r"h5ad.*cannot.*read",
            r"AnnData.*unsupported.*format",
            r"backed.*h5ad.*error",
            r"anndata.*AttributeError",
        ),
    ),
    Category(
        id="scrna_genome_mismatch",
        label="scRNA-seq Genome/GTF Mismatch",
        family="single_cell",
        severity="critical",
        icon="🧬",
        cause="The genome FASTA and GTF annotation file are from different assembly versions (e.g. GRCh38 FASTA with GRCh37 GTF). Chromosome names do not match, causing alignment to fail or produce zero mapped reads.",
        fix="Use matching FASTA and GTF from the same Ensembl release. Download both from the same Ensembl release page.",
        command="""# Download matching genome + GTF (Ensembl release 109):
wget https://ftp.ensembl.org/pub/release-109/fasta/homo_sapiens/dna/Homo_sapiens.GRCh38.dna.primary_assembly.fa.gz
wget https://ftp.ensembl.org/pub/release-109/gtf/homo_sapiens/Homo_sapiens.GRCh38.109.gtf.gz

# Always use the SAME release number for both files""",
        regexes=(
            r"chromosome.*not found.*GTF",
            r"GTF.*chromosome.*mismatch",
            r"contig.*not in.*genome",
            r"seqname.*not found.*fasta",
            r"genome.*annotation.*incompatible",
        ),
    ),
]

# Label of runs without a failure, and the default severities.
CLEAN = "clean"
SEVERITIES = ("critical", "high", "medium")
DEFAULT_SEVERITY = "medium"
DIAGNOSIS_DEFAULT_SEVERITY = "high"
DIAGNOSIS_DEFAULT_ICON = "⚠️"

# Sample-sheet columns, strandedness words, FASTQ suffixes, remote schemes.
REQUIRED_COLUMNS = ("sample", "fastq_1", "fastq_2", "strandedness")
STRANDEDNESS = ("forward", "reverse", "unstranded", "auto")
FASTQ_SUFFIXES = (".fastq.gz", ".fq.gz")
REMOTE_SCHEMES = ("s3://", "gs://", "az://")

# Genome name, STAR GB, BWA GB, HISAT2 GB, genome size GB.
# The first name contained in a configured genome wins.
GENOMES: list[tuple[str, float, float, float, float]] = [
    ("GRCh38", 32, 8, 8, 3.1),
    ("GRCh37", 32, 8, 8, 3.0),
    ("hg38", 32, 8, 8, 3.1),
    ("hg19", 32, 8, 8, 3.0),
    ("GRCm39", 32, 6, 6, 2.7),
    ("GRCm38", 32, 6, 6, 2.7),
    ("mm10", 32, 6, 6, 2.7),
    ("mm39", 32, 6, 6, 2.7),
    ("T2T", 36, 10, 10, 3.1),
    ("TAIR10", 4, 1, 1, 0.12),
    ("WBcel235", 4, 1, 1, 0.1),
    ("R64-1-1", 4, 1, 1, 0.012),
    ("dm6", 8, 2, 2, 0.14),
    ("danRer11", 16, 4, 4, 1.4),
]
DEFAULT_GENOME_SIZE_GB = 3.0
DISK_PER_SAMPLE_GB = 5

# Container and environment engines in order of precedence.
ENGINES = ("docker", "singularity", "podman", "conda", "mamba")

# The 26 base feature names, followed by regex_<category id>.
BASE_FEATURES = (
    "exit_code", "memory_requested_gb", "memory_available_gb", "memory_ratio",
    "n_processes", "n_completed", "n_failed", "completion_ratio",
    "n_lines", "n_error_lines", "n_warning_lines", "error_density",
    "has_stack_trace", "has_oom", "has_permission", "has_disk",
    "has_container", "has_index", "has_schema_error",
    "has_pipeline_failed", "has_conda_error",
    "exit_is_137", "exit_is_1", "exit_is_127", "exit_is_126", "exit_is_139",
)
EXIT_ONE_HOT = (137, 1, 127, 126, 139)

# Regexes behind the nine 0/1 markers (has_stack_trace is
# case-sensitive and multi-line, the others ignore case).
MARKER_REGEXES = {
    "has_stack_trace": r"^\s+at\s+",
    "has_oom": r"OutOfMemoryError|oom-kill|SIGKILL",
    "has_permission": r"Permission denied|EACCES",
    "has_disk": r"No space left|ENOSPC|Disk quota",
    "has_container": r"docker|singularity|container|OCI|conda|mamba|Failed to create.*environment",
    "has_index": r"genome index|genomeGenerate|faidx|\.fai",
    "has_schema_error": r"Schema validation|Unknown.*parameter",
    "has_pipeline_failed": r"Pipeline completed with errors|Pipeline failed|Session aborted",
    "has_conda_error": r"Failed to create Conda environment|conda.*error|CondaError|mamba.*error",
}

# Regexes for process lines, run metadata, exit codes and memory.
PROCESS_REGEX = (
    r"\[([a-f0-9]{2}/[a-f0-9]{6})\]\s+process\s*>\s*(.+?)\s+\[(\s*\d+%)\]\s*(\d+)\s+of\s+(\d+)"
)
PROCESS_FEATURE_REGEX = (
    r"\[([a-f0-9]{2}/[a-f0-9]{6})\]\s+process\s*>.*\[(\s*\d+%)\]\s*(\d+)\s+of\s+(\d+)"
)
METADATA_REGEXES = {  # column: (regex, ignore case)
    "nf_version": (r"N E X T F L O W\s+~\s+version\s+([\d.]+)", False),
    "pipeline": (r"Launching\s+`([^`]+)`", False),
    "revision": (r"revision:\s*(\S+)", False),
    "failed_process": (r"Error executing process\s*>\s*'([^']+)'", True),
    "work_dir": (r"Work dir:\s*(\S+)", True),
    "command": (r"Command executed:\s*\n\s*(.+)", True),
    "exit_status": (r"Command exit status:\s*(.+)", True),
}
EXIT_CODE_REGEX = r"Command exit status:\s*(\S+)"
MEMORY_REQUESTED_REGEX = r"req:\s*([\d.]+)\s*GB"
MEMORY_AVAILABLE_REGEX = r"avail:\s*([\d.]+)\s*GB"
ERROR_LINE_REGEX = r"error|fatal|exception"
WARNING_LINE_REGEX = r"warn"

# Regexes reading a workflow configuration.
MAX_MEMORY_REGEX = r"""max_memory\s*=\s*['"]?([\d.]+)\s*\.?\s*GB['"]?"""
MAX_CPUS_REGEX = r"""max_cpus\s*=\s*['"]?(\d+)['"]?"""
MAX_TIME_REGEX = r"""max_time\s*=\s*['"]?([\d.]+)\s*\.?\s*h['"]?"""
GENOME_REGEX = r"""genome\s*=\s*['"]?([A-Za-z0-9_.\-]+)['"]?"""
PATH_SETTINGS = ("fasta", "gtf", "star_index", "bwa_index", "hisat2_index", "outdir")
PATH_SETTING_REGEX = r"""{key}\s*=\s*['"]?([^\s'"]+)['"]?"""
EXECUTOR_REGEX = r"""executor\s*=\s*['"]?(\w+)['"]?"""
ENGINE_ENABLED_REGEX = r"{engine}\s*\{{\s*enabled\s*=\s*true"
ENGINE_PROFILE_REGEX = r"profile.*{engine}"

# Fixed value: token shape of the text features (2+ characters; paths and versions stay whole).
TOKEN_REGEX = r"[\p{L}\p{N}_][\p{L}\p{N}_./:-]*[\p{L}\p{N}_]"


def feature_names(categories: list[Category] = CATEGORIES) -> list[str]:
    """Ordered structured feature names for a catalogue."""
    return [*BASE_FEATURES, *(f"regex_{c.id}" for c in categories)]
