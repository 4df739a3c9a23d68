"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from flowtriage.plans.registry import QUERIES
from flowtriage.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "classify_runs", "detect_counts", "matched_lines", "pattern_reference", "process_rows", "process_rollup",
    "run_metadata", "feature_table", "log_lines", "category_lines",
    "tokens", "vocabulary", "tfidf", "classification_report", "cv_folds", "top_features", "balanced_sample", "corpus_index",
    "labelled_scan", "sheet_issues", "sheet_summary", "pf_fastq_exists", "pf_config_settings", "pf_references", "pf_verdict",
    "pf_all_checks", "hybrid_features", "train_model", "predict_batch", "explain", "cv_score",
)


def main() -> None:
    spark = local_session(CPUS, app="bench")
    spark.range(1).write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    seconds = {}
    QUERIES["classify_runs"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
