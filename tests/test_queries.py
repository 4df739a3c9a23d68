"""A cross-section of the registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from flowtriage.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "labelled_scan", "log_ingest", "corpus_index", "matched_lines", "classify_runs", "process_rows", "run_metadata",
    "feature_table", "vocabulary", "cv_folds", "classification_report", "top_features", "sheet_issues", "sheet_summary",
    "pf_config_settings", "pf_all_checks",
)
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok") and " 0 rows" not in result and "TYPES" not in result, result


def test_every_category_occurs(spark):
    rows = entry.queries()["detect_counts"](spark, SF).groupBy("id").count().collect()
    assert len(rows) == 16 and all(r["count"] > 0 for r in rows)


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) == 85 and set(QUERIES) <= set(entry.oracle_sql())
