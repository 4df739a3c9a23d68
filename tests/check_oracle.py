"""Run every query beside its SQL and compare the rows.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from flowtriage.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def compare(spark, con, sf, name, query, sql) -> str:
    start = time.time()
    df = query(spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    spent = time.time() - start
    if sql is None:
        return f"rows-only {len(rows)} rows {spent:.1f}s"
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != columns:
        return f"MISMATCH columns spark={columns} sql={sorted(names)}"
    order = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    sql_spent = time.time() - start
    left, right = Counter(rows), Counter(expected)
    if left == right:
        odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if not same_type(t, types[c])]
        return f"ok {len(rows)} rows {spent:.1f}s sql {sql_spent:.1f}s {' TYPES ' + str(odd) if odd else ''}"
    extra, lacking = list((left - right))[:2], list((right - left))[:2]
    return f"MISMATCH {len(rows)} vs {len(expected)} columns {columns}\n  spark {extra}\n  sql   {lacking}"


def same_type(spark_type: str, sql_type: str) -> bool:
    known = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    return known.get(spark_type) == sql_type


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            print(name, compare(spark, con, sf, name, query, sqls.get(name)), flush=True)
        except Exception as e:  # report and go on with the next query
            print(name, "ERROR", type(e).__name__, str(e)[:600], flush=True)


if __name__ == "__main__":
    main()
