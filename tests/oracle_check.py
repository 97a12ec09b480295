"""Run every query beside its SQL and compare columns, rows and values.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"set temp_directory = '{tempfile.mkdtemp(prefix='run-')}'")
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        if os.path.exists(path):
            con.sql(f"create view {table} as select * from '{path}'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float) and math.isnan(value):
        return (1, "nan")
    return (2, value) if isinstance(value, (int, float)) else (3, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_key(r[i]) for i in order) for r in rows))


def compare(df, con, sql) -> str:
    """Empty when both sides agree, else what differs."""
    theirs = con.sql(sql)
    want_columns = theirs.columns
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(want_columns, theirs.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {str(bad[0])[:600]}" if bad else ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from contextmill.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, function in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            if name in sql:
                problem = compare(df, con, sql[name])
                if not problem and not df.count():
                    problem = "no rows"
            else:
                problem = "" if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {name} {'' if name in sql else '(no SQL) '}{time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))
