"""Compare registered queries with their SQL on DuckDB.

``python tests/oracle_check.py [folder] [name ...]`` prints one line per query. With ``HOT_ROWS=n`` in the
environment every group of more than ``n`` rows is split, as large groups are on a cluster.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in at) for r in rows]
    return [cols[i] for i in at], sorted(out, key=repr)


SPARK_KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(spark, con, folder, name, fn, sql) -> str:
    """Empty if rows, names and types agree, else what differs."""
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    rel = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    odd = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema
           if SPARK_KIND.get(f.dataType.simpleString()) != kinds[f.name]}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not want:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]} (columns {got_cols})" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    from cohortloom.session import get_session

    args = sys.argv[1:]
    hot = {"spark.cohortloom.rangeRows": os.environ["HOT_ROWS"]} if "HOT_ROWS" in os.environ else {}
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}, **hot)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, fn, oracle.get(name))
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print("failed", failed)
