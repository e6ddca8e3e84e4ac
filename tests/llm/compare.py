"""Compare the corpus queries with DuckDB: python -m tests.llm.compare FOLDER [prefix ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

from cutloom.llm.queries import ORACLES, QUERIES
from tests.harness import canon, session

TABLES = ("documents", "pages", "benchmark", "labels")


def compare(spark, name, folder):
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if ORACLES.get(name) is None:
        return f"rows     {name} {len(got)} {took:.1f}s {df.columns}"
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(ORACLES[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns  {name} {df.columns} {names}"
    a, b = canon(got, df.columns), canon(want, names)
    if a != b:
        sa, sb = set(a), set(b)
        return f"values   {name} {len(a)} {len(b)} spark-only {sorted(sa - sb)[:3]} duck-only {sorted(sb - sa)[:3]}"
    return f"ok       {name} {len(got)} {took:.1f}s"


if __name__ == "__main__":
    s = session()
    for q in QUERIES:
        if len(sys.argv) < 3 or any(q.startswith(p) for p in sys.argv[2:]):
            print(compare(s, q, sys.argv[1]), flush=True)
