"""Run a registered query in Spark and its oracle in DuckDB and compare them as multisets."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from cutloom import plans
from cutloom.session import build_session
from cutloom.sources.tables import TABLES

_SPARK = {"bigint": "int64", "int": "int32", "double": "float64", "string": "str", "boolean": "bool", "float": "float32"}
_DUCK = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "VARCHAR": "str", "BOOLEAN": "bool",
         "FLOAT": "float32"}


def session():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def compare(spark, con, name, folder):
    df = plans.all_queries()[name](spark, folder)
    t0 = time.time()
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    sql = plans.all_oracles().get(name)
    if sql is None:
        return "rows", len(got), took, ""
    cur = con.execute(sql)
    dn = [d[0] for d in cur.description]
    dt = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    want = con.execute(sql).fetchall()
    sn = df.columns
    if sorted(sn) != sorted(dn):
        return "columns", len(got), took, f"{sorted(sn)} vs {sorted(dn)}"
    st = dict(df.dtypes)
    bad = [(c, st[c], dt[c]) for c in sn if _SPARK.get(st[c], st[c]) != _DUCK.get(dt[c], dt[c])]
    a, b = canon(got, sn), canon(want, dn)
    if a != b:
        sa, sb = set(a), set(b)
        return "values", len(got), took, f"{len(a)} vs {len(b)}; spark-only {sorted(sa - sb)[:3]} duck-only {sorted(sb - sa)[:3]}"
    if bad:
        return "types", len(got), took, str(bad)
    return "ok", len(got), took, ""


def main(folder, patterns):
    spark, con = session(), duck(folder)
    bad = 0
    for name in plans.all_queries():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        try:
            status, n, took, note = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            status, n, took, note = "error", -1, 0, f"{type(e).__name__}: {str(e)[:1200]}"
        if status not in ("ok", "rows"):
            bad += 1
        print(f"{status:8s} {name:34s} rows={n:<7d} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
