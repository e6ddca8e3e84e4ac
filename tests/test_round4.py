"""Queries on hand-made tables where they once differed from their SQL when tables were large, and steps that once took too much disk."""

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cutloom import plans
from cutloom.operators import vectors as V
from cutloom.operators.fold import machine_scan
from cutloom.operators.lexindex import graph_postings
from cutloom.operators.scan import span_of
from tests.harness import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def equal(spark, tmp_path):
    """A check that a query equals its SQL on the smallest tables with some of them replaced by a SELECT over them."""

    def check(name, **tables):
        folder = str(tmp_path)
        for file in os.listdir(SMALL):
            table = file.removesuffix(".parquet")
            if table in tables:
                duckdb.sql(tables[table].format(old=f"'{SMALL}/{file}'")).write_parquet(f"{folder}/{file}")
            else:
                os.symlink(f"{SMALL}/{file}", f"{folder}/{file}")
        status, _, _, note = compare(spark, duck(folder), name, folder)
        assert status == "ok", note

    return check


@pytest.fixture
def scattered(spark):
    """As with large tables, shuffles keep all their partitions, and small sides of joins are found out at run time."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "32k"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def test_groups_cross_spans(equal, scattered):
    equal("ch05_groups", lineitem="select * replace (l_orderkey + 1048576 - 750 as l_orderkey) from {old}")


def test_machine_keeps_spans_whole(spark, scattered):
    rows = spark.range(4000).select((F.col("id") % 7).alias("k"), "id").repartition(6)
    step = lambda state, values: ((state + int(values[0])) % 3, ((state + int(values[0])) % 3,))
    got = machine_scan(rows, ["k"], ["id"], span_of("id", 500), [0, 1, 2], step, ["id"], "s bigint").collect()
    state: dict = {}
    for r in sorted(got, key=lambda r: r["id"]):
        state[r["k"]] = (state.get(r["k"], 0) + r["id"]) % 3
        assert r["s"] == state[r["k"]], r


def test_scores_that_round_to_one_are_ordered_by_name(spark, monkeypatch):
    monkeypatch.setattr(V, "hash_model", lambda n: lambda texts: [[1.0, 1e-5 * (zlib.crc32(t.encode()) % 7)] for t in texts])
    got = plans.all_queries()["vec06_query_embedding"](spark, SMALL).collect()
    first = [r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("source", "doc_id").limit(10).collect()]
    assert {r["score"] for r in got} == {1.0}
    for query in {r["query"] for r in got}:
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == query] == first


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("a", "clip", "Red Fox"), ("b", "asset", None), ("c", "clip", "red")], "id string, kind string, name string")
    edges = spark.createDataFrame([("a", "b", "shown in", "Fox"), ("a", "gone", "contains", None), ("c", "c", "red", "")],
                                  "src string, dst string, type string, role string")
    return nodes, edges


ROWS = {("a", "red", 10, "name"), ("a", "fox", 10, "name,relationships"), ("a", "clip", 4, "kind"), ("a", "shown", 3, "relationships"), ("a", "in", 3, "relationships"),
        ("a", "asset", 3, "relationships"), ("a", "contains", 3, "relationships"), ("b", "asset", 4, "kind"), ("b", "shown", 3, "relationships"),
        ("b", "in", 3, "relationships"), ("b", "fox", 3, "relationships"), ("b", "red", 3, "relationships"), ("b", "clip", 3, "relationships"),
        ("c", "red", 10, "name,relationships"), ("c", "clip", 4, "kind,relationships")}


def test_index_rows_are_moved_by_node_only(spark, graph, scattered):
    """Rows of the index, one for each node and term, were shuffled by term, by node and by bucket; short texts are, once."""
    found = graph_postings(*graph)
    assert {(r.id, r.term, r.weight, ",".join(r.sources)) for r in found.collect()} == ROWS
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not any("term#" in line for line in moved), plan


@pytest.mark.parametrize("ids", ["a", "bc", "x"])
def test_index_rows_of_some_nodes(spark, graph, ids):
    found = graph_postings(*graph, of=spark.createDataFrame([(i,) for i in ids], "id string"))
    assert {(r.id, r.term, r.weight, ",".join(r.sources)) for r in found.collect()} == {r for r in ROWS if r[0] in ids}
