"""Streams over many files, in several micro-batches, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from cutloom.operators import matching as M, oplog as O
from cutloom.operators.scan import span_of
from cutloom.streaming import processors as P, stateful as S, stores as K
from cutloom.streaming.sources import events_stream

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events cut by time into files that arrive one after the other."""
    out = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    for i in range(4):
        e.where(f"event_id % 1000 >= {i * 250} and event_id % 1000 < {(i + 1) * 250}").coalesce(1).write.mode("append").parquet(out)
    return out


def test_quarantine_equals_batch(spark, files):
    make = lambda df, at: df.selectExpr("user_id as backend_id", "event_id", "event_id as at_no", f"{at} as at",
                                        "case when event_id%7<4 then 'failure' when event_type='view' then 'success' else 'unsupported' end as result")
    stream = make(events_stream(spark, files, 1), "event_id * 1000")
    got = K.run_to_table(S.quarantine(stream, ["at_no"], ["event_id"], 3, 40_000), "q")
    assert got.where("late").count() == 0
    batch = make(spark.read.parquet(f"{FOLDER}/events.parquet"), "event_id * 1000").withColumn("duration_ms", F.lit(0.0))
    want = M.quarantine(batch, ["at_no"], span_of("at_no", 100), 3, 40_000)
    cols = ["event_id", "consecutive", "until", "allowed"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_change_log_store_equals_replay(spark, files, tmp_path):
    make = lambda df: df.selectExpr("user_id as project_id", "event_id%20 as entity_id", "event_id as seq",
                                    "case event_type when 'signup' then 'node.add' when 'error' then 'node.remove' else 'node.update' end as op_type",
                                    "concat('p', event_id%4) as prop", "value")
    K.materialise_changes(make(events_stream(spark, files, 1)), str(tmp_path / "store"), str(tmp_path / "ckpt"), 4).awaitTermination()
    got = O.replay_nodes(K.read_store(spark, str(tmp_path / "store"), K.OPS_SCHEMA))
    want = O.replay_nodes(make(spark.read.parquet(f"{FOLDER}/events.parquet")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_store_batches_can_repeat_and_empty_a_bucket(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "k bigint, v double"
    put = lambda rows, n, merge: K.upsert_batch(spark.createDataFrame(rows, schema), n, path, schema, ["k"], 2, merge)
    last = lambda old, new: old.join(new.select("k"), "k", "left_anti").select("k", "v").unionByName(new)
    put([(1, 1.0), (2, 2.0)], 0, last)
    put([(1, 5.0)], 1, last)
    put([(1, 5.0)], 1, last)
    read = lambda: sorted(map(tuple, K.read_store(spark, path, schema).select("k", "v").collect()))
    assert read() == [(1, 5.0), (2, 2.0)]
    put([(1, 0.0), (2, 0.0)], 2, lambda old, new: new.where("false"))
    assert read() == []


def test_rows_behind_the_state_are_late(spark, tmp_path):
    out = str(tmp_path / "in")
    schema = "k bigint, n bigint, bytes double, seconds double"
    spark.createDataFrame([(1, 5, 1e6, 1.0)], schema).coalesce(1).write.parquet(out)
    make = lambda: S.throughput(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(out), "k", ["n"], ["n"])
    K.append_rows(make(), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(1, 4, 1e6, 1.0), (1, 6, 1e6, 1.0)], schema).coalesce(1).write.mode("append").parquet(out)
    K.append_rows(make(), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert {(r["n"], r["late"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {(5, False), (4, True), (6, False)}


def test_duplicates_across_batches(spark, files):
    e = events_stream(spark, files, 1).select("user_id", (F.col("event_id") % 3).alias("nonce"), "at")
    got = K.run_to_table(S.suppress_duplicates(e, ["user_id", "nonce"], "at", "60 days"), "d")
    assert got.count() == got.select("user_id", "nonce").distinct().count()


def test_open_records_are_evicted(spark, tmp_path):
    out, schema = str(tmp_path / "in"), "k bigint, stage string, at_ms double, n bigint, at timestamp"
    row = lambda k, stage, sec, n: (k, stage, sec * 1000.0, n, sec)
    put = lambda rows: spark.createDataFrame([(k, s, a, n, sec) for k, s, a, n, sec in rows], "k bigint, stage string, at_ms double, n bigint, sec bigint").withColumn(
        "at", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.mode("append").parquet(out)
    put([row(1, "source", 10, 1), row(2, "source", 11, 2), row(2, "output", 12, 3)])
    run = lambda: K.append_rows(S.correlate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(out), ["k"], "at_ms", "n", "at", "1 seconds", 5_000),
                                str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    run()
    put([row(3, "source", 100, 4)])
    run()
    put([row(3, "output", 101, 5)])
    run()
    got = {(r["k"], r["evicted"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert (2, False) in got and (1, True) in got


def put(spark, rows, schema, path):
    """One file; the last column is seconds and becomes the event time ``at``."""
    spark.createDataFrame(rows, schema + ", sec bigint").withColumn("at", F.timestamp_seconds(F.col("sec") + 10 ** 9)).drop("sec").coalesce(1).write.mode("append").parquet(path)


def follow(spark, make, schema, tmp_path):
    """Runs ``make(stream)`` over the files of tmp_path/in one by one; (rows, state rows after each batch)."""
    stream = spark.readStream.schema(schema + ", at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # few keys, many batches
    try:
        q = K.append_rows(make(stream), str(tmp_path / "o"), str(tmp_path / "c"))
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return [r.asDict() for r in spark.read.parquet(str(tmp_path / "o")).collect()], sizes


def live_model(events, range_bytes=None):
    """Plain version of the live index for one track: rows (n, kind, offset, size) in order."""
    held, total, acked_total, cursor, safe, out = set(), 0, 0, 0, 0, {}
    for n, kind, offset, size in events:
        new, gone = False, set()
        if kind == "chunk":
            new = offset + size > safe and (offset, size) not in held
            if new:
                held.add((offset, size))
                cursor = max(cursor, offset + size)
        elif kind in ("one", "through"):
            gone = held & {(offset, size)} if kind == "one" else {c for c in held if sum(c) <= offset}
            held -= gone
            safe = max(safe, min(min(held)[0] if held else cursor, cursor))
        total, acked_total = total + new, acked_total + len(gone)
        out[n] = (new, len(gone), len(held), total, acked_total, safe)
    return out


def test_live_index_over_many_batches(spark, tmp_path):
    schema, r, every = "track string, n bigint, kind string, offset bigint, size bigint", random.Random(1), {}
    for batch in range(20):
        rows = []
        for track in ("a", "b"):
            log = every.setdefault(track, [])
            for _ in range(12):
                kind = r.choice(["chunk"] * 6 + ["one", "through", "other"])
                log.append((len(log), kind, batch * 100 + r.randrange(12) * 10, r.choice([10, 20])))
                rows.append((track, *log[-1], 60 * batch))
            log.append((len(log), "through", batch * 100, 0))  # consumers keep up
            rows.append((track, *log[-1], 60 * batch))
        put(spark, r.sample(rows, len(rows)), schema, str(tmp_path / "in"))
    make = lambda s: P.live_index(s, ["track"], ["n"], ["n"], time="at", idle="1 days", range_bytes=64)
    got, sizes = follow(spark, make, schema, tmp_path)
    for track, log in every.items():
        want = live_model(log)
        have = {x["n"]: tuple(x[c] for c in ("is_new", "acked", "pending", "total", "acked_total", "safe")) for x in got if x["track"] == track}
        assert have == want
    assert not any(x["late"] for x in got) and any(x["acked"] for x in got)
    assert len(sizes) >= 20 and max(sizes[10:]) <= max(sizes[:10]) + 4


def test_idle_tracks_vanish(spark, tmp_path):
    schema = "track string, n bigint, kind string, offset bigint, size bigint"
    for k in range(6):  # each track is heard of once; the first comes back when it has long been forgotten
        put(spark, [(f"t{k % 5}", k, "chunk", 100, 10, 3600 * k), (f"t{k % 5}", k + 100, "chunk", 100, 10, 3600 * k)], schema, str(tmp_path / "in"))
    make = lambda s: P.live_index(s, ["track"], ["n"], ["n"], time="at", idle="1 hours")
    got, sizes = follow(spark, make, schema, tmp_path)
    assert {(x["track"], x["n"], x["is_new"], x["late"]) for x in got} == {(f"t{k % 5}", k + d, d == 0, False) for k in range(6) for d in (0, 100)}
    assert sizes[-1] <= 2 * sizes[0] and max(sizes) <= 3 * sizes[0]


def test_states_of_idle_keys_vanish(spark, tmp_path):
    schema = "k string, n bigint, bytes double, seconds double"
    for k in range(8):
        put(spark, [(f"k{k}", k, 1e6, 1.0, 3600 * k)], schema, str(tmp_path / "in"))
    got, sizes = follow(spark, lambda s: S.throughput(s, "k", ["n"], ["n"], time="at", idle="1 hours"), schema, tmp_path)
    assert len(got) == 8 and not any(x["late"] for x in got) and max(sizes) <= 3 * sizes[0]


def tracker_model(events, cap, keep):
    """Plain version of the tracker for one session; events (n, key, stage, at) all seen before any age counts."""
    held, records, evicted, out = {}, 0, 0, []
    for _, key, stage, at in events:
        if stage not in ("source", "submitted", "decoded", "output"):
            continue
        r = held.get(key)
        if r is None:
            r, records = [records, None, None, None], records + 1
        if stage == "output":
            held.pop(key, None)
            out.append((key, r[0], "output", r[1], r[2], r[3], at, evicted, len(held)))
            continue
        k = 1 + ("source", "submitted", "decoded").index(stage)
        r[k] = at if k > 1 or r[1] is None else r[1]
        held[key] = r
        if len(held) > cap:
            key = next(iter(held))
            r = held.pop(key)
            evicted += 1
            out.append((key, r[0], "cap", r[1], r[2], r[3], None, evicted, len(held)))
    return out, records


def test_stage_tracker_over_many_batches(spark, tmp_path):
    schema, r, every, n = "session string, n bigint, key string, stage string, at_ms double", random.Random(2), {}, 0
    for batch in range(20):
        rows = []
        for session in ("a", "b"):
            for _ in range(15):
                n += 1
                e = (n, f"m{r.randrange(9)}", r.choice(["source", "submitted", "decoded", "output", "other"]), float(n))
                every.setdefault(session, []).append(e)
                rows.append((session, *e, batch))
        put(spark, r.sample(rows, len(rows)), schema, str(tmp_path / "in"))
    make = lambda s: P.track_stages(s, ["session"], ["n"], time="at", cap=4, keep="10 minutes", idle="20 minutes")
    got, sizes = follow(spark, make, schema, tmp_path)
    names = ("key", "record", "reason", "source_at", "submitted_at", "decoded_at", "output_at", "evicted", "open")
    for session, log in every.items():
        want, _ = tracker_model(log, 4, 600)
        have = [tuple(x[c] for c in names) for x in got if x["session"] == session and x["reason"] != "age"]
        assert sorted(have, key=repr) == sorted(want, key=repr) and any(x[2] == "cap" for x in want)
    assert max(sizes) <= 2 * (4 + 2 + 3)  # open records, counters, place and timers of two sessions


def test_records_of_the_tracker_age(spark, tmp_path):
    schema = "session string, n bigint, key string, stage string, at_ms double"
    put(spark, [("a", 1, "x", "source", 1.0, 0), ("a", 2, "y", "source", 2.0, 400), ("b", 3, "z", "source", 3.0, 0)], schema, str(tmp_path / "in"))
    put(spark, [("a", 4, "w", "source", 4.0, 1300)], schema, str(tmp_path / "in"))
    put(spark, [("c", 6, "q", "source", 6.0, 1350)], schema, str(tmp_path / "in"))  # rows of a batch come before the ages of that batch
    put(spark, [("a", 5, "x", "output", 5.0, 1400)], schema, str(tmp_path / "in"))
    make = lambda s: P.track_stages(s, ["session"], ["n"], time="at", watermark="1 seconds", keep="10 minutes", idle="1 hours")
    got, _ = follow(spark, make, schema, tmp_path)
    assert {(x["session"], x["key"], x["record"], x["reason"]) for x in got} == {
        ("a", "x", 0, "age"), ("a", "y", 1, "age"), ("b", "z", 0, "age"), ("a", "x", 3, "output")}
    assert {x["evicted"] for x in got if x["session"] == "a" and x["reason"] == "output"} == {2}


def test_a_record_number_outlives_an_eviction(spark, tmp_path):
    schema = "k bigint, stage string, at_ms double, n bigint"
    for n, (sec, stage) in enumerate([(0, "source"), (1, "source"), (2, "decoded")]):
        put(spark, [(1, stage, (10 ** 9 + sec) * 1000.0, n, sec), (2, "other", 1e12, n, sec + 30)], schema, str(tmp_path / "in"))
    make = lambda s: S.correlate(s, ["k"], "at_ms", "n", "at", "1 seconds", 100_000)
    for n, sec in ((7, 150), (8, 155)):  # the first record is too old now
        put(spark, [(2, "other", 1e12, n, sec)], schema, str(tmp_path / "in"))
    put(spark, [(1, "source", (10 ** 9 + 200) * 1e3, 9, 200), (2, "other", 1e12, 9, 200)], schema, str(tmp_path / "in"))
    put(spark, [(1, "output", (10 ** 9 + 201) * 1e3, 10, 201), (2, "other", 1e12, 10, 201)], schema, str(tmp_path / "in"))
    got, _ = follow(spark, make, schema, tmp_path)
    assert sorted((x["record"], x["evicted"]) for x in got if x["k"] == 1) == [(0, True), (1, False)]


def test_edges_of_the_change_log_store(spark, tmp_path):
    """Edges die with their ends though the ends come back; over 20 batches the store holds two versions of a bucket at most."""
    r, schema, every = random.Random(5), "project_id bigint, entity_id bigint, other_id bigint, edge_id bigint, seq bigint, op_type string, prop string, value double", []
    for batch in range(20):
        rows = []
        for _ in range(15):
            kind = r.choice(["node.add", "node.remove", "node.update", "edge.add", "edge.add", "edge.remove"])
            rows.append((r.randrange(2), r.randrange(6), r.randrange(6), r.randrange(8), len(every) + len(rows), kind, r.choice("xy"), r.random()))
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    K.materialise_changes(stream, str(tmp_path / "store"), str(tmp_path / "c"), 3).awaitTermination()
    state, whole = K.read_store(spark, str(tmp_path / "store"), K.OPS_SCHEMA), spark.createDataFrame(every, schema)
    for replay in (O.replay_edges, O.replay_nodes):
        assert sorted(map(tuple, replay(state).collect())) == sorted(map(tuple, replay(whole).collect()))
    assert replay(whole).count() and O.replay_edges(whole).count()
    for bucket in (tmp_path / "store").glob("bucket=*"):
        assert 1 <= len(list(bucket.glob("batch=*"))) <= 2
