"""Small hand-made fixtures with known results."""

import json

import pytest
from pyspark.sql import functions as F

from cutloom.functions import hashing as H
from cutloom.functions.text import tokens
from cutloom.operators import (chunks as C, conflicts as CF, curves as K, evaluation as E, graph as G, latency as L, ledger as J, matching as M, oplog as O,
                               privacy as P, quality as Q, ranges as RG, reports as R, retention as RT, search as S, segments as SG, signal as A,
                               timeline as T, trust as TR, vectors as V)
from cutloom.operators.intervals import point_join
from cutloom.operators.scan import asof, span_of
from cutloom.sources import graph_files as GF


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_percentile_rules(spark):
    df = spark.createDataFrame([("camera", 10.0), ("camera", 20.0)], "kind string, value double")
    s = R.summarize(df, ["kind"]).first()
    assert (s["p50"], s["p95"], s["count"]) == (15.0, 19.5, 2)
    d = L.distribution(spark.createDataFrame([("a", 20.0), ("a", 40.0), ("a", 80.0)], "g string, v double"), ["g"], "v").first()
    assert (d["p50"], d["p95"]) == (40.0, 80.0)


def test_report_comparison(spark):
    cur = spark.createDataFrame([("indexMs", 13.0, 13.0), ("hit", .7, .7)], "metric string, p50 double, p95 double")
    base = spark.createDataFrame([("indexMs", 10.0, 10.0), ("hit", .8, .8)], "metric string, p50 double, p95 double")
    assert rows(R.compare_reports(cur, base, ["indexMs"], ["hit"], .2), "metric", "pass") == [("hit", True), ("indexMs", False)]


def test_history_trend(spark):
    h = spark.createDataFrame([("e", i, 10.0 + i) for i in range(6)], "env string, day int, value double")
    kept = R.retain_history(h, "env", ["day"], 4)
    t = R.metric_trend(kept, ["env"], ["day"], window=3).first()
    assert kept.count() == 4 and t["current"] == 15.0 and t["change"] > 0
    flat = spark.createDataFrame([("e", i, v) for i, v in enumerate([10.0, 10.0, 10.0, 15.0])], "env string, day int, value double").withColumn("metric", F.lit("d"))
    budgets = spark.createDataFrame([("d", None, None, .2)], "metric string, max double, min double, max_regression double")
    assert rows(R.budget_violations(R.metric_trend(flat, ["env", "metric"], ["day"], window=3), budgets), "type") == [("regression",)]


def test_counters(spark):
    c = spark.createDataFrame([("s", 150, 100, 10, 5, 1, 9, 0, 0.0, 0.0)], "k string, source_bytes_read int, encoded_bytes_consumed int, frame_requests int, frame_cache_hits int, "
                              "stale_frames int, presented_frames int, dropped_frames int, decode_ms double, decoded_seconds double")
    s = R.counter_snapshot(c, ["k"]).first()
    assert (s["read_amplification"], s["frame_cache_hit_ratio"], s["stale_frame_ratio"]) == (1.5, .5, .1)


CHUNK = "track_id int, sequence int, timestamp_us bigint, duration_us bigint, is_key boolean"


def seconds(spark, keys, n=6):
    return spark.createDataFrame([(1, i, i * 10**6, 10**6, i in keys) for i in range(n)], CHUNK)


def test_seek(spark):
    idx = C.seek_index(seconds(spark, {0, 3}))
    p = spark.createDataFrame([(1, 4.0), (1, 1.0), (1, 2.2)], "track_id int, probe double")
    got = {r["probe"]: r for r in C.nearest_keyframe(idx, p).collect()}
    assert got[4.0]["backward"] == 3 and got[1.0]["forward"] == 3 and got[2.2]["nearest"] == 3


def test_window_bounds_differ(spark):
    idx = C.seek_index(seconds(spark, {0, 2}, 4))
    w = C.decode_windows(idx, spark.createDataFrame([(1, 3.0)], "track_id int, probe double"), 1.0, .25)
    assert w.agg(F.min("sequence"), F.min("window_start")).first() == (2, 2.0)  # strict: the chunk ending at 2 s is out
    req = lambda a, b: spark.createDataFrame([(1, 1, a, b, 0, 0)], "track_id int, request int, start_us bigint, end_us bigint, preroll_us bigint, postroll_us bigint")
    assert C.extended_windows(seconds(spark, {0, 3}), req(3_500_000, 4_500_000)).agg(F.min("sequence")).first()[0] == 3
    assert rows(C.chunks_in_range(seconds(spark, set(), 4), req(1_200_000, 2_100_000)), "sequence") == [(1,), (2,)]
    assert rows(C.chunk_windows(seconds(spark, set(), 4), req(2_000_000, 2_100_000)), "sequence") == [(1,), (2,)]  # inclusive left bound


def test_ranges(spark):
    r = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 6, 2), (1, 2, 20, 5)], "source_id int, idx int, off int, len int")
    assert rows(RG.merge_ranges_bounded(r, 2, 10), "m_off", "m_len") == [(0, 8), (20, 5)]
    r = spark.createDataFrame([(1, 0, 10, 3), (1, 1, 0, 4), (1, 2, 4, 2)], "source_id int, idx int, off int, len int")
    assert RG.merge_ranges(r).count() == 2
    assert rows(RG.assign_holders(r), "idx", "m_off", "local_offset") == [(0, 10, 0), (1, 0, 0), (2, 0, 4)]


def test_interleave_groups(spark):
    s = spark.createDataFrame([(t, 2 * i + k, i * 10_000, 10_000, 1) for i in range(6) for k, t in enumerate("va")], "track string, n int, dts bigint, dur bigint, bytes int")
    g = C.plan_groups(s, "track", ["dts", "n"], "bytes", "dts", "dur", span_of("dts", 1e9), max_duration=30_000)
    assert rows(g, "track", "samples", "dts") == [("a", 3, 0), ("a", 3, 30000), ("v", 3, 0), ("v", 3, 30000)]
    s = spark.createDataFrame([("v", i, i, 1, 100) for i in range(8)], "track string, n int, dts bigint, dur bigint, bytes int")
    g = C.plan_groups(s, "track", ["dts"], "bytes", "dts", "dur", span_of("dts", 1e9), max_bytes=250, max_samples=3)
    assert [r["samples"] for r in g.orderBy("dts").collect()] == [2, 2, 2, 2]


def test_scale_projection(spark):
    p = RG.scale_projection(spark.createDataFrame([(72 * 3600.0,)], "s double"), "s", max_table_bytes=128 << 20).first()
    assert p["chunks"] == 518_400 and p["samples"] > 19_000_000 and not p["too_big"]


def test_transport(spark):
    p = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "pid int, n int, counter int")
    assert C.continuity_errors(p, "pid", ["n"], "counter", F.lit(True), F.lit(False), span_of("n", 10)).count() == 1
    u = C.unwrap_clock(spark.createDataFrame([(1, 0, 2**33 - 100), (1, 1, 50)], "pid int, n int, raw bigint"), "pid", ["n"], "raw", span_of("n", 1))
    assert rows(u, "n", "unwrapped")[1] == (1, 2**33 + 50)


def test_time_ranges_and_edit_list(spark):
    r = spark.createDataFrame([("t", 0.0, 1.0), ("t", 1.01, 2.0), ("t", 5.0, 6.0)], "k string, start double, end double")
    assert rows(T.merge_time_ranges(r, ["k"]), "start", "end") == [(0.0, 2.0), (5.0, 6.0)]
    edits = spark.createDataFrame([(1, 1, 2_000_000, -1), (1, 2, 2_000_000, 1_000_000)], "track_id int, edit_no int, segment_us bigint, source_us bigint")
    out = T.apply_edit_list(seconds(spark, set(), 5), edits)
    assert rows(out, "presentation_us", "timestamp_us") == [(2_000_000, 1_000_000), (3_000_000, 2_000_000)]


def test_throughput_and_variants(spark):
    d = spark.createDataFrame([("s", 1, 1_000_000, 1.0), ("s", 2, 100_000, 1.0)], "session string, n int, bytes bigint, seconds double")
    e = [r["estimate"] for r in SG.throughput(d, "session", ["n"], span_of("n", 1), initial=4e6).orderBy("n").collect()]
    assert e[0] > 4e6 and e[1] < 6e6
    v = spark.createDataFrame([("m", "low", 1e6, 640, 360), ("m", "mid", 3e6, 1280, 720), ("m", "high", 8e6, 3840, 2160)], "manifest_id string, variant_id string, bitrate double, width int, height int")
    q = lambda bw: spark.createDataFrame([("m", 1, bw)], "manifest_id string, request_id int, bandwidth double")
    assert SG.choose_variants(q(5e6), v, max_height=1080).first()["variant_id"] == "mid"
    assert SG.choose_variants(q(20e6), v, max_height=720).first()["variant_id"] == "mid"
    assert SG.choose_variants(q(1.0), v).first()["variant_id"] == "low"
    c = spark.createDataFrame([("s", 1, "mid", 3e6, 5e6), ("s", 2, "high", 8e6, 9e6), ("s", 3, "high", 8e6, 9.3e6)], "s string, n int, variant_id string, bitrate double, bandwidth double")
    assert [r["kept"] for r in SG.hold_upgrades(c, "s", ["n"]).orderBy("n").collect()] == ["mid", "mid", "high"]


def test_live_window(spark):
    seg = spark.createDataFrame([("s", 10 + i, False, f"u{i}", 4.0 * i, 4.0) for i in range(3)], "stream_id string, sequence int, partial boolean, url string, start double, duration double")
    st = spark.createDataFrame([("s", None, 8.0, None, None)], "stream_id string, part_hold_back double, hold_back double, suggested_delay double, target_duration double")
    assert SG.live_edges(seg, st).first()["position"] == 4.0
    cur = spark.createDataFrame([("s", None, 3.0)], "stream_id string, after_sequence int, playhead double")
    assert [r["sequence"] for r in SG.next_requests(seg, cur, 2).orderBy("turn").collect()] == [10, 11]


def test_playlist(spark):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXT-X-MAP:URI=\"i.mp4\"\n#EXTINF:4.5,first\n#EXT-X-BYTERANGE:100@50\na.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:3,\n#EXT-X-BYTERANGE:30\nb.ts\n#EXTINF:2\nc.ts\n"
    s = [r.asDict() for r in SG.playlist_segments(spark.createDataFrame([(1, text)], "playlist_id int, text string")).orderBy("sequence").collect()]
    assert [(x["sequence"], x["start"], x["duration"], x["title"], x["range_offset"], x["map_uri"], bool(x["discontinuity"])) for x in s] == [
        (7, 0.0, 4.5, "first", 50, "i.mp4", False), (8, 4.5, 3.0, "", 150, "i.mp4", True), (9, 7.5, 2.0, "", None, "i.mp4", False)]


def test_period_start_rules(spark):
    p = spark.createDataFrame([("m", 0, None, 10.0, 100.0), ("m", 1, None, None, 100.0), ("m", 2, 30.0, None, 100.0), ("m", 3, None, None, 100.0)],
                              "k string, i int, explicit_start double, declared double, total double")
    out = SG.period_windows(p, "k", "i", span_of("i", 2)).orderBy("i").collect()
    assert [(r["start"], r["duration"]) for r in out] == [(0.0, 10.0), (10.0, 20.0), (30.0, None), (30.0, 70.0)]


def test_latency_records(spark):
    s = spark.createDataFrame([("k", "source", 120.0, 1), ("k", "submitted", 130.0, 2), ("k", "decoded", 150.0, 3), ("k", "output", 180.0, 4), ("k", "source", 200.0, 5)],
                              "k string, stage string, at double, n int")
    d = L.stage_durations(L.correlate(s, ["k"], "at", "n", span_of("at", 10))).collect()
    assert [(r["source_to_submit_ms"], r["submit_to_decode_ms"], r["decode_to_output_ms"], r["source_to_output_ms"]) for r in d] == [(10.0, 20.0, 30.0, 60.0)]
    live = L.live_distances(spark.createDataFrame([(10.0, 13.0, 13.2, None, 3.0)], "p double, e double, n double, pos double, t double"), "p", "e", "n", "pos", "t").first()
    assert live["edge_ms"] == 3000 and live["presentation_ms"] == pytest.approx(3200) and live["target_error_ms"] == pytest.approx(200) and live["position_error_ms"] is None
    j = L.judge(spark.createDataFrame([(80.0, None), (None, None)], "a double, b double"), {"x": ("a", 50.0, False), "y": ("b", 1.0, True)}).collect()
    assert sorted([str(r["pass"]) for r in j]) == ["False", "None"]


def test_retention(spark):
    a = spark.createDataFrame([("a", "h1", 1, 0), ("alias", "h1", 1, 0), ("old", "h2", 12, 0), ("recent", "h3", 1, 9_500), ("unknown", "h4", 1, None)], "id string, hash string, size int, saved_at bigint")
    ids, hashes = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("h1",)], "hash string")
    assert rows(RT.retention_reasons(a, ids, hashes, 10_000, 1_000).select("id", F.coalesce("reason", F.lit("-")).alias("reason"))) == [
        ("a", "referenced-id"), ("alias", "referenced-hash"), ("old", "-"), ("recent", "recent"), ("unknown", "unknown-age")]


def test_curves(spark):
    p = spark.createDataFrame([("s", 0.0, 0.0, "linear", 0), ("s", 10.0, 100.0, "linear", 1), ("h", 0.0, 1.0, "linear", 0), ("h", 5.0, 2.0, "hold", 1), ("h", 8.0, 9.0, "linear", 2), ("h", 9.0, 4.0, "hold", 3)],
                              "k string, time double, value double, easing string, ordinal int")
    q = spark.createDataFrame([("s", 5.0), ("s", 2.5), ("h", 8.0), ("h", 6.0), ("h", 9.0), ("none", 1.0)], "k string, t double")
    got = {(r["k"], r["t"]): r["value_at"] for r in K.values_at(p, q, ["k"], "t", 7.0).collect()}
    assert got == {("s", 5.0): 50.0, ("s", 2.5): 25.0, ("h", 8.0): 2.0, ("h", 6.0): 2.0, ("h", 9.0): 4.0, ("none", 1.0): 7.0}
    n = spark.createDataFrame([("s", 1.0, 1.0, "linear", 0), ("s", 0.0, 0.0, "linear", 1), ("s", 1.0, 2.0, "hold", 2)], "k string, time double, value double, easing string, ordinal int")
    assert rows(K.normalize_curve(n, ["k"]), "time", "value", "easing") == [(0.0, 0.0, "linear"), (1.0, 2.0, "hold")]
    e = spark.createDataFrame([("s", 2.00005, 30.0, "linear", 9)], "k string, time double, value double, easing string, ordinal int")
    two = K.upsert_points(spark.createDataFrame([("s", 2.0, 15.0, "linear", 0)], e.schema), e, ["k"])
    assert rows(two, "value") == [(30.0,)] and K.remove_points(two, e, ["k"]).count() == 0


def test_frame_times(spark):
    o = spark.createDataFrame([(2.0, .5, 2.0)], "fps double, range_start double, range_end double")
    assert rows(E.frame_times(o), "t") == [(.5,), (1.0,), (1.5,)]


def test_signal(spark):
    left, right = [0, .5, -1, .25, 0, .2, -.4, 0], [.1, .2, -.3, .1, 0, .8, .1, 0]
    s = spark.createDataFrame([("b", c, i, float(v)) for c, ch in enumerate((left, right)) for i, v in enumerate(ch)], "buffer_id string, channel int, i bigint, v double")
    assert [r["peak"] for r in A.waveform(s, 4).orderBy("bin").collect()] == [.5, 1.0, .8, .4]
    b = spark.createDataFrame([("b", 0, 0, 2.0, i, float(v)) for i, v in enumerate((1, 2, 3))], "buffer_id string, channel int, block_no int, timestamp double, offset bigint, v double")
    r = spark.createDataFrame([("b", 2.0, 2.5)], "buffer_id string, range_start double, range_end double")
    assert [x["v"] for x in A.merge_blocks(b, r, 10.0).orderBy("i").collect()] == [1.0, 2.0, 3.0, 0.0, 0.0]
    src = spark.createDataFrame([("b", 0, i, float(i + 1)) for i in range(10)], "buffer_id string, channel int, i bigint, v double")
    item = spark.createDataFrame([(1, 1, "b", 0, 2, 5, 1.0, 0.0, -1.0, 0, 0)], "item_id int, output_id int, buffer_id string, dest_start int, source_start int, frames int, playback_rate double, gain_db double, pan double, fade_in int, fade_out int")
    out = A.mix(item, src, spark.createDataFrame([(1, 5)], "output_id int, length int")).orderBy("i").collect()
    assert [round(x["left"], 9) for x in out] == [3, 4, 5, 6, 7] and all(abs(x["right"]) < 1e-9 for x in out)


CLIP = "clip_id int, track_id string, asset_id int, start double, duration double, in_point double, playback_rate double, enabled boolean"


def clips(spark, *items):
    return spark.createDataFrame([(i, "v", 1, float(s), float(d), float(p), float(r), True) for i, s, d, p, r in items], CLIP)


def test_timeline_edits(spark):
    three = clips(spark, (1, 0, 6, 0, 1), (2, 6, 6, 0, 1), (3, 12, 6, 0, 1))
    assert rows(T.ripple_delete(three, F.col("clip_id") == 2), "start") == [(0.0,), (6.0,)]
    two = clips(spark, (1, 0, 6, 0, 1), (2, 6, 6, 0, 1))
    ins = spark.createDataFrame([("v", 9, 6.0, 2.0)], "track_id string, insert_id bigint, at double, insert_duration double")
    assert sorted(round(r["start"], 6) for r in T.ripple_insert(two, ins).collect()) == [0, 6, 8]
    assert T.overlaps(clips(spark, (1, 0, 6, 0, 1), (2, 4, 6, 0, 1))).count() == 1
    pts = T.snap_points(two)
    pr = spark.createDataFrame([("v", 1, 5.88, None)], "track_id string, probe_id int, probe double, exclude int")
    assert T.snap(pts, pr).first()["time"] == 6.0
    tracks = spark.createDataFrame([("v", "visual", False, False, 0)], "track_id string, asset_kind string, locked boolean, muted boolean, ord int")
    footage = spark.createDataFrame([(1, "video", 100.0)], "asset_id int, asset_kind string, source_duration double")
    t = T.trim(two, spark.createDataFrame([(1, "end", 5.0)], "clip_id int, edge string, time double"), tracks, footage).first()
    assert t["duration"] == 5.0 and t["reason"] is None
    assert T.slip(two, spark.createDataFrame([(1, 2.0, None)], "clip_id int, delta double, to_in double"), footage).first()["in_point"] == 2.0
    assert T.set_rate(clips(spark, (1, 0, 8, 0, 1)), spark.createDataFrame([(1, 2.0)], "clip_id int, rate double")).first()["duration"] == 4.0


def test_search_and_masking(spark):
    d = spark.createDataFrame([("m", "object", "Maya", "person hero cast", "full"), ("j", "object", "Jacket", "wardrobe blue denim", "full"), ("s", "object", "Secret", "hero", "none"),
                               ("x", "object", "Odd", "hero", "whatever")], "id string, kind string, name string, text string, access string")
    seen = P.mask(d, "access", ["text"])
    assert rows(seen, "id") == [("j",), ("m",)]
    out = S.search(seen, [S.Field("name", 10, "name"), S.Field("text", 7, "tags")], {"a": "Maya", "b": "blue jacket"}, 1)
    assert rows(out, "query", "id", "score") == [("a", "m", 30), ("b", "j", 21)]
    capped = S.build_postings(seen, [S.Field("name", 10, "name"), S.Field("text", 7, "tags")], max_terms=2)
    assert rows(capped.where("id='m'"), "term") == [("maya",), ("person",)]


def test_relation_and_nested_terms(spark):
    n = spark.createDataFrame([("m", "object", "Maya"), ("d", "clip", "Desert reveal")], "id string, kind string, name string")
    e = spark.createDataFrame([("m", "d", "relates-to", "appears-in")], "src string, dst string, type string, role string")
    t = S.relation_emissions(n, e).where("id = 'm'")
    assert {r["term"] for r in t.collect()} == {"relates", "to", "appears", "in", "desert", "reveal", "clip"}
    k = S.nested_emissions(spark.createDataFrame([("m", {"material": "denim"})], "id string, sem map<string,string>"), "sem", 5, "object:semantics")
    assert rows(k, "term", "weight", "source") == [("denim", 5, "object:semantics:material"), ("material", 4, "object:semantics:key")]


def test_tokens_are_normalised(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ ﬁne Ünï-code 42²",)], "x string")
    assert df.select(tokens(F.col("x"))).first()[0] == ["full", "fine", "ünï", "code", "422"]


def test_vectors_and_fusion(spark):
    idx = spark.createDataFrame([("m", "o", "Maya", [1.0, 0.0, 1.0]), ("p", "o", "Product", [0.0, 1.0, 0.0]), ("z", "o", "Zero", [0.0, 0.0, 0.0])], "id string, kind string, name string, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 1.0])], "query string, vector array<double>")
    got = V.vector_top_k(idx, q, 3).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("m", 1.0), ("p", 0.0), ("z", 0.0)]
    lex = spark.createDataFrame([("q", "m", "o", "Maya", 1)], "query string, id string, kind string, name string, rank int")
    assert V.fuse(lex, V.vector_top_k(idx, q, 3), 1).first()["id"] == "m"


def test_checksums(spark):
    def slow(text):
        h = 0xCBF29CE484222325
        for ch in text.encode("utf-16-le"):
            h = ((h ^ ch) * 0x100000001B3) % 2**64
        return f"{h:016x}"

    texts = ["", "a", '{"a":1}', "ünï €", "𝄞 clef", "x" * 300]
    assert H.fnv64_texts(texts) == [slow(t) for t in texts]
    df = spark.createDataFrame([('{"b": 1.0, "a": [true, null, 1e-7], "é": "x"}',)], "j string")
    assert df.select(H.canonical_json("j")).first()[0] == '{"a":[true,null,1e-7],"b":1,"é":"x"}'


def test_log_chain_and_replay(spark):
    log = O.append_chain(spark.createDataFrame([(1, i, 100 + i, f"p{i}") for i in (1, 2, 3)], "project_id bigint, seq bigint, tx_id bigint, payload string"))
    assert O.chain_violations(log, span_of("seq", 2)).count() == 0
    assert rows(O.chain_violations(log.withColumn("payload", F.expr("if(seq=2,'x',payload)")), span_of("seq", 2)), "seq", "code") == [(2, "checksum-mismatch")]
    assert (3, "chain-mismatch") in rows(O.chain_violations(log.withColumn("previous", F.expr("if(seq=3,'x',previous)")), span_of("seq", 2)), "seq", "code")
    assert (3, "sequence-gap") in rows(O.chain_violations(log.where("seq<>2"), span_of("seq", 2)), "seq", "code")
    ops = spark.createDataFrame([(1, 1, "node.add", 5, 6, "x", 1.0, 1), (1, 2, "node.update", 5, 6, "y", 2.0, 2), (1, 3, "edge.add", 5, 6, "", 0.0, 3), (1, 4, "node.remove", 6, 0, "", 0.0, 4),
                                 (1, 5, "edge.add", 5, 7, "", 0.0, 5), (1, 6, "edge.add", 5, 7, "", 0.0, 6), (1, 7, "edge.remove", 0, 0, "", 0.0, 6)],
                                "project_id int, seq int, op_type string, entity_id int, other_id int, prop string, value double, edge_id int")
    assert rows(O.replay_nodes(ops), "prop", "value") == [("x", 1.0), ("y", 2.0)]
    assert rows(O.replay_edges(ops), "edge_id") == [(5,)]


def test_compaction_refuses_a_moved_head(spark, tmp_path):
    state = spark.createDataFrame([(1, 2.0)], "id int, v double")
    assert O.compact(spark, str(tmp_path / "log"), 0, state) == 1
    assert O.compact(spark, str(tmp_path / "log"), 1, state) == 2
    with pytest.raises(RuntimeError):
        O.compact(spark, str(tmp_path / "log"), 1, state)
    with pytest.raises(RuntimeError):
        O.compact(spark, str(tmp_path / "log"), 7, state)


def test_conflicts(spark):
    schema = "project_id int, seq int, op_idx int, op_type string, entity_id int, other_id int, prop string, edge_id int"
    op = lambda seq, kind, entity, prop="", tx=0: (1, seq, 0, kind, entity, 9, prop, tx)
    pair = lambda a, b: CF.conflict_pairs(spark.createDataFrame([a], schema), spark.createDataFrame([b], schema)).count()
    hits = lambda a, b: CF.conflict_counts(spark.createDataFrame([a], schema), spark.createDataFrame([b], schema)).first()["hits"]
    cases = [(op(1, "node.update", 5, "x"), op(1, "node.update", 5, "x"), True), (op(1, "node.update", 5, "x"), op(1, "node.update", 5, "y"), False),
             (op(1, "node.remove", 5), op(1, "node.update", 5, "x"), True), (op(1, "node.paint", 5), op(1, "node.update", 7, "x"), True),
             (op(1, "node.update", 5, "x"), op(1, "node.update", 6, "x"), False)]
    for a, b, bad in cases:
        assert (pair(a, b) > 0) == bad and (hits(a, b) > 0) == bad


def test_quarantine(spark):
    a = spark.createDataFrame([("b", i, 1000 * i, r, 1.0) for i, r in enumerate(["failure"] * 3 + ["unsupported", "failure", "success", "failure"])], "backend_id string, n int, at bigint, result string, duration_ms double")
    out = M.quarantine(a, ["at", "n"], span_of("at", 2000), 3, 30_000).orderBy("n").collect()
    assert [(r["consecutive"], r["until"], r["allowed"]) for r in out] == [(1, 0, True), (2, 0, True), (3, 32000, True), (3, 32000, False), (4, 34000, False), (0, 0, False), (1, 0, True)]


def test_nonces(spark):
    m = spark.createDataFrame([("a", "k", "p", "n", 1), ("a", "k", "p", "n", 2), ("a", "k", "q", "n", 3)], "a string, k string, p string, n string, at int")
    assert rows(TR.replays(m, ["a", "k", "p", "n"], ["at"]), "at", "replayed") == [(1, False), (2, True), (3, False)]


def test_dependencies(spark):
    t = spark.createDataFrame([(1, "failed"), (2, "pending"), (3, "pending"), (4, "complete")], "task_id int, status string")
    d = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "task_id int, depends_on int")
    assert rows(J.fail_cascade(t, d), "task_id", "status") == [(1, "failed"), (2, "failed"), (3, "failed"), (4, "complete")]
    assert rows(J.task_levels(t, d), "task_id", "level") == [(1, 0), (2, 1), (3, 2), (4, 1)]
    loop = d.unionByName(spark.createDataFrame([(1, 3)], "task_id int, depends_on int"))
    assert {r["code"] for r in J.dependency_violations(t, loop).collect()} == {"cycle"}


def test_cache_prune_and_verify(spark):
    a = spark.createDataFrame([("old", "s", "p", "k", "f0"), ("new", "s", "p", "k", "f1"), ("else", "s", "p2", "k", "f0")], "key string, schema string, project_id string, kinds string, fingerprint string")
    cur = spark.createDataFrame([("s", "p", "k", "f1")], "schema string, project_id string, kinds string, fingerprint string")
    assert rows(RT.prune_states(a, cur), "key", "state") == [("else", "other"), ("new", "retain"), ("old", "remove")]


def test_project_files(spark):
    graph = {"version": 1, "projectId": "p", "nodes": {"p": {"id": "p", "kind": "project", "name": "P", "props": {"a": {"b": 1}}}}, "edges": {"e": {"id": "e", "from": "p", "to": "q", "type": "contains", "props": {}}}}
    docs = spark.createDataFrame([("v0", json.dumps(graph)), ("v2", json.dumps({"fileVersion": 2, "graph": graph})), ("v9", json.dumps({"fileVersion": 9, "graph": graph})), ("bad", "{nope"), ("none", "{}")], "path string, body string")
    nodes, edges, rejects = GF.parse_documents(docs)
    assert rows(nodes.select("path", "id", F.variant_get("props", "$.a.b", "int").alias("b"))) == [("v0", "p", 1), ("v2", "p", 1)]
    assert rows(edges, "path", "src", "dst") == [("v0", "p", "q"), ("v2", "p", "q")]
    assert rows(rejects, "path", "reason") == [("bad", "not-json"), ("none", "no-version"), ("v9", "newer-version")]


def test_payload_shape(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}'), (2, "oops"), (3, '{"a": NaN}')], "id int, j string")
    got = {r["id"]: r for r in Q.payload_report(df, "id", "j", 100).collect()}
    assert (got[1]["depth"], got[1]["entries"], got[1]["broken"]) == (3, 4, "")
    assert got[2]["broken"] == "not-json" and got[3]["broken"] == "not-finite"


def test_preflight_of_edges(spark):
    rows_ = [(1, "node.add", 1, 0, 0), (2, "node.add", 2, 0, 0), (3, "edge.add", 1, 2, 9), (4, "node.remove", 2, 0, 0), (5, "node.add", 2, 0, 0),
             (6, "edge.add", 1, 2, 9), (7, "node.remove", 8, 0, 0), (8, "edge.remove", 0, 0, 77), (9, "edge.add", 2, 1, 9)]
    schema = "project_id long, seq long, op_type string, entity_id long, other_id long, edge_id long"

    def first(ops, roots=None):
        df = spark.createDataFrame([(1, *r) for r in ops], schema)
        return rows(O.first_failures(df, span_of("seq", 4), 4, roots), "seq", "phase", "code")

    assert first(rows_) == [(9, "apply", "edge-exists")]  # the end of edge 9 went in between, so op 6 may add it again
    assert first(rows_[:8]) == []
    assert first([*rows_[:2], (3, "edge.add", 1, 5, 9)]) == [(3, "apply", "unknown-node")]
    assert first([*rows_, (10, "node.paint", 1, 0, 0)]) == [(10, "schema", "unsupported-operation")]
    root = spark.createDataFrame([(1, 2)], "project_id long, entity_id long")
    assert first(rows_, root) == [(4, "apply", "project-root")]


def test_depth_has_no_limit(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)], "src long, dst long")
    assert G.closure(chain).where("src = 0").agg(F.max("depth")).first()[0] == 100
    edges = [("C", "T", "contains"), ("C", "D", "contains"), ("D", "U", "contains"), ("X0", "L", "targets")] + [(f"X{k + 1}", f"X{k}", "targets") for k in range(20)]
    edges = spark.createDataFrame(edges, "src string, dst string, type string")
    clips = spark.createDataFrame([("L", "T"), ("M", "U")], "clip_id string, track_id string")
    got = {r.id for r in G.render_closure(edges, spark.createDataFrame([("C",)], "id string"), clips).collect()}
    assert got == {"C", "T", "D", "L"} | {f"X{k}" for k in range(21)}  # D is a child, what is inside it is not
    refs = [(f"i{k}", 0, f"i{k + 1}", 1.0, None) for k in range(6)] + [("i6", 0, None, 1.0, 5)]
    refs = spark.createDataFrame(refs, "index_id string, ref_no int, child_index string, duration double, size long")
    assert rows(SG.expand_references(refs), "root_id", "size") == [("i0", 5)]
    with pytest.raises(ValueError):
        loop = spark.createDataFrame([("r", 0, "a", 1.0, None), ("a", 0, "b", 1.0, None), ("b", 0, "a", 1.0, None)], refs.schema)
        SG.expand_references(loop)


def test_equal_times_keep_the_order_of_numbers(spark):
    points = spark.createDataFrame([(1, 5.0, 9, "old"), (1, 5.0, 10, "new")], "k int, t double, n int, v string")
    probes = spark.createDataFrame([(1, 6.0)], "k int, p double")
    assert asof(points, probes, ["k"], "t", "p", ["v"], "n", 10).first()["left"]["v"] == "new"


def test_long_ranges_and_runs_expand_in_blocks(spark):
    point, wide = spark.createDataFrame([(1, 9e6)], "k int, t double"), spark.createDataFrame([(1, 0.0, 1e7)], "k int, a double, b double")
    assert point_join(point, wide, ["k"], "t", "a", "b", 1.0).count() == 1
    runs = spark.createDataFrame([(1, 0, 3_000_000)], "k int, o int, n long")
    assert C.expand_runs(runs, "k", ["o"], "n", span_of("o", 10)).agg(F.max("number")).first()[0] == 3_000_000


def test_batches_of_one_project_are_judged_apart(spark):
    schema = "project_id int, seq int, op_idx int, op_type string, entity_id int, other_id int, prop string, edge_id int, tx_id int"
    log = spark.createDataFrame([(1, 1, 0, "node.add", 1, 0, "", 0, 11), (1, 2, 0, "node.update", 1, 0, "x", 0, 12)], schema)
    ops = spark.createDataFrame([(1, 1, 0, "node.update", 1, 0, "x", 0, 21, 7), (1, 1, 0, "node.update", 1, 0, "y", 0, 22, 8)], schema + ", batch_id int")
    batches = spark.createDataFrame([(7, 1, 1, 1, 1, 11), (8, 1, 1, 1, 1, 11)], "batch_id int, project_id int, base_revision int, log_revision int, fork_seq int, fork_tx int")
    assert rows(CF.rebase_status(batches, log, ops), "batch_id", "status") == [(7, "conflict"), (8, "rebase-safe")]


def test_cursors_of_a_stream_are_ranked_apart(spark):
    seg = spark.createDataFrame([(1, k, False, f"u{k}", float(k), 1.0) for k in range(4)], "stream_id int, sequence long, partial boolean, url string, start double, duration double")
    cur = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "stream_id int, after_sequence long, playhead double")
    assert rows(SG.next_requests(seg, cur, 2), "after_sequence", "sequence") == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_energy_without_a_first_channel(spark):
    s = spark.createDataFrame([(1, 1, k, 0.5) for k in range(100)], "buffer_id int, channel int, i long, v double")
    assert A.block_energy(s, 20, 10).count() > 0


def test_several_ripple_trims_of_a_track_are_refused(spark):
    clips = spark.createDataFrame([("a", "t", 0.0, 10.0, 0.0, 1.0, True, 1), ("b", "t", 10.0, 10.0, 0.0, 1.0, True, 1)],
                                  "clip_id string, track_id string, start double, duration double, in_point double, playback_rate double, enabled boolean, asset_id int")
    tracks = spark.createDataFrame([("t", "visual", False, False, 1)], "track_id string, asset_kind string, locked boolean, muted boolean, ord int")
    footage = spark.createDataFrame([(1, "video", 100.0)], "asset_id int, asset_kind string, source_duration double")
    edit = lambda *e: T.ripple_trim_end(clips, spark.createDataFrame(list(e), "clip_id string, time double"), tracks, footage)
    assert rows(edit(("a", 5.0)), "clip_id", "start", "duration") == [("a", 0.0, 5.0), ("b", 5.0, 10.0)]
    assert rows(edit(("a", 5.0), ("b", 15.0)), "clip_id", "start", "reason") == [("a", 0.0, "several-edits"), ("b", 10.0, "several-edits")]
    ins = spark.createDataFrame([("t", "n", 5.0, 2.0)], "track_id string, insert_id string, at double, insert_duration double")
    assert {r.clip_id for r in T.ripple_insert(clips, ins, 100.0).collect()} == {"a", "b", None}


def test_checksum_of_one_long_text_among_short_ones():
    texts = ["a", "x" * 1_000_000, "", "bc"] + ["q"] * 1000
    got = H.fnv64_texts(texts)
    assert [got[0], got[2], got[3]] == [H.fnv64_texts([t])[0] for t in ("a", "", "bc")] and len(set(got[4:])) == 1


def test_depth_of_nonces_is_not_capped(spark):
    many = spark.range(20_000).select(F.col("id").cast("string").alias("nonce"), F.lit(5).alias("consumed_at"))
    assert TR.retain_nonces(many, 10).count() == 20_000


def test_energy_blocks_start_within_the_first_channel(spark):
    s = spark.createDataFrame([(1, 0, k, 1.0) for k in range(15)] + [(1, 1, k, 1.0) for k in range(40)], "buffer_id int, channel int, i long, v double")
    assert {r.block_no: r.energy for r in A.block_energy(s, 20, 10).collect()} == {0: 2.0, 1: 2.0}
    lone = s.where("channel = 1")
    assert {r.block_no for r in A.block_energy(lone, 20, 10).collect()} == {0, 1, 2, 3}
