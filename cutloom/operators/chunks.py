"""Sample-index tables: checks, seek, windows, grouping and transport repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .fold import greedy_groups, ordered_fold
from .intervals import explode_range, overlap_join
from .scan import asof, span_of, span_scan

NULL_PID = 0x1FFF  # fixed value: filler packets
WRAP = 1 << 33     # fixed value: 33-bit clock


# --- checks -----------------------------------------------------------------------------------------------------------

def byte_range_violations(chunks: DataFrame, sizes: DataFrame, key: str, offset: str = "off", length: str = "len") -> DataFrame:
    """Rows of ``chunks`` outside their source; ``sizes`` is (key, source_size). A missing source counts as size 0."""
    j = chunks.join(sizes, key, "left").withColumn("source_size", F.coalesce("source_size", F.lit(0)))
    o, n = F.col(offset), F.col(length)
    return j.where((o < 0) | (n < 0) | o.isNull() | n.isNull() | (o + n > F.col("source_size")))


def timeline_violations(chunks: DataFrame, track: str, dts: str, sequence: str, span: Column) -> DataFrame:
    """Decode-time and sequence regressions per track in (dts, sequence) order; arrival order is not used here."""
    x = span_scan(chunks, [track], [dts, sequence], span, last_dts=("lag", F.col(dts)), last_seq=("lag", F.col(sequence)))
    codes = F.array_compact(F.array(F.when(F.col(dts) < F.col("last_dts"), F.lit("decode-time-regression")),
                                    F.when(F.col(sequence) <= F.col("last_seq"), F.lit("sequence-regression"))))
    return x.select(track, sequence, dts, F.explode(codes).alias("type"))


def arrival_violations(chunks: DataFrame, track: str, arrival: str, time: str, sequence: str, is_key: str,
                       span: Column, initial_key: bool = False) -> DataFrame:
    """Problems of a track in arrival order: time going back, sequence not rising, first chunk not a key."""
    x = span_scan(chunks, [track], [arrival], span, p_time=("lag", F.col(time)), p_seq=("lag", F.col(sequence)),
                  __n=("row_number",))
    codes = [F.when(F.col(time) < F.col("p_time"), F.lit("non-monotonic-timestamp")),
             F.when(F.col(sequence) <= F.col("p_seq"), F.lit("non-increasing-sequence"))]
    if initial_key:
        codes.append(F.when((F.col("__n") == 1) & ~F.col(is_key), F.lit("missing-initial-key")))
    return x.select(track, arrival, F.explode(F.array_compact(F.array(*codes))).alias("type"))


def partition_violations(chunks: DataFrame, job: str, index: str, first: str, end: str, span: Column,
                         totals: DataFrame | None = None) -> DataFrame:
    """(job, type, index, expected, actual): does each job's chunk list tile its frames in index order?

    ``totals`` (job, frame_count) adds the whole-job frame count check.
    """
    x = span_scan(chunks, [job], [index, first, end], span, p_end=("lag", F.col(end)), __n=("row_number",))
    big = "bigint"
    item = F.array_compact(F.array(
        F.when(F.col(end) < F.col(first), F.struct(F.lit("negative-frame-range").alias("type"),
                                                   F.col(first).cast(big).alias("expected"), F.col(end).cast(big).alias("actual"))),
        F.when(F.col("p_end") != F.col(first), F.struct(F.lit("frame-gap-or-overlap").alias("type"),
                                                        F.col("p_end").cast(big).alias("expected"), F.col(first).cast(big).alias("actual"))),
        F.when(F.col(index) != F.col("__n") - 1, F.struct(F.lit("chunk-index").alias("type"),
                                                        (F.col("__n") - 1).cast(big).alias("expected"), F.col(index).cast(big).alias("actual")))))
    out = x.select(job, F.col(index).cast(big).alias("index"), F.explode(item).alias("v")).select(job, "index", "v.*")
    if totals is not None:
        have = chunks.groupBy(job).agg(F.sum(F.greatest(F.lit(0), F.col(end) - F.col(first))).cast(big).alias("actual"))
        miss = totals.join(have, job, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(
            F.col("frame_count") != F.col("actual"))
        out = out.unionByName(miss.select(job, F.lit(-1).cast(big).alias("index"), F.lit("frame-count").alias("type"),
                                          F.col("frame_count").cast(big).alias("expected"), "actual"))
    return out


# --- seek and windows -------------------------------------------------------------------------------------------------

def seek_index(chunks: DataFrame, timescale: float = 1e6) -> DataFrame:
    """Chunks with start and end seconds; write it bucketed by track and sorted by time."""
    t = F.col("timestamp_us")
    return chunks.withColumn("time", t / F.lit(float(timescale))).withColumn(
        "end_time", (t + F.coalesce("duration_us", F.lit(0))) / F.lit(float(timescale)))


def nearest_keyframe(index: DataFrame, probes: DataFrame, span_width: float = 86400.0) -> DataFrame:
    """Probe rows (track_id, probe, ..) with ``backward``, ``forward`` and ``nearest`` key times.

    Backward falls to the first key when none is at or before; forward falls to the last; nearest prefers the earlier.
    """
    keys = index.where("is_key").select("track_id", "time", "sequence")
    p = probes.withColumn("__at", F.greatest(F.lit(0.0), F.col("probe")))
    # the same probe needs "at or before" and "at or after": a key equal to the probe sits on the left side here
    a = asof(keys, p, ["track_id"], "time", "__at", ["sequence"], "sequence", span_width, strict=False)
    left, right = F.col("left.time"), F.col("right.time")
    exact = left == F.col("__at")
    forward = F.when(exact, left).otherwise(F.coalesce(right, left))
    near = F.when(right.isNull() | ((F.col("__at") - left) <= (right - F.col("__at"))), left).otherwise(right)
    return a.select(*probes.columns, F.coalesce(left, right).alias("backward"), forward.alias("forward"),
                    F.coalesce(near, right).alias("nearest"))


def decode_windows(index: DataFrame, probes: DataFrame, ahead: float = 2.0, behind: float = 0.25,
                   width: float = 3600.0) -> DataFrame:
    """Chunks to decode per probe: from the key at or before ``probe - behind`` up to ``probe + ahead``.

    Both bounds are strict: a chunk that ends exactly at the start, or begins exactly at the end, is left out.
    """
    p = probes.withColumn("__target", F.greatest(F.lit(0.0), F.col("probe"))).withColumn(
        "__from", F.greatest(F.lit(0.0), F.col("__target") - F.lit(max(0.0, behind)))).withColumn(
        "window_end", F.col("__target") + F.lit(max(0.0, ahead)))
    named = p.withColumnRenamed("probe", "__probe").withColumn("probe", F.col("__from"))
    k = nearest_keyframe(index, named).withColumn("window_start", F.coalesce("backward", "__from"))
    w = k.select("track_id", F.col("__probe").alias("probe"), *[c for c in probes.columns if c not in ("track_id", "probe")],
                 "window_start", "window_end")
    cond = (F.col("time") < F.col("window_end")) & (F.col("end_time") > F.col("window_start"))
    # a first key after the window end gives an empty window, which must not become a backwards sequence
    w = w.where(F.col("window_start") <= F.col("window_end"))
    return overlap_join(w, index, ["track_id"], "window_start", "window_end", "time", "end_time", width, cond)


def chunk_windows(chunks: DataFrame, requests: DataFrame, width_us: float = 3600e6) -> DataFrame:
    """Chunks per request (track_id, request, start_us, end_us, preroll_us).

    A chunk that touches the left bound counts (inclusive). The window then reaches back to the last key chunk at or
    before the request start among the chunks up to the first match, in list (sequence) order, if there is one.
    """
    r = requests.withColumn("__lo", F.greatest(F.lit(0), F.col("start_us") - F.col("preroll_us")))
    c = chunks.withColumn("__end", F.col("timestamp_us") + F.col("duration_us"))
    hit = overlap_join(r, c, ["track_id"], "__lo", "end_us", "timestamp_us", "__end", width_us,
                       (F.col("timestamp_us") < F.col("end_us")) & (F.col("__end") >= F.col("__lo")))
    return hit.drop("__lo", "__end")


def extended_windows(chunks: DataFrame, requests: DataFrame, width_us: float = 3600e6) -> DataFrame:
    """``chunk_windows`` for time-ordered lists, reaching back to the key chunk that the first match depends on.

    With such a key the window is every chunk from the key up to the request end; without one it is the plain matches.
    """
    first = chunk_windows(chunks, requests, width_us).groupBy("track_id", "request").agg(
        F.min("timestamp_us").alias("__first"))
    r = requests.join(first, ["track_id", "request"]).withColumn("__seek", F.least("__first", "start_us"))
    keys = chunks.where("is_key").select("track_id", F.col("timestamp_us").alias("time"), "sequence")
    k = asof(keys, r, ["track_id"], "time", "__seek", ["sequence"], "sequence", width_us, strict=False)
    k = k.withColumn("__key", F.col("left.time")).withColumn("__lo", F.coalesce(
        "__key", F.greatest(F.lit(0), F.col("start_us") - F.col("preroll_us")))).drop("left", "right")
    c = chunks.withColumn("__end", F.col("timestamp_us") + F.col("duration_us"))
    t = F.col("timestamp_us")
    keep = (t < F.col("end_us")) & F.when(F.col("__key").isNotNull(), t >= F.col("__key")).otherwise(
        F.col("__end") >= F.col("__lo"))
    return overlap_join(k, c, ["track_id"], "__lo", "end_us", "timestamp_us", "__end", width_us, keep).select(
        "request", *chunks.columns)


def chunks_in_range(chunks: DataFrame, requests: DataFrame, width_us: float = 3600e6) -> DataFrame:
    """Half-open audio range with pre- and post-roll: ``t < to`` and ``t + duration > from``."""
    r = requests.withColumn("__from", F.greatest(F.lit(0), F.col("start_us") - F.col("preroll_us"))).withColumn(
        "__to", F.col("end_us") + F.greatest(F.lit(0), F.col("postroll_us")))
    c = chunks.withColumn("__end", F.col("timestamp_us") + F.greatest(F.lit(0), F.col("duration_us")))
    return overlap_join(r, c, ["track_id"], "__from", "__to", "timestamp_us", "__end", width_us,
                        (F.col("timestamp_us") < F.col("__to")) & (F.col("__end") > F.col("__from"))).drop(
        "__from", "__to", "__end")


def plan_summary(chunks: DataFrame) -> DataFrame:
    """Per track: duration (largest end) and number and checksum-free extent of distinct key times."""
    # distinct key times first, so that a hot track folds map-side
    k = chunks.groupBy("track_id", "timestamp_us").agg(
        F.max(F.col("timestamp_us") + F.col("duration_us")).alias("end"), F.bool_or("is_key").alias("key"))
    return k.groupBy("track_id").agg(
        (F.max("end") / 1e6).alias("duration"), F.count(F.when(F.col("key"), 1)).alias("seek_points"),
        F.min(F.when(F.col("key"), F.col("timestamp_us"))).alias("first_seek_us"),
        F.max(F.when(F.col("key"), F.col("timestamp_us"))).alias("last_seek_us"))


def seek_points(chunks: DataFrame) -> DataFrame:
    """Distinct key times per track, long form."""
    return chunks.where("is_key").select("track_id", "timestamp_us").distinct()


def extent(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("track_id").agg(
        F.min("timestamp_us").alias("start_us"), F.max(F.col("timestamp_us") + F.col("duration_us")).alias("end_us")).withColumn(
        "duration_us", F.greatest(F.lit(0), F.col("end_us") - F.col("start_us")))


# --- sample tables ----------------------------------------------------------------------------------------------------

def expand_runs(runs: DataFrame, key: str, order: Sequence[str], count: str, span: Column) -> DataFrame:
    """One row per element of run-length rows, numbered from 1 per key; empty runs give none."""
    x = span_scan(runs, [key], order, span, __before=("sum_before", F.col(count)))
    x = x.where(F.col(count) > 0)
    x = explode_range(x, F.lit(1).cast("bigint"), F.col(count).cast("bigint") + 1, "__i")
    return x.withColumn("number", (F.col("__before") + F.col("__i")).cast("bigint")).drop("__before", "__i")


def sample_index(samples: DataFrame, track: str, chunk: str, slot: Sequence[str], duration: str, size: str,
                 composition: str, chunk_offset: str, is_sync: Column, span: Column) -> DataFrame:
    """Number, decode / presentation time, byte offset and key flag of every sample of a track.

    ``chunk`` and ``slot`` order the samples; offsets run inside a chunk, decode times along the whole track.
    """
    order = [chunk, *slot]
    x = span_scan(samples, [track], order, span, sample_number=("row_number",), dts=("sum_before", F.col(duration)),
                  __bytes=("sum_before", F.col(size)))
    first = x.groupBy(track, chunk).agg(F.min("__bytes").alias("__base"))
    x = x.join(first, [track, chunk])
    return x.withColumn("pts", F.greatest(F.lit(0), F.col("dts") + F.col(composition))).withColumn(
        "byte_offset", F.col(chunk_offset) + F.col("__bytes") - F.col("__base")).withColumn("is_sync", is_sync).drop(
        "__bytes", "__base")


# --- grouping ---------------------------------------------------------------------------------------------------------

def plan_groups(samples: DataFrame, track: str, order: Sequence[str], size: str, dts: str, duration: str, span: Column,
                max_bytes: int = 8 << 20, max_duration: float = 1_000_000, max_samples: int = 4096,
                block_rows: int | None = None) -> DataFrame:
    """Interleave groups of each track: (track, head, samples, bytes, dts, duration), greedy within the bounds."""
    x = samples.withColumn("__end", F.col(dts) + F.col(duration))
    g = greedy_groups(x, [track], order, span, size, dts, "__end", max_bytes, max_duration, max_samples, block_rows)
    return g.groupBy(track, "head").agg(
        F.count("*").alias("samples"), F.sum(size).cast("bigint").alias("bytes"), F.min("row").alias("first_row"),
        F.min(dts).alias("dts"), (F.max("__end") - F.min(dts)).alias("duration")).drop("first_row")


def change_runs(rows: DataFrame, key: str, order: Sequence[str], value: str, span: Column) -> DataFrame:
    """Run-length entries: (key, first, value) where ``first`` is the 1-based row at which the value starts."""
    x = span_scan(rows, [key], order, span, first=("row_number",), __p=("lag", F.col(value)))
    return x.where(F.col("__p").isNull() | (F.col("__p") != F.col(value))).select(key, "first", value)


def interleave_violations(samples: DataFrame, tracks: DataFrame, track: str, arrival: str, dts: str, span: Column) -> DataFrame:
    """Samples of unknown tracks and decode times that go back within a track in arrival order."""
    unknown = samples.join(tracks.select(track), track, "left_anti").select(track, arrival, F.lit("unknown-track").alias("type"))
    x = span_scan(samples, [track], [arrival], span, __p=("lag", F.col(dts)))
    back = x.where(F.col(dts) < F.col("__p")).select(track, arrival, F.lit("non-monotonic-dts").alias("type"))
    return unknown.unionByName(back)


def segment_samples(samples: DataFrame, plan: str, order: Sequence[str], time: str, end: str, can_split: Column,
                    target_us: int, span: Column) -> DataFrame:
    """(plan, segment, start, end, samples): cut at the first splittable sample at or past each boundary.

    Only splittable samples can move the boundary and only the first of each target-sized slot matters, so at most one
    row per slot goes through the ordered fold; everything else is windows.
    """
    t = F.col(time)
    cand = samples.where(can_split).withColumn("__slot", F.floor(t / target_us))
    cand = cand.groupBy(plan, "__slot").agg(F.min(F.struct(*order)).alias("__o"), F.min_by(time, F.struct(*order)).alias("__t"))

    def step(boundary, values):
        at = values[0]
        boundary = target_us if boundary is None else boundary
        cut = at >= boundary
        if cut:
            boundary = (at // target_us + 1) * target_us
        return boundary, (bool(cut),)

    cuts = ordered_fold(cand, [plan], ["__o"], lambda: None, step, ["__t"], "cut boolean").where("cut")
    marks = cuts.select(plan, *[F.col(f"__o.{c}").alias(c) for c in order], F.lit(1).alias("__cut"))
    x = samples.join(marks, [plan, *order], "left")
    x = span_scan(x, [plan], order, span, __n=("sum", F.coalesce(F.col("__cut"), F.lit(0))), __first=("row_number",))
    # a cut on the very first sample flushes nothing
    head = x.where("__first = 1").select(plan, F.coalesce("__cut", F.lit(0)).alias("__lead"))
    x = x.join(head, plan).withColumn("segment", (F.col("__n") - F.col("__lead")).cast("bigint"))
    return x.groupBy(plan, "segment").agg(F.min_by(time, F.struct(*order)).alias("start"), F.max(end).alias("end"),
                                          F.count("*").alias("samples"))


# --- transport --------------------------------------------------------------------------------------------------------

def continuity_errors(packets: DataFrame, pid: str, order: Sequence[str], counter: str, has_payload: Column,
                      discontinuity: Column, span: Column) -> DataFrame:
    """Packets whose 4-bit counter does not follow the one before on their pid."""
    p = packets.where(has_payload & (F.col(pid) != NULL_PID)).withColumn("__d", discontinuity)
    x = span_scan(p, [pid], order, span, previous=("lag", F.col(counter)))
    expected = (F.col("previous") + 1) % 16
    return x.where(~F.col("__d") & F.col("previous").isNotNull() & (F.col(counter) != expected)).withColumn(
        "expected", expected).drop("__d")


def unwrap_clock(rows: DataFrame, key: str, order: Sequence[str], raw: str, span: Column) -> DataFrame:
    """Add ``unwrapped``: a jump of more than half the range moves the epoch by one."""
    x = span_scan(rows, [key], order, span, __p=("lag", F.col(raw)))
    d = F.col(raw) - F.col("__p")
    x = x.withColumn("__step", F.when(d < -(WRAP // 2), 1).when(d > WRAP // 2, -1).otherwise(0).cast("bigint"))
    x = span_scan(x, [key], order, span, __epoch=("sum", F.col("__step")))
    return x.withColumn("unwrapped", F.col(raw) + F.col("__epoch") * F.lit(WRAP)).drop("__p", "__step", "__epoch")


def backfill_durations(chunks: DataFrame, track: str, order: Sequence[str], time: str, duration: str, span: Column) -> DataFrame:
    """Missing or zero durations become the distance to the next chunk of the track, at least 0."""
    x = span_scan(chunks, [track], order, span, __n=("lead", F.col(time)))
    d = F.col(duration)
    filled = F.when((d.isNull() | (d == 0)) & F.col("__n").isNotNull(),
                    F.greatest(F.lit(0), F.col("__n") - F.col(time))).otherwise(d)
    return x.withColumn(duration, filled).drop("__n")
