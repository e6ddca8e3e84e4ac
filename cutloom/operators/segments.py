"""Adaptive streams: playlists, periods, segment timelines, windows, variants, throughput."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .evaluation import explode_range
from .fold import affine_scan, ordered_fold
from .intervals import level_join
from .scan import asof, span_of, span_scan


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration PnDTnHnMnS; null when malformed."""
    pattern = r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i, k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double"), F.lit(0.0)) * k
    return F.when(text.rlike(pattern), part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1))


def attributes(value: Column) -> Column:
    """Map of a playlist attribute list: NAME=VALUE pairs, values optionally quoted."""
    pairs = F.regexp_extract_all(value, F.lit(r'([A-Z0-9-]+=(?:"[^"]*"|[^,]*))'), F.lit(1))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^([A-Z0-9-]+)=", 1).alias("k"),
                               F.regexp_replace(F.regexp_replace(p, r"^[A-Z0-9-]+=", ""), r'^"|"$', "").alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def _lines(text: str = "text") -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, "^﻿", ""), r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")


def _playlists(texts: DataFrame) -> DataFrame:
    return texts.where(F.ltrim(F.regexp_replace("text", "^﻿", "")).startswith("#EXTM3U"))


def playlist_lines(texts: DataFrame) -> DataFrame:
    """(playlist_id, line_no, line): one text is one row already, so its lines are bounded by that row."""
    return _playlists(texts).select("playlist_id", F.posexplode(_lines()).alias("line_no", "line"))


def tagged(line: Column, name: str) -> Column:
    return (line == name) | line.startswith(name + ":")


def tag_values(lines: Column | str, name: str) -> Column:
    """Values of the lines with a tag, in order."""
    return F.transform(F.filter(lines, lambda l: tagged(l, name)), lambda l: F.regexp_replace(l, r"^#[^:]+:?", ""))


def last_of(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def playlist_blocks(texts: DataFrame) -> DataFrame:
    """(playlist_id, no, lines, segment): the lines up to and with each segment url, cut inside the row of the text.

    ``no`` is the number of segments before; lines after the last url are a block that is no segment. A stream url follows its own tag line
    and is no segment. What is read from lines is read per block, so that later windows sort a narrow row per segment, not every line.
    """
    def cut(lines: Column, ends: Column) -> Column:
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
        block = lambda at, size, segment: F.struct(F.slice(lines, at + 1, size).alias("lines"), F.lit(segment).alias("segment"))
        urls = F.transform(ends, lambda e, k: block(start(k), e - start(k) + 1, True))
        return F.concat(urls, F.array(block(start(F.size(ends)), F.size(lines), False)))

    def blocks(lines: Column) -> Column:
        stream = lambda i: (i > 0) & tagged(F.get(lines, i - 1), "#EXT-X-STREAM-INF")
        every = F.transform(lines, lambda l, i: F.when(~l.startswith("#") & ~stream(i), i))
        return _bind(F.filter(every, lambda i: i.isNotNull()), lambda ends: cut(lines, ends))

    x = _playlists(texts).select("playlist_id", _bind(_lines(), blocks).alias("blocks"))
    return x.select("playlist_id", F.posexplode("blocks").alias("no", "b")).select("playlist_id", F.col("no").cast("bigint").alias("no"), "b.lines", "b.segment")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def playlist_segments(texts: DataFrame) -> DataFrame:
    """Segments of playlists: sequence, url, start, duration, title, byte range, map, discontinuity.

    A tag belongs to the next url line and is read from its block; map lines carry forward and byte ranges without an offset continue the
    range before them, by windows over the segments of one playlist.
    """
    own = lambda name: last_of(tag_values("lines", name))
    s = playlist_blocks(texts).where("segment").select(
        "playlist_id", "no", last_of(F.col("lines")).alias("line"), own("#EXTINF").alias("inf"), own("#EXT-X-BYTERANGE").alias("range"),
        own("#EXT-X-MAP").alias("map"), own("#EXT-X-MEDIA-SEQUENCE").alias("first"),
        F.when(F.exists("lines", lambda l: l.startswith("#")), F.exists("lines", lambda l: tagged(l, "#EXT-X-DISCONTINUITY"))).alias("disc"))
    ws = W.partitionBy("playlist_id").orderBy("no")
    past, upto = ws.rowsBetween(W.unboundedPreceding, -1), ws.rowsBetween(W.unboundedPreceding, 0)
    duration = F.greatest(F.lit(0.0), F.coalesce(F.regexp_extract("inf", r"^([0-9.]+)", 1).cast("double"), F.lit(0.0)))
    length = F.regexp_extract("range", r"^(\d+)", 1)
    offset = F.regexp_extract("range", r"@(\d+)", 1)
    s = s.withColumn("duration", duration).withColumn("length", F.when(length != "", length.cast("bigint"))).withColumn(
        "explicit", F.when(offset != "", offset.cast("bigint")))
    # offsets: last explicit one plus the lengths since then
    s = s.withColumn("__cum", F.coalesce(F.sum("length").over(past), F.lit(0))).withColumn("map", F.last("map", True).over(upto)).withColumn(
        "first", F.coalesce(F.last("first", True).over(upto).cast("bigint"), F.lit(0)))
    base = F.last(F.when(F.col("explicit").isNotNull(), F.struct(F.col("explicit").alias("o"), F.col("__cum").alias("c"))), True).over(upto)
    s = s.withColumn("__base", base)
    return s.select(
        "playlist_id", (F.col("first") + F.col("no")).alias("sequence"), F.col("line").alias("url"),
        F.coalesce(F.sum("duration").over(past), F.lit(0.0)).alias("start"), "duration",
        F.regexp_extract("inf", r"^[^,]*,(.*)$", 1).alias("title"),
        F.when(F.col("length").isNotNull(), F.coalesce(F.col("__base.o") + F.col("__cum") - F.col("__base.c"), F.col("__cum"))).alias("range_offset"),
        F.col("length").alias("range_length"), attributes(F.col("map"))["URI"].alias("map_uri"), F.col("disc").alias("discontinuity"))


def playlist_variants(texts: DataFrame) -> DataFrame:
    """Variant streams of master playlists: url, bandwidth, width, height, codecs."""
    x = playlist_lines(texts)
    w = W.partitionBy("playlist_id").orderBy("line_no")
    v = x.withColumn("__p", F.lag("line").over(w)).where(~F.col("line").startswith("#") & F.col("__p").startswith("#EXT-X-STREAM-INF:"))
    a = attributes(F.regexp_replace("__p", r"^[^:]+:", ""))
    return v.withColumn("a", a).select("playlist_id", F.col("line").alias("url"), F.try_element_at("a", F.lit("BANDWIDTH")).cast("bigint").alias("bandwidth"),
                                       F.regexp_extract(F.try_element_at("a", F.lit("RESOLUTION")), r"^(\d+)x", 1).try_cast("int").alias("width"),
                                       F.regexp_extract(F.try_element_at("a", F.lit("RESOLUTION")), r"x(\d+)$", 1).try_cast("int").alias("height"),
                                       F.try_element_at("a", F.lit("CODECS")).alias("codecs"))


# --- periods and timelines ------------------------------------------------------------------------------------------------

def period_windows(periods: DataFrame, key: str, index: str, span: Column) -> DataFrame:
    """Add start, duration, end to (key, index, explicit_start, declared, total).

    A start is explicit or follows the last explicit start by the declared durations since; a duration is declared,
    or runs to the next explicit start, or for the last period to the total.
    """
    known = F.coalesce("declared", F.lit(0.0))
    x = span_scan(periods, [key], [index], span, __sum=("sum_before", known), __next=("lead", F.struct("explicit_start")), __n=("row_number",))
    anchor = F.when(F.col("explicit_start").isNotNull(), F.struct(F.col("explicit_start").alias("s"), F.col("__sum").alias("c")))
    x = span_scan(x.withColumn("__a", anchor), [key], [index], span, __base=("upto", F.col("__a")))
    start = F.coalesce("explicit_start", F.col("__base.s") + F.col("__sum") - F.col("__base.c"), F.col("__sum"))
    x = x.withColumn("start", start)
    last = F.col("__next").isNull()
    dur = F.coalesce("declared", F.greatest(F.col("__next.explicit_start") - F.col("start"), F.when(F.col("__next.explicit_start").isNotNull(), 0.0)),
                     F.when(last & F.col("total").isNotNull(), F.greatest(F.lit(0.0), F.col("total") - F.col("start"))))
    return x.withColumn("duration", dur).withColumn("end", F.col("start") + F.col("duration")).drop("__sum", "__next", "__n", "__a", "__base")


def expand_timeline(runs: DataFrame, key: str, order: Sequence[str], span: Column) -> DataFrame:
    """Runs (key, order.., t, d, r, period_units) to one row per segment: number from 0, time, duration.

    ``t`` sets the clock when given, otherwise runs follow each other; a negative ``r`` repeats to the period end.
    """
    r = F.when(F.col("r") < 0, F.when(F.col("period_units").isNull(), 0).otherwise(
        F.greatest(F.lit(0), F.ceil(F.col("period_units") / F.col("d")) - 1))).otherwise(F.col("r"))
    x = runs.where("d > 0").withColumn("__count", (r + 1).cast("bigint"))
    x = span_scan(x, [key], order, span, __before=("sum_before", F.col("__count") * F.col("d")), __rank=("sum_before", F.col("__count")))
    anchor = F.when(F.col("t").isNotNull(), F.struct(F.col("t").alias("t"), F.col("__before").alias("c")))
    x = span_scan(x.withColumn("__a", anchor), [key], order, span, __base=("upto", F.col("__a")))
    first = F.coalesce(F.col("__base.t") + F.col("__before") - F.col("__base.c"), F.col("__before"))
    x = explode_range(x.withColumn("__first", first), F.lit(0), F.col("__count"), "__i")
    return x.select(key, (F.col("__rank") + F.col("__i")).alias("number"), (F.col("__first") + F.col("__i") * F.col("d")).alias("time"), F.col("d").alias("duration"))


def template_segments(templates: DataFrame, presentation_now: Column | None = None, depth: float = 30.0,
                      unknown_count: int = 12) -> DataFrame:
    """Fixed-length segments of (key, period_start, period_duration, units, timescale, start_number, footage, bandwidth).

    With a live clock only the window of ``depth`` seconds before it is listed. A period of unknown duration lists
    ``unknown_count`` segments.
    """
    dur = F.col("units") / F.greatest(F.lit(1.0), F.col("timescale"))
    x = templates.where("units > 0").withColumn("duration", dur)
    count = F.when(F.col("period_duration").isNull(), unknown_count).otherwise(F.ceil(F.col("period_duration") / F.col("duration")))
    first = F.lit(0)
    if presentation_now is not None:
        local = F.greatest(F.lit(0.0), presentation_now - F.col("period_start"))
        first = F.floor(F.greatest(F.lit(0.0), local - depth) / F.col("duration"))
        count = F.greatest(first, F.floor(local / F.col("duration"))) - first + 1
    x = explode_range(x.withColumn("__first", first.cast("bigint")).withColumn("__n", count.cast("bigint")), F.col("__first"), F.col("__first") + F.col("__n"), "index")
    x = x.withColumn("sequence", F.col("start_number") + F.col("index")).withColumn("time", (F.col("index") * F.col("units")).cast("bigint"))
    return x.withColumn("start", F.col("period_start") + F.col("time") / F.greatest(F.lit(1.0), F.col("timescale"))).withColumn(
        "url", fill_template(F.col("footage"), F.col("key"), F.col("bandwidth"), F.col("sequence"), F.col("time"))).drop("__first", "__n")


def fill_template(text: Column, rep: Column, bandwidth: Column, number: Column, time: Column) -> Column:
    """Replace $Name$ and $Name%0Nd$ placeholders; $$ is a plain dollar."""
    out = F.replace(text, F.lit("$$"), F.lit("\x01"))
    for name, col in (("RepresentationID", rep), ("Bandwidth", bandwidth), ("Number", number), ("Time", time)):
        value = F.coalesce(col.cast("string"), F.lit(""))
        width = F.regexp_extract(out, rf"\${name}%0(\d+)d\$", 1)
        padded = F.when(width == "", value).otherwise(F.lpad(value, F.greatest(F.length(value), width.try_cast("int")), F.lit("0")))
        out = F.regexp_replace(out, F.lit(rf"\${name}(?:%0\d+d)?\$"), padded)
    return F.replace(out, F.lit("\x01"), F.lit("$"))


def event_times(events: DataFrame, periods: DataFrame, period: str) -> DataFrame:
    """Period-relative event ticks to absolute seconds."""
    scale = F.greatest(F.lit(1.0), F.col("timescale"))
    return events.join(periods.select(period, F.col("start").alias("__s")), period).withColumn(
        "time", F.col("__s") + F.col("presentation_time") / scale).withColumn("seconds", F.col("event_duration") / scale).drop("__s")


def merge_window(old: DataFrame, new: DataFrame, streams: DataFrame) -> DataFrame:
    """Upsert segments (stream_id, sequence, partial, url, ..) and drop what is below the first sequence (stream_id, first_sequence)."""
    key = ["stream_id", "sequence", "partial", "url"]
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    latest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), "__v").alias("x")).select(*key, "x.*")
    return latest.join(streams, "stream_id").where(F.col("sequence") >= F.greatest(F.lit(0), F.col("first_sequence"))).select(*old.columns)


def live_edges(segments: DataFrame, streams: DataFrame) -> DataFrame:
    """Live edge and recommended position per stream (part_hold_back, hold_back, suggested_delay, target_duration)."""
    e = segments.groupBy("stream_id").agg(F.max(F.col("start") + F.col("duration")).alias("__e"))
    hold = F.coalesce("part_hold_back", "hold_back", "suggested_delay", F.coalesce("target_duration", F.lit(2.0)) * 3)
    return streams.join(e, "stream_id", "left").select(
        "stream_id", F.greatest(F.lit(0.0), F.coalesce("__e", F.lit(0.0))).alias("edge"), hold.alias("hold")).withColumn(
        "position", F.greatest(F.lit(0.0), F.col("edge") - F.greatest(F.lit(0.0), F.col("hold"))))


def next_requests(segments: DataFrame, cursors: DataFrame, limit: int = 3) -> DataFrame:
    """Next segments per cursor (stream_id, after_sequence, playhead ..), each cursor ranked for itself; pruned map-side."""
    x = segments.join(cursors, "stream_id")
    after = F.col("after_sequence")
    ok = F.when(after.isNull(), F.col("start") + F.col("duration") > F.col("playhead")).otherwise(
        (F.col("sequence") > after) | (F.col("partial") & (F.col("sequence") >= after)))
    w = W.partitionBy(*cursors.columns).orderBy("start", F.col("partial").cast("int"), "sequence", "url")
    return x.where(ok).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).withColumn("turn", F.col("turn").cast("bigint"))


def active_periods(periods: DataFrame, probes: DataFrame, width: float = 3600.0) -> DataFrame:
    """Probes (stream_id, probe) with the period that covers them, else the last period of the stream."""
    p = periods.withColumn("__end", F.coalesce("end", F.lit(1e300)))
    closed = level_join(probes, p.where(F.col("end").isNotNull()), ["stream_id"], "probe", "start", "__end", width)
    open_ = probes.join(p.where(F.col("end").isNull()), "stream_id").where(F.col("probe") >= F.col("start"))
    hit = closed.unionByName(open_.select(*closed.columns)).groupBy("stream_id", "probe").agg(F.min("period_index").alias("__hit"))
    last = periods.groupBy("stream_id").agg(F.max("period_index").alias("__last"))
    return probes.join(hit, ["stream_id", "probe"], "left").join(last, "stream_id", "left").select(
        *probes.columns, F.coalesce("__hit", "__last").alias("period_index"))


def expand_references(refs: DataFrame) -> DataFrame:
    """Leaf references (root_id, path, ..) of hierarchical indexes, in order.

    Refs: index_id, ref_no, child_index (null for a leaf), duration, size. One join per level, to the last one. An index that
    contains itself is never below a root without being met twice on one path: such a path raises.
    """
    from ..session import durable
    children = refs.select("index_id").distinct()
    roots = children.join(refs.where("child_index is not null").select(F.col("child_index").alias("index_id")).distinct(), "index_id", "left_anti")
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    at = roots.select(F.col("index_id").alias("root_id"), "index_id", F.lit("").alias("path"), F.array("index_id").alias("seen"))
    footage = None
    while True:
        x = durable(at.join(refs, "index_id").withColumn("path", F.concat("path", pad(F.col("ref_no")), F.lit("/"))))
        leaf = x.where("child_index is null").select("root_id", "path", "duration", "size")
        footage = leaf if footage is None else footage.unionByName(leaf)
        at = x.where("child_index is not null")
        if at.isEmpty():
            return footage
        if not at.where(F.array_contains("seen", F.col("child_index"))).isEmpty():
            raise ValueError("an index contains itself")
        at = at.select("root_id", F.col("child_index").alias("index_id"), "path", F.array_append("seen", F.col("child_index")).alias("seen"))


# --- throughput and variants ----------------------------------------------------------------------------------------------

SAFETY, UPGRADE_MARGIN = 0.82, 1.15  # fixed values


def throughput(downloads: DataFrame, session: str, order: Sequence[str], span: Column, fast_half_life: float = 3.0,
               slow_half_life: float = 10.0, initial: float = 5_000_000.0) -> DataFrame:
    """Add fast and slow moving averages of the bit rate and ``estimate``, the smaller of the two."""
    bps = F.greatest(F.lit(1.0), F.col("bytes") * 8 / F.greatest(F.lit(0.001), F.col("seconds")))
    alpha = lambda h: 1 - math.pow(0.5, 1 / h)
    fast, slow = max(0.1, fast_half_life), max(max(0.1, fast_half_life), slow_half_life)
    x = affine_scan(downloads, [session], order, span,
                    fast_bps=(F.lit(1 - alpha(fast)), bps * alpha(fast), initial), slow_bps=(F.lit(1 - alpha(slow)), bps * alpha(slow), initial))
    return x.withColumn("estimate", F.least("fast_bps", "slow_bps"))


def choose_variants(requests: DataFrame, variants: DataFrame, safety: float = SAFETY, max_width: float = 1e9, max_height: float = 1e9) -> DataFrame:
    """Best affordable variant per request (manifest_id, request_id, bandwidth), else the lowest one.

    Affordable means bit rate <= bandwidth * safety: an as-of lookup of the budget on the bit-rate ladder.
    """
    v = variants.where((F.coalesce("width", F.lit(0)) <= max_width) & (F.coalesce("height", F.lit(0)) <= max_height)).select(
        "manifest_id", F.coalesce("bitrate", F.lit(0)).cast("double").alias("time"), "variant_id",
        F.concat(F.lpad((F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))).cast("bigint").cast("string"), 15, "0"), F.col("variant_id").cast("string")).alias("__tie"))
    q = requests.withColumn("__budget", F.greatest(F.lit(1.0), F.col("bandwidth")) * max(0.1, min(1.0, safety)))
    a = asof(v, q, ["manifest_id"], "time", "__budget", ["variant_id"], "__tie", 1e6, strict=False)
    pick = F.coalesce("left", "right")
    return a.select(*requests.columns, pick["variant_id"].alias("variant_id"), pick["time"].alias("bitrate"))


def hold_upgrades(choices: DataFrame, session: str, order: Sequence[str], margin: float = UPGRADE_MARGIN) -> DataFrame:
    """Add ``kept``: the variant after hysteresis; an upgrade needs bandwidth of ``margin`` times its bit rate."""
    def step(state, values):
        variant, bitrate, bandwidth = values
        if state is not None and bitrate > state[1] and bandwidth < bitrate * margin:
            return state, (state[0],)
        return (variant, bitrate), (variant,)

    kind = dict(choices.dtypes)["variant_id"]
    return ordered_fold(choices, [session], order, lambda: None, step, ["variant_id", "bitrate", "bandwidth"], f"kept {kind}")


def session_counters(downloads: DataFrame, session: str, order: Sequence[str], span: Column) -> DataFrame:
    """Running downloads, buffered-until, last sequence and discontinuities."""
    d = F.when(F.col("discontinuity"), 1).otherwise(0).cast("bigint")
    return span_scan(downloads, [session], order, span, downloads=("row_number",), buffered_until=("max", F.col("start") + F.col("duration")),
                     last_sequence=("upto", F.col("sequence")), discontinuities=("sum", d))


def fidelity(frames: DataFrame, session: str, order: Sequence[str], span: Column, fps: float = 30.0, utilization: float = 0.72,
             alpha: float = 0.2, max_temporal: int = 8, max_vector: int = 4, min_scale: float = 0.5) -> DataFrame:
    """Render-time and stale-pressure averages after each frame and the quality plan they lead to."""
    x = span_scan(frames, [session], order, span, __n=("row_number",))
    first = F.col("__n") == 1
    ms = F.greatest(F.lit(0.0), F.col("duration_ms"))
    x = affine_scan(x, [session], order, span, render_ms=(F.when(first, 0.0).otherwise(1 - alpha), F.when(first, ms).otherwise(ms * alpha), 0.0),
                    stale_pressure=(F.lit(1 - alpha), F.col("stale").cast("double") * alpha, 0.0))
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    budget = 1000 / max(1.0, fps) * utilization
    quality = clamp(F.lit(budget) / F.greatest(F.lit(0.1), F.col("render_ms")), 0.2, 2.0) * clamp(1 - F.col("stale_pressure"), 0.25, 1.0)
    x = x.withColumn("__q", quality)
    return x.withColumn("temporal", clamp(F.floor(F.round(max_temporal * F.col("__q"), 9)).cast("int"), 1, max_temporal)).withColumn(
        "vector", clamp(F.round(max_vector * F.sqrt("__q")).cast("int"), 1, max_vector)).withColumn(
        "scale", clamp(F.sqrt(F.greatest(F.lit(0.05), F.col("__q"))), min_scale, 1.0)).drop("__q", "__n")
