"""What else playlists say: keys, date-times and gaps of segments, parts, renditions, headers, and delta updates.

A text is one row: its lines are cut into blocks of one segment inside the row, then windows run over segments or parts of a playlist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scan import asof
from .segments import attributes, last_of, playlist_blocks, playlist_lines, tag_values, tagged

# Tags.
INF, KEY, GAP, DATE_TIME, SKIP, PART = "#EXTINF", "#EXT-X-KEY", "#EXT-X-GAP", "#EXT-X-PROGRAM-DATE-TIME", "#EXT-X-SKIP", "#EXT-X-PART"
SEQUENCE, MEDIA, STREAM = "#EXT-X-MEDIA-SEQUENCE", "#EXT-X-MEDIA", "#EXT-X-STREAM-INF"


def _of(a: str | Column, name: str) -> Column:
    return F.try_element_at(F.col(a) if isinstance(a, str) else a, F.lit(name))


def _yes(a: str | Column, name: str) -> Column:
    return F.coalesce(F.upper(_of(a, name)) == "YES", F.lit(False))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _sequences(lines: Column | str) -> Column:
    """The last media sequence in lines that is a number."""
    return last_of(F.filter(F.transform(tag_values(lines, SEQUENCE), lambda v: v.try_cast("bigint")), lambda v: v.isNotNull()))


def _skips(lines: Column | str) -> Column:
    """The segments that the last skip line stands for; null without such a line."""
    value = last_of(tag_values(lines, SKIP))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.coalesce(_of(attributes(value), "SKIPPED-SEGMENTS").try_cast("bigint"), F.lit(0))))


def _seconds(inf: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(_number(F.regexp_extract(inf, r"^([^,]*)", 1)), F.lit(0.0)))


def playlist_media(texts: DataFrame) -> DataFrame:
    """(playlist_id, sequence, url, duration, key_method, key_uri, key_iv, key_format, date_time, gap) of every listed segment.

    A key holds from its line on, date-time and gap lines belong to the next segment. Segments that a skip line stands for are not listed
    and count in the sequence of those after it; ``fill_deltas`` gives them back.
    """
    own = lambda name: last_of(tag_values("lines", name))
    x = playlist_blocks(texts).where("segment").select(
        "playlist_id", "no", last_of(F.col("lines")).alias("url"), _seconds(own(INF)).alias("duration"), own(KEY).alias("key"), own(DATE_TIME).alias("date_time"),
        F.exists("lines", lambda l: tagged(l, GAP)).alias("gap"), _sequences("lines").alias("first"), _skips("lines").alias("skipped"))
    upto = W.partitionBy("playlist_id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    carried = lambda c: F.last(c, True).over(upto)
    x = x.withColumn("sequence", F.coalesce(carried("first"), F.lit(0)) + F.coalesce(carried("skipped"), F.lit(0)) + F.col("no"))
    x = x.withColumn("__key", attributes(carried("key")))
    held = F.col("__key").isNotNull()
    return x.select(
        "playlist_id", "sequence", "url", "duration",
        F.when(held, F.coalesce(_of("__key", "METHOD"), F.lit("NONE"))).alias("key_method"), _of("__key", "URI").alias("key_uri"),
        _of("__key", "IV").alias("key_iv"), F.when(held, F.coalesce(_of("__key", "KEYFORMAT"), F.lit("identity"))).alias("key_format"), "date_time", "gap")


def playlist_parts(texts: DataFrame) -> DataFrame:
    """(playlist_id, sequence, part_no, url, start, duration, independent, gap): parts of segments, numbered over the playlist.

    The first part starts where the segments before it end, every other one where the part before it ends.
    """
    before = lambda i: F.slice("lines", 1, i + 1)
    # a part sees sequence and skip lines of its block only if they come before it
    sets = F.exists("lines", lambda l: tagged(l, SEQUENCE) | tagged(l, SKIP))
    part = lambda l, i: F.when(tagged(l, PART), F.struct(
        F.regexp_replace(l, r"^#[^:]+:?", "").alias("value"), F.when(F.col("sets"), _sequences(before(i))).alias("first"), F.when(F.col("sets"), _skips(before(i))).alias("skipped")))
    x = playlist_blocks(texts).withColumn("sets", sets).select(
        "playlist_id", "no", F.filter(F.transform("lines", part), lambda p: p.isNotNull()).alias("parts"), _sequences("lines").alias("first"), _skips("lines").alias("skipped"),
        F.when(F.col("segment"), _seconds(last_of(tag_values("lines", INF)))).alias("__d"))
    past = W.partitionBy("playlist_id").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    x = x.select("playlist_id", "no", "parts", F.last("first", True).over(past).alias("first"), F.last("skipped", True).over(past).alias("skipped"),
                 F.coalesce(F.sum("__d").over(past), F.lit(0.0)).alias("__end"))
    p = x.select("playlist_id", "no", "first", "skipped", "__end", F.posexplode("parts").alias("at", "p")).withColumn("a", attributes(F.col("p.value")))
    p = p.select("playlist_id", "no", "at", "__end", (F.coalesce("p.first", "first", F.lit(0)) + F.coalesce("p.skipped", "skipped", F.lit(0)) + F.col("no")).alias("sequence"),
                 _of("a", "URI").alias("url"), F.coalesce(_number(_of("a", "DURATION")), F.lit(0.0)).alias("duration"), _yes("a", "INDEPENDENT").alias("independent"), _yes("a", "GAP").alias("gap"))
    w = W.partitionBy("playlist_id").orderBy("no", "at")
    start = F.first("__end").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("duration").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return p.select("playlist_id", "sequence", (F.row_number().over(w) - 1).cast("bigint").alias("part_no"), "url", start.alias("start"), "duration", "independent", "gap")


def playlist_renditions(texts: DataFrame) -> DataFrame:
    """(playlist_id, line_no, type, group_id, name, language, is_default, autoselect, forced, channels, uri); read line by line, no exchange."""
    x = playlist_lines(texts).where(F.col("line").startswith(MEDIA + ":")).withColumn("a", attributes(F.regexp_replace("line", r"^[^:]+:", "")))
    plain = {"type": "TYPE", "group_id": "GROUP-ID", "name": "NAME", "language": "LANGUAGE"}
    flags = {"is_default": "DEFAULT", "autoselect": "AUTOSELECT", "forced": "FORCED"}
    return x.select("playlist_id", "line_no", *(_of("a", v).alias(k) for k, v in plain.items()), *(_yes("a", v).alias(k) for k, v in flags.items()),
                    _of("a", "CHANNELS").alias("channels"), _of("a", "URI").alias("uri"))


def playlist_headers(texts: DataFrame) -> DataFrame:
    """One row per playlist: (playlist_id, version, media_sequence, skipped, target_duration, part_target, playlist_type, end_list,
    discontinuity_sequence, can_skip_until, hold_back, start_offset); the last line of a tag wins."""
    x = playlist_lines(texts).where(F.col("line").startswith("#"))
    x = x.select("playlist_id", "line_no", F.regexp_extract("line", r"^(#[^:]+)", 1).alias("tag"), F.regexp_replace("line", r"^#[^:]+:?", "").alias("value"))
    last = lambda tag: F.max_by(F.when(F.col("tag") == tag, F.col("value")), F.when(F.col("tag") == tag, F.col("line_no")))
    tags = {"version": "#EXT-X-VERSION", "media_sequence": SEQUENCE, "skip": SKIP, "target_duration": "#EXT-X-TARGETDURATION", "part": "#EXT-X-PART-INF",
            "playlist_type": "#EXT-X-PLAYLIST-TYPE", "discontinuity_sequence": "#EXT-X-DISCONTINUITY-SEQUENCE", "control": "#EXT-X-SERVER-CONTROL", "start": "#EXT-X-START"}
    h = x.groupBy("playlist_id").agg(*(last(t).alias(n) for n, t in tags.items()), F.max(F.col("tag") == "#EXT-X-ENDLIST").alias("end_list"))
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    inside = lambda c, name: _of(attributes(F.col(c)), name)
    return h.select("playlist_id", F.col("version").try_cast("int").alias("version"), whole("media_sequence").alias("media_sequence"),
                    F.greatest(F.lit(0), F.coalesce(inside("skip", "SKIPPED-SEGMENTS").try_cast("bigint"), F.lit(0))).alias("skipped"),
                    _number(F.col("target_duration")).alias("target_duration"), _number(inside("part", "PART-TARGET")).alias("part_target"),
                    F.nullif("playlist_type", F.lit("")).alias("playlist_type"), F.coalesce("end_list", F.lit(False)).alias("end_list"),
                    whole("discontinuity_sequence").alias("discontinuity_sequence"), _number(inside("control", "CAN-SKIP-UNTIL")).alias("can_skip_until"),
                    _number(inside("control", "HOLD-BACK")).alias("hold_back"), _number(inside("start", "TIME-OFFSET")).alias("start_offset"))


def fill_deltas(media: DataFrame, headers: DataFrame, versions: DataFrame, span_width: float = 1 << 20) -> DataFrame:
    """All segments of every version of every stream: (stream_id, version_no, sequence, url, duration, filled_from).

    ``versions`` is (playlist_id, stream_id, version_no). A segment that a delta update skips is what the last earlier version that lists it
    says; ``filled_from`` is that version, null for listed segments. A skipped segment that no earlier version lists has no url. The look-up is an
    as-of join per (stream, sequence), so a chain of deltas is no chain of joins.
    """
    listed = media.join(versions, "playlist_id").select("stream_id", "version_no", "sequence", "url", "duration")
    missing = headers.where("skipped > 0").join(versions, "playlist_id").select("stream_id", "version_no", F.explode(
        F.sequence(F.col("media_sequence"), F.col("media_sequence") + F.col("skipped") - 1)).alias("sequence"))
    found = asof(listed, missing, ["stream_id", "sequence"], "version_no", "version_no", ["url", "duration"], "version_no", span_width)
    filled = found.select("stream_id", "version_no", "sequence", F.col("left.url").alias("url"), F.col("left.duration").alias("duration"),
                          F.col("left.time").alias("filled_from"))
    return listed.withColumn("filled_from", F.lit(None).cast(filled.schema["filled_from"].dataType)).unionByName(filled)
