"""Adaptive-stream, signal, ledger and dependency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as J, playlists as PL, retention, segments as S, signal as A
from ..operators.curves import normalize_curve
from ..operators.scan import span_of, span_scan
from .registry import query

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LW = "(partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def r6(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


# --- adaptive streams ---------------------------------------------------------------------------------------------------

def playlists_of(t):
    """One playlist per order; its lines are one segment per line item (an order has few)."""
    piece = F.concat_ws("\n", F.when(F.col("l_returnflag") == "R", F.lit("#EXT-X-DISCONTINUITY")), F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("int"), F.lit(",part "), "l_partkey"),
                        F.concat(F.lit("#EXT-X-BYTERANGE:"), F.col("l_suppkey") + 1, F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("@"), F.col("l_partkey") * 10)).otherwise("")),
                        F.concat(F.lit("seg-"), "l_partkey", F.lit(".ts")))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*LINE, piece.alias("piece")))), lambda x: x["piece"])
    p = t.lineitem.groupBy("l_orderkey").agg(F.array_join(body, "\n").alias("body"))
    return p.select(F.col("l_orderkey").alias("playlist_id"), F.concat(F.lit("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), F.col("l_orderkey") % 100,
                                                                     F.lit('\n#EXT-X-MAP:URI="init.mp4"\n'), "body").alias("text"))


@query("man01_playlists", f"""with s as (select l_orderkey, row_number() over w - 1 as n, cast(l_quantity as int)::double as d, l_partkey, l_suppkey+1 as len, case when l_linenumber%3=1 then l_partkey*10 end as ex, l_returnflag='R' as disc, l_linenumber, l_suppkey, l_extendedprice from lineitem window w as {_LW}),
  c as (select *, coalesce(sum(d) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding),0) as start, coalesce(sum(len) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding),0) as cum from s),
  b as (select *, last_value(case when ex is not null then ex-cum end ignore nulls) over (partition by l_orderkey order by n) as base from c)
  select l_orderkey as playlist_id, l_orderkey%100+n as sequence, 'seg-'||l_partkey||'.ts' as url, start, d as duration, 'part '||l_partkey as title, (cum+coalesce(base,0))::bigint as range_offset, len as range_length, 'init.mp4' as map_uri, disc as discontinuity from b""")
def man01(t):
    out = S.playlist_segments(playlists_of(t))
    return out.withColumn("discontinuity", F.coalesce("discontinuity", F.lit(False)))


@query("man01_variants", """select n_regionkey as playlist_id, 'v'||n_nationkey||'.m3u8' as url, (n_nationkey*100000)::bigint as bandwidth, n_nationkey*16 as width, n_nationkey*9 as height, 'avc1,mp4a' as codecs from nation""")
def man01v(t):
    piece = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("n_nationkey") * 100000, F.lit(",RESOLUTION="), F.col("n_nationkey") * 16, F.lit("x"), F.col("n_nationkey") * 9, F.lit(',CODECS="avc1,mp4a"\nv'), "n_nationkey", F.lit(".m3u8"))
    texts = t.nation.groupBy(F.col("n_regionkey").alias("playlist_id")).agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.collect_list(piece), "\n")).alias("text"))
    return S.playlist_variants(texts)


def keyed_playlists_of(t):
    """One playlist per order with keys that change, gaps, date-times and parts."""
    piece = F.concat_ws("\n", F.expr("case when l_linenumber%3=1 then case when l_suppkey%4=0 then '#EXT-X-KEY:METHOD=NONE' else concat('#EXT-X-KEY:METHOD=AES-128,URI=\"k', l_suppkey%5, ',x\",IV=0x', l_partkey) end end"),
                        F.expr("case when l_partkey%4=0 then concat('#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:', l_linenumber) end"), F.expr("case when l_returnflag='A' then '#EXT-X-GAP' end"),
                        F.expr("concat('#EXT-X-PART:DURATION=', l_linenumber, '.5,URI=\"p', l_partkey, '\"', case when l_linestatus='F' then ',INDEPENDENT=YES' else ',GAP=YES' end)"),
                        F.concat(F.lit("#EXTINF:"), F.col("l_quantity").cast("int"), F.lit(",t")), F.concat(F.lit("seg-"), "l_partkey"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*LINE, piece.alias("piece")))), lambda x: x["piece"])
    p = t.lineitem.groupBy("l_orderkey").agg(F.array_join(body, "\n").alias("body"))
    return p.select(F.col("l_orderkey").alias("playlist_id"), F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:9\n#EXT-X-MEDIA-SEQUENCE:"), F.col("l_orderkey") % 100, F.lit("\n#EXT-X-TARGETDURATION:50\n"), "body",
                                                                     F.when(F.col("l_orderkey") % 2 == 0, F.lit("\n#EXT-X-ENDLIST")).otherwise("")).alias("text"))


_KEYED = f"""s as (select *, row_number() over w - 1 as n, case when l_linenumber%3=1 then l_suppkey end as ks, case when l_linenumber%3=1 then l_partkey end as kp from lineitem window w as {_LW}),
  c as (select *, last_value(ks ignore nulls) over (partition by l_orderkey order by n) as k, last_value(kp ignore nulls) over (partition by l_orderkey order by n) as p from s)"""


@query("man01_keys", f"""with {_KEYED} select l_orderkey as playlist_id, l_orderkey%100+n as sequence, 'seg-'||l_partkey as url, cast(l_quantity as int)::double as duration, case when k is not null then case when k%4=0 then 'NONE' else 'AES-128' end end as key_method, case when k%4<>0 then 'k'||(k%5)||',x' end as key_uri,
  case when k%4<>0 then '0x'||p end as key_iv, case when k is not null then 'identity' end as key_format, case when l_partkey%4=0 then '2024-01-01T00:00:'||l_linenumber end as date_time, l_returnflag='A' as gap from c""")
def man01k(t):
    return PL.playlist_media(keyed_playlists_of(t))


@query("man01_parts", f"""with {_KEYED} select l_orderkey as playlist_id, l_orderkey%100+n as sequence, n as part_no, 'p'||l_partkey as url, coalesce(sum(l_linenumber+0.5::double) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding),0::double) as start, l_linenumber+0.5::double as duration, l_linestatus='F' as independent, l_linestatus<>'F' as gap from c""")
def man01p(t):
    return PL.playlist_parts(keyed_playlists_of(t))


@query("man01_headers", "select distinct l_orderkey as playlist_id, 9 as version, (l_orderkey%100)::bigint as media_sequence, 0::bigint as skipped, 50::double as target_duration, l_orderkey%2=0 as end_list from lineitem")
def man01h(t):
    return PL.playlist_headers(keyed_playlists_of(t)).select("playlist_id", "version", "media_sequence", "skipped", "target_duration", "end_list")


@query("man01_renditions", """select n_regionkey as playlist_id, case when n_nationkey%3=0 then 'SUBTITLES' else 'AUDIO' end as type, 'g'||(n_nationkey%2) as group_id, n_name||', main' as name, case when n_nationkey%4<>0 then lower(left(n_name,2)) end as language, n_nationkey%5=0 as is_default, n_nationkey%2=0 as autoselect, false as forced,
  case when n_nationkey%3<>0 then '2' end as channels, 'r'||n_nationkey||'.m3u8' as uri from nation""")
def man01r(t):
    line = F.expr("""concat('#EXT-X-MEDIA:TYPE=', case when n_nationkey%3=0 then 'SUBTITLES' else 'AUDIO' end, ',GROUP-ID="g', n_nationkey%2, '",NAME="', n_name, ', main"', case when n_nationkey%4<>0 then concat(',LANGUAGE="', lower(left(n_name,2)), '"') else '' end,
      ',DEFAULT=', case when n_nationkey%5=0 then 'YES' else 'NO' end, case when n_nationkey%2=0 then ',AUTOSELECT=yes' else '' end, case when n_nationkey%3<>0 then ',CHANNELS="2"' else '' end, ',URI="r', n_nationkey, '.m3u8"')""")
    texts = t.nation.groupBy(F.col("n_regionkey").alias("playlist_id")).agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return PL.playlist_renditions(texts).drop("line_no")


@query("man01_delta", """with v as (select user_id as stream_id, event_id, event_type, row_number() over (partition by user_id order by event_id)-1 as v from events), d as (select stream_id, v from v where event_type<>'error'),
  l as (select stream_id, v, unnest(range(v+case when v%2=1 then 3 else 0 end, v+6)) as sequence from d), m as (select stream_id, v, unnest(range(v, v+3)) as sequence from d where v%2=1),
  a as (select m.stream_id, m.v, m.sequence, max(l.v) as f from m left join l on l.stream_id=m.stream_id and l.sequence=m.sequence and l.v<m.v group by all)
  select stream_id, v as version_no, sequence, 'u'||sequence||'-v'||v as url, (sequence%7)::double as duration, null::bigint as filled_from from l
  union all select stream_id, v, sequence, case when f is not null then 'u'||sequence||'-v'||f end, case when f is not null then (sequence%7)::double end, f from a""")
def man01d(t):
    """Versions of live playlists, every other one a delta update; some never arrived."""
    v = span_scan(t.events, ["user_id"], ["event_id"], span_of("event_id", 1 << 20), __v=("row_number",)).where("event_type <> 'error'").selectExpr("event_id as playlist_id", "user_id as stream_id", "__v-1 as version_no")
    texts = v.selectExpr("playlist_id", """concat('#EXTM3U\\n#EXT-X-MEDIA-SEQUENCE:', version_no, case when version_no%2=1 then '\\n#EXT-X-SKIP:SKIPPED-SEGMENTS=3' else '' end, '\\n',
      array_join(transform(sequence(version_no + case when version_no%2=1 then 3 else 0 end, version_no+5), s -> concat('#EXTINF:', s%7, ',\\nu', s, '-v', version_no)), '\\n')) as text""")
    return PL.fill_deltas(PL.playlist_media(texts), PL.playlist_headers(texts), v)


@query("man01_iso_durations", "select p_partkey, (p_size%3)*86400.0::double+(p_size%24)*3600+(p_partkey%60)*60+(p_partkey%10)*0.5::double as seconds from part")
def man01i(t):
    text = F.concat(F.lit("P"), F.col("p_size") % 3, F.lit("DT"), F.col("p_size") % 24, F.lit("H"), F.col("p_partkey") % 60, F.lit("M"), F.format_string("%.1f", F.col("p_partkey") % 10 * 0.5), F.lit("S"))
    return t.part.select("p_partkey", S.iso_seconds(text).alias("seconds"))


def periods_of(t):
    """Periods per customer: their orders in key order; some starts and durations are declared."""
    from ..operators.scan import span_scan
    o = t.orders.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("period_index"),
                        F.expr("case when o_orderkey%4=0 then cast(o_orderkey as double) end as explicit_start"), F.expr("case when o_orderkey%3<>0 then cast(o_orderkey%50+1 as double) end as declared"))
    return S.period_windows(o.withColumn("total", F.lit(200000.0)), "stream_id", "period_index", span_of("period_index", 1 << 20))


_PER = """o as (select o_custkey as stream_id, o_orderkey as period_index, case when o_orderkey%4=0 then o_orderkey::double end as ex, case when o_orderkey%3<>0 then (o_orderkey%50+1)::double end as de from orders),
  a as (select *, coalesce(sum(coalesce(de,0)) over (partition by stream_id order by period_index rows between unbounded preceding and 1 preceding),0) as c, lead(ex) over (partition by stream_id order by period_index) as nx, lead(period_index) over (partition by stream_id order by period_index) as ni from o),
  b as (select *, last_value(case when ex is not null then ex-c end ignore nulls) over (partition by stream_id order by period_index) as base from a), st as (select *, coalesce(ex, c+base, c) as start from b),
  per as (select *, coalesce(de, case when nx is not null then greatest(0, nx-start) end, case when ni is null then greatest(0, 200000-start) end) as duration from st)"""


@query("man02_periods", f"with {_PER} select stream_id, period_index, start, duration, start+duration as fin from per")
def man02(t):
    return periods_of(t).select("stream_id", "period_index", "start", "duration", F.col("end").alias("fin"))


@query("man03_timeline", f"""with r as (select l_orderkey, row_number() over w as n, case when l_linenumber%4=0 then l_partkey*100 end as t, cast(l_quantity as bigint) as d, case when l_linenumber=7 then greatest(0, ceil(500/l_quantity)-1)::bigint else (l_linenumber%3)::bigint end as r from lineitem window w as {_LW}),
  c as (select *, coalesce(sum((r+1)*d) over w,0)-(r+1)*d as before, sum(r+1) over w-(r+1) as rk from r window w as (partition by l_orderkey order by n)), b as (select *, last_value(case when t is not null then t-before end ignore nulls) over (partition by l_orderkey order by n) as base from c)
  select l_orderkey as stream_id, (rk+i)::bigint as number, (before+coalesce(base,0)+i*d)::bigint as time, d as duration from b, lateral (select unnest(generate_series(0, r)) as i)""")
def man03(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("stream_id"), *LINE, F.expr("case when l_linenumber%4=0 then l_partkey*100 end as t"), F.col("l_quantity").cast("bigint").alias("d"),
                          F.expr("if(l_linenumber=7, -1, l_linenumber%3) as r"), F.lit(500).alias("period_units"))
    return S.expand_timeline(r, "stream_id", LINE, span_of("l_linenumber", 1 << 16))


@query("man04_template", """with p as (select p_partkey, p_size%5*10.0::double as ps, case when p_size%4>0 then p_size%7*2.5::double end as pd, (p_size%6)*1000 as units from part where p_size%6>0),
  s as (select *, units/1000.0::double as dur from p)
  select 'r'||p_partkey as key, (5+i)::bigint as sequence, (i*units)::bigint as time, round(ps+i*units/1000.0::double,6) as start, 'm/r'||p_partkey||'/'||lpad((5+i)::varchar,4,'0')||'-'||(i*units)||'-$.m4s' as url from s, lateral (select unnest(generate_series(0, coalesce(ceil(pd/dur),12)::bigint-1)) as i)""")
def man04(t):
    p = t.part.select(F.concat(F.lit("r"), "p_partkey").alias("key"), F.expr("p_size%5*10.0D as period_start"), F.expr("if(p_size%4>0, p_size%7*2.5D, null) as period_duration"),
                                          F.expr("(p_size%6)*1000 as units"), F.lit(1000.0).alias("timescale"), F.lit(5).alias("start_number"), F.lit("m/$RepresentationID$/$Number%04d$-$Time$-$$.m4s").alias("footage"), F.lit(1).alias("bandwidth"))
    s = S.template_segments(p)
    return s.select("key", F.col("sequence").cast("bigint").alias("sequence"), "time", F.round("start", 6).alias("start"), "url")


@query("man04_live_window", """with p as (select p_partkey, (p_size%6)*1000 as units from part where p_size%6>0), s as (select *, units/1000.0::double as dur, greatest(0, 100+p_partkey%50-20) as loc from p),
  w as (select *, floor(greatest(0, loc-30)/dur)::bigint as f, greatest(floor(greatest(0, loc-30)/dur), floor(loc/dur))::bigint as l from s) select 'r'||p_partkey as key, (1+i)::bigint as sequence from w, lateral (select unnest(generate_series(f, l)) as i)""")
def man04l(t):
    p = t.part.select(F.concat(F.lit("r"), "p_partkey").alias("key"), F.lit(20.0).alias("period_start"), F.lit(None).cast("double").alias("period_duration"), F.expr("(p_size%6)*1000 as units"),
                                          F.lit(1000.0).alias("timescale"), F.lit(1).alias("start_number"), F.lit("$Number$").alias("footage"), F.lit(1).alias("bandwidth"), (F.lit(100) + F.col("p_partkey") % 50).alias("now"))
    return S.template_segments(p, F.col("now")).select("key", F.col("sequence").cast("bigint").alias("sequence"))


@query("man05_events", f"with {_PER} select e.event_id, round(per.start+e.value*100/90,6) as time, round(e.value/90,6) as seconds from events e join per on per.period_index=e.event_id%1500")
def man05(t):
    e = t.events.select("event_id", (F.col("event_id") % 1500).alias("period_index"), (F.col("value") * 100).alias("presentation_time"), F.col("value").alias("event_duration"), F.lit(90.0).alias("timescale"))
    return r6(S.event_times(e, periods_of(t), "period_index").select("event_id", "time", "seconds"), "time", "seconds")


def windows_of(t):
    e = t.events.select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 60).alias("sequence"), (F.col("event_id") % 3 == 0).alias("partial"), F.concat(F.lit("u"), F.col("event_id") % 4).alias("url"),
                        (F.col("event_id") % 60 * 4).cast("double").alias("start"), F.lit(4.0).alias("duration"), F.col("event_id").alias("version"))
    fold = lambda df: df.groupBy("stream_id", "sequence", "partial", "url", "start", "duration").agg(F.max("version").alias("version"))
    return fold(e.where("version%2=0")), fold(e.where("version%2=1"))


_WIN = """e as (select user_id as stream_id, event_id%60 as sequence, event_id%3=0 as partial, 'u'||(event_id%4) as url, (event_id%60*4)::double as start, 4.0::double as duration, event_id as version from events),
  pr as (select stream_id, sequence, partial, url, start, duration, version%2 as side, max(version) as version from e group by all),
  mg as (select stream_id, sequence, partial, url, any_value(start) as start, any_value(duration) as duration, arg_max(version, side) as version from pr group by stream_id, sequence, partial, url), w as (select * from mg where sequence>=stream_id%20)"""


def merged_of(t):
    old, new = windows_of(t)
    streams = t.events.select(F.col("user_id").alias("stream_id")).distinct().withColumn("first_sequence", F.col("stream_id") % 20)
    return S.merge_window(old, new, streams)


@query("man06_merge_window", f"with {_WIN} select stream_id, sequence, partial, url, version from w")
def man06(t):
    return merged_of(t).select("stream_id", "sequence", "partial", "url", "version")


@query("man07_live_edge", f"with {_WIN}, ed as (select stream_id, max(start+duration) as edge from w group by 1), h as (select stream_id, edge, case when stream_id%3=0 then 1.5::double when stream_id%3=1 then 9.0::double else 6.0::double end as hold from ed) select stream_id, edge, hold, greatest(0::double, edge-hold) as position from h")
def man07(t):
    s = t.events.select(F.col("user_id").alias("stream_id")).distinct().selectExpr("stream_id", "if(stream_id%3=0, 1.5D, null) as part_hold_back", "if(stream_id%3=1, 9.0D, null) as hold_back", "cast(null as double) as suggested_delay", "cast(null as double) as target_duration")
    return S.live_edges(merged_of(t), s)


@query("man07_next_requests", f"""with {_WIN}, x as (select w.*, row_number() over (partition by w.stream_id order by start, partial::int, sequence, url) as turn from w where case when stream_id%2=0 then sequence>20 or (partial and sequence>=20) else start+duration>100 end)
  select stream_id, turn, sequence, partial, url from x where turn<=3""")
def man07n(t):
    c = t.events.select(F.col("user_id").alias("stream_id")).distinct().selectExpr("stream_id", "if(stream_id%2=0, 20, null) as after_sequence", "100.0D as playhead")
    return S.next_requests(merged_of(t), c).select("stream_id", "turn", "sequence", "partial", "url")


_PRB = "prb as (select distinct o_custkey as stream_id, p::double as probe from orders, (select unnest([100, 5000, 12345, 300000]) as p))"


@query("man08_active_period", f"""with {_PER}, {_PRB}, h as (select prb.stream_id, prb.probe, min(period_index) as hit from prb join per on per.stream_id=prb.stream_id and prb.probe>=per.start and (per.duration is null or prb.probe<per.start+per.duration) group by all), la as (select stream_id, max(period_index) as last from per group by 1)
  select prb.stream_id, prb.probe, coalesce(hit, last) as period_index from prb left join h on h.stream_id=prb.stream_id and h.probe=prb.probe left join la on la.stream_id=prb.stream_id""")
def man08(t):
    probes = t.orders.select(F.col("o_custkey").alias("stream_id")).distinct().select("stream_id", F.explode(F.array(*[F.lit(float(p)) for p in (100, 5000, 12345, 300000)])).alias("probe"))
    return S.active_periods(periods_of(t), probes, 1000.0)


@query("man09_references", """with recursive f as (select 'N'||n_nationkey as index_id, n_nationkey as root, c_custkey as ref_no, 'C'||c_custkey as child, null::bigint as size from nation join customer on c_nationkey=n_nationkey),
  lv2 as (select f.root, lpad(f.ref_no::varchar,9,'0')||'/'||lpad(o.o_orderkey::varchar,9,'0')||'/' as path, o.o_orderkey as k from f join orders o on o.o_custkey=f.ref_no) select 'N'||root as root_id, path, k as size from lv2""")
def man09(t):
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    a = t.customer.select(F.concat(F.lit("N"), "c_nationkey").alias("index_id"), F.col("c_custkey").alias("ref_no"), F.concat(F.lit("C"), "c_custkey").alias("child_index"), F.lit(1.0).alias("duration"), none.alias("size"))
    b = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("index_id"), F.col("o_orderkey").alias("ref_no"), text.alias("child_index"), F.lit(1.0).alias("duration"), F.col("o_orderkey").alias("size"))
    return S.expand_references(a.unionByName(b)).select("root_id", "path", "size")


_DL = "d as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, greatest(1, value*100000*8/greatest(0.001, event_id%7*0.25::double)) as bps from events)"
_EW = f"""{_DL}, e as (select user_id, n, 4e6::double+(bps-4e6)*(1-pow(0.5::double,1/3.0::double)) as fast, 4e6::double+(bps-4e6)*(1-pow(0.5::double,1/10.0::double)) as slow from d where n=1
  union all select d.user_id, d.n, e.fast+(d.bps-e.fast)*(1-pow(0.5::double,1/3.0::double)), e.slow+(d.bps-e.slow)*(1-pow(0.5::double,1/10.0::double)) from e join d on d.user_id=e.user_id and d.n=e.n+1)"""


def downloads_of(t):
    from ..sources.views import _REL_US
    return t.events.select("user_id", "event_id", F.expr(f"{_REL_US} as at_us"), (F.col("value") * 100000).alias("bytes"), (F.col("event_id") % 7 * 0.25).alias("seconds"))


def estimates_of(t):
    return S.throughput(downloads_of(t), "user_id", ["at_us", "event_id"], span_of("at_us", 10 * 86400e6), initial=4e6)


@query("abr01_throughput", f"with recursive {_EW}, k as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events) select event_id, round(fast/1e6::double,4) as fast_mbps, round(slow/1e6::double,4) as slow_mbps, round(least(fast,slow)/1e6::double,4) as estimate_mbps from e join k using (user_id, n)")
def abr01(t):
    mbps = lambda c, name: F.round(F.col(c) / 1e6, 4).alias(name)
    return estimates_of(t).select("event_id", mbps("fast_bps", "fast_mbps"), mbps("slow_bps", "slow_mbps"), mbps("estimate", "estimate_mbps"))


def variants_of(t):
    return t.part.groupBy((F.col("p_partkey") % 20).alias("manifest_id"), (F.col("p_size") * 400000).cast("bigint").alias("bitrate")).agg(F.min("p_partkey").alias("variant_id")).withColumn(
        "width", F.col("bitrate") / 8000).withColumn("height", F.col("bitrate") / 15000)


_VAR = "va as (select p_partkey%20 as manifest_id, (p_size*400000)::bigint as bitrate, min(p_partkey) as variant_id from part group by 1,2), vc as (select * from va where bitrate/15000<=1080)"
_CH = f"""{_VAR}, rq as (select event_id, event_id%20 as manifest_id, value*200000 as bw from events),
  af as (select rq.event_id, max(bitrate) as br from rq join vc on vc.manifest_id=rq.manifest_id and vc.bitrate<=greatest(1,bw)*0.82 group by 1), lo as (select manifest_id, min(bitrate) as br from vc group by 1),
  ch as (select rq.event_id, rq.manifest_id, bw, coalesce(af.br, lo.br) as bitrate from rq left join af using (event_id) left join lo using (manifest_id))"""


def choices_of(t):
    q = t.events.select((F.col("event_id") % 20).alias("manifest_id"), F.col("event_id").alias("request_id"), (F.col("value") * 200000).alias("bandwidth"))
    return S.choose_variants(q, variants_of(t), max_height=1080)


@query("abr02_choice", f"with {_CH} select ch.event_id as request_id, vc.variant_id, ch.bitrate::double as bitrate from ch left join vc on vc.manifest_id=ch.manifest_id and vc.bitrate=ch.bitrate")
def abr02(t):
    return choices_of(t).select("request_id", "variant_id", "bitrate")


@query("abr02_hysteresis", f"""with recursive {_CH}, s as (select *, row_number() over (partition by manifest_id order by event_id) as n from ch where bitrate is not null), h as (select manifest_id, n, event_id, bitrate as kept from s where n=1
  union all select s.manifest_id, s.n, s.event_id, case when s.bitrate>h.kept and s.bw<s.bitrate*1.15::double then h.kept else s.bitrate end from h join s on s.manifest_id=h.manifest_id and s.n=h.n+1)
  select h.event_id as request_id, vc.variant_id as kept from h join vc on vc.manifest_id=h.manifest_id and vc.bitrate=h.kept""")
def abr02h(t):
    return S.hold_upgrades(choices_of(t).where("variant_id is not null"), "manifest_id", ["request_id"]).select("request_id", "kept")


@query("abr03_counters", """select event_id, row_number() over w as downloads, max(event_id%90*4.0::double+4) over w as buffered_until, event_id%90 as last_sequence, sum(case when event_type='error' then 1 else 0 end) over w::bigint as discontinuities from events window w as (partition by user_id order by event_id)""")
def abr03(t):
    d = t.events.select("user_id", "event_id", (F.col("event_id") % 90).alias("sequence"), (F.col("event_id") % 90 * F.lit(4.0)).alias("start"), F.lit(4.0).alias("duration"), (F.col("event_type") == "error").alias("discontinuity"))
    return S.session_counters(d, "user_id", ["event_id"], span_of("event_id", 1 << 20)).select("event_id", "downloads", "buffered_until", "last_sequence", "discontinuities")


@query("abr04_fidelity", """with recursive d as (select user_id, event_id, value as ms, (event_type='error')::int as st, row_number() over (partition by user_id order by event_id) as n from events),
  e as (select user_id, n, event_id, ms as r, st*0.2::double as p from d where n=1 union all select d.user_id, d.n, d.event_id, e.r+(d.ms-e.r)*0.2::double, e.p+(d.st-e.p)*0.2::double from e join d on d.user_id=e.user_id and d.n=e.n+1),
  q as (select *, greatest(0.2, least(2, 1000.0::double/30*0.72::double/greatest(0.1,r)))*greatest(0.25, least(1, 1-p)) as q from e)
  select event_id, round(r,4) as render_ms, round(p,6) as stale_pressure, greatest(1, least(8, floor(round(8*q,9))))::int as temporal, round(greatest(0.5, least(1, sqrt(greatest(0.05,q)))),6) as scale from q""")
def abr04(t):
    f = t.events.select("user_id", "event_id", F.col("value").alias("duration_ms"), (F.col("event_type") == "error").cast("int").alias("stale"))
    out = S.fidelity(f, "user_id", ["event_id"], span_of("event_id", 4096))
    return out.select("event_id", F.round("render_ms", 4).alias("render_ms"), F.round("stale_pressure", 6).alias("stale_pressure"), "temporal", F.round("scale", 6).alias("scale"))


# --- signal -------------------------------------------------------------------------------------------------------------

@query("aud01_waveform", """with n as (select buffer_id, max(i)+1 as n from v_samples group by 1), b as (select buffer_id, n, unnest(generate_series(0,63)) as bin from n), e as (select *, floor(bin/64.0::double*n)::bigint as s, greatest(floor(bin/64.0::double*n)+1, floor((bin+1)/64.0::double*n))::bigint as f from b)
  select e.buffer_id, e.bin, round(least(1, coalesce(max(abs(v)),0)),3) as peak from e left join v_samples s on s.buffer_id=e.buffer_id and s.i>=e.s and s.i<e.f group by all""")
def aud01(t):
    return A.waveform(t.v_samples, 64)


@query("aud02_normalize", "with p as (select buffer_id, max(abs(v)) as peak from v_samples group by 1) select s.buffer_id, s.channel, s.i, round(v*0.98::double/peak,6) as v from v_samples s join p using (buffer_id)")
def aud02(t):
    return r6(A.normalize_peak(t.v_samples), "v")


_EN = """len as (select buffer_id, max(i)+1 as n from v_samples where channel=0 group by 1), bl as (select buffer_id, unnest(generate_series(0, (n-1)//10)) as block_no from len),
  ce as (select bl.buffer_id, block_no, channel, sum(v*v)/count(*) as ms from bl join v_samples s on s.buffer_id=bl.buffer_id and s.i>=block_no*10 and s.i<block_no*10+40 group by all),
  en as (select buffer_id, block_no, sum(case when channel=1 then 1.41::double else 1.0::double end*ms) as energy from ce group by all)"""


def energies_of(t):
    return A.block_energy(t.v_samples, 40, 10, {1: 1.41})


@query("aud03_block_energy", f"with {_EN} select buffer_id, block_no, round(energy,8) as energy from en")
def aud03(t):
    return r6(energies_of(t), "energy", n=8)


_LD = f"""{_EN}, ab as (select buffer_id, energy, -0.691::double+10*log10(energy) as l from en where energy>0), f as (select buffer_id, -0.691::double+10*log10(avg(energy)) as ungated from ab where l>=-70 group by 1),
  g as (select f.buffer_id, ungated, ungated-10 as threshold, -0.691::double+10*log10(avg(energy)) as integrated from f join ab using (buffer_id) where l>=-70 and l>=ungated-10 group by all)"""


@query("aud04_loudness", f"with {_LD} select buffer_id, round(ungated,6) as ungated, round(threshold,6) as threshold, round(integrated,6) as integrated from g")
def aud04(t):
    return r6(A.integrated_loudness(energies_of(t)), "ungated", "threshold", "integrated")


@query("aud05_gain", f"""with {_LD}, p as (select buffer_id, max(abs(v)) as peak from v_samples group by 1), x as (select buffer_id, greatest(-60, least(24, -14-integrated)) as gn, 20*log10(peak) as pk from g join p using (buffer_id))
  select buffer_id, round(case when pk+gn>-1 then gn-(pk+gn+1) else gn end,6) as gain_db from x""")
def aud05(t):
    rows = A.integrated_loudness(energies_of(t)).join(A.peaks(t.v_samples), "buffer_id")
    return r6(A.loudness_gain(rows).select("buffer_id", "gain_db"), "gain_db")


@query("aud06_resample", """with n as (select buffer_id, channel, max(i)+1 as n from v_samples group by all), g as (select buffer_id, channel, n, unnest(generate_series(0, round(n/1.6::double)::bigint-1)) as f from n), p as (select *, f*1.6::double as pos, floor(f*1.6::double)::bigint as l from g)
  select p.buffer_id, p.channel, f as i, round(case when pos>=n-1 then a.v else a.v*(1-(pos-l))+b.v*(pos-l) end,6) as v from p join v_samples a on a.buffer_id=p.buffer_id and a.channel=p.channel and a.i=p.l left join v_samples b on b.buffer_id=p.buffer_id and b.channel=p.channel and b.i=p.l+1""")
def aud06(t):
    return r6(A.resample(t.v_samples, 1600.0, 1000.0), "v")


_IT = "it as (select event_id as item_id, user_id as output_id, event_type as buffer_id, event_id%100 as dest_start, event_id%40 as source_start, 10+event_id%20 as frames, case when event_id%2=0 then 1.0::double else 1.5::double end as rate, (event_id%12-6)::double as gain_db, (event_id%3-1)::double as pan, event_id%5 as fi, event_id%4 as fo from events)"


def items_of(t):
    e = F.col("event_id")
    return t.events.select(e.alias("item_id"), F.col("user_id").alias("output_id"), F.col("event_type").alias("buffer_id"), (e % 100).alias("dest_start"), (e % 40).alias("source_start"), (10 + e % 20).alias("frames"),
                           F.when(e % 2 == 0, 1.0).otherwise(1.5).alias("playback_rate"), (e % 12 - 6).cast("double").alias("gain_db"), (e % 3 - 1).cast("double").alias("pan"), (e % 5).alias("fade_in"), (e % 4).alias("fade_out"))


@query("aud07_mix", f"""with {_IT}, n as (select buffer_id, channel, max(i)+1 as n from v_samples group by 1,2), x as (select it.*, greatest(0, least(120-dest_start, frames)) as fr from it), f as (select *, unnest(generate_series(0, fr-1)) as f from x where fr>0),
  p as (select f.*, n.channel, greatest(0, least(n.n-1, source_start+f*rate)) as pos from f join n on n.buffer_id=f.buffer_id), q as (select *, floor(pos)::bigint as l, pos-floor(pos) as mx, least(1, case when fi>0 then least(1, greatest(0, f/fi)) else 1 end, case when fo>0 then least(1, greatest(0, (fr-f)/fo)) else 1 end)*pow(10, gain_db/20) as g, (pan+1)*pi()/4 as an from p),
  v as (select q.*, case when mx>0 then a.v*(1-mx)+coalesce(b.v,a.v)*mx else a.v end as y from q join v_samples a on a.buffer_id=q.buffer_id and a.channel=q.channel and a.i=l left join v_samples b on b.buffer_id=q.buffer_id and b.channel=q.channel and b.i=l+1)
  select output_id, dest_start+f as i, round(coalesce(sum(y*g*cos(an)) filter (channel=0),0),4) as "left", round(coalesce(sum(y*g*sin(an)) filter (channel=1),0),4) as "right" from v group by all""")
def aud07(t):
    lengths = t.events.select(F.col("user_id").alias("output_id")).distinct().withColumn("length", F.lit(120))
    return r6(A.mix(items_of(t), t.v_samples, lengths), "left", "right", n=4)


@query("aud08_mix_plan", """select clip_id, asset_id, round(greatest(500000, start)*100)::bigint as start_sample, round(least(900000, start+duration)*100)::bigint as end_sample, round(in_point*100)::bigint as source_in, playback_rate from v_intervals where start+duration>500000 and start<900000""")
def aud08(t):
    return A.mix_plan(t.v_intervals, 500_000.0, 900_000.0, 100)


@query("aud09_mix_at", """with c as (select *, start+duration*(clip_id%11)/10.0::double as t, (clip_id%200-110)::double as gain_db, (clip_id%5-2)/2.0::double as pan, clip_id%7*3.0::double as fi, clip_id%4*5.0::double as fo from v_intervals),
  e as (select *, case when t<start or t>=start+duration then 0 else least(1, case when fi>0 then least(1,greatest(0,(t-start)/fi)) else 1 end, case when fo>0 then least(1,greatest(0,(start+duration-t)/fo)) else 1 end) end as env, case when gain_db<=-96 then 0 else pow(10,gain_db/20) end as g from c)
  select clip_id, round(env,6) as envelope, round(g*env,6) as gain, round(g*env*cos((greatest(-1,least(1,pan))+1)*pi()/4),6) as left_gain, round(g*env*sin((greatest(-1,least(1,pan))+1)*pi()/4),6) as right_gain, round(in_point+greatest(0,t-start)*playback_rate,6) as source_time from e""")
def aud09(t):
    c = t.v_intervals.selectExpr("*", "start+duration*(clip_id%11)/10.0D as t", "cast(clip_id%200-110 as double) as gain_db", "(clip_id%5-2)/2.0D as pan", "clip_id%7*3.0D as fade_in", "clip_id%4*5.0D as fade_out")
    x = A.mix_at(c)
    return r6(x.select("clip_id", "envelope", "gain", "left_gain", "right_gain", "source_time"), "envelope", "gain", "left_gain", "right_gain", "source_time")


_AU = "au as (select event_type as buffer_id, (event_id%50)*2.0::double as time, arg_max((event_id%37-20)::double, event_id) as value from events group by all)"


def automation_of(t):
    return t.events.select(F.col("event_type").alias("buffer_id"), (F.col("event_id") % 50 * F.lit(2.0)).alias("time"), (F.col("event_id") % 37 - 20).cast("double").alias("value"), F.lit("linear").alias("easing"), F.col("event_id").alias("ordinal"))


_AUAT = f"""{_AU}, s as (select *, i/10.0::double as t from v_samples), l as (select s.*, a.time as lt, a.value as lv from s asof left join au a on a.buffer_id=s.buffer_id and s.t>a.time), r as (select l.*, a.time as rt, a.value as rv from l asof left join au a on a.buffer_id=l.buffer_id and l.t<=a.time),
  d as (select *, case when lt is null then rv when rt is null then lv else lv+(rv-lv)*(t-lt)/(rt-lt) end as db from r)"""


@query("aud10_automation", f"with {_AUAT} select buffer_id, channel, i, round(v*case when db<=-120 then 0 else pow(10,db/20) end,6) as v from d")
def aud10(t):
    return r6(A.automate_gain(t.v_samples, automation_of(t), 10.0, width=20.0), "v")


@query("aud10_pan", f"with {_AUAT} select buffer_id, channel, i, round(v*case channel when 0 then cos((greatest(-1,least(1,db/20))+1)*pi()/4) else sin((greatest(-1,least(1,db/20))+1)*pi()/4) end,6) as v from d")
def aud10p(t):
    p = automation_of(t).withColumn("value", F.col("value") / 20)
    return r6(A.automate_pan(t.v_samples, p, 10.0, width=20.0), "v")


@query("aud11_merge_blocks", """with b as (select buffer_id, channel, i//50 as block_no, (i//50)*4.5::double as ts, i%50 as off, v from v_samples where (i//50)%3<>1), s as (select buffer_id, channel, block_no, round(ts*10)::bigint+off as i, v from b), w as (select buffer_id, channel, i, arg_max(v, block_no) as v from s where i>=100 and i<400 group by all),
  g as (select buffer_id, channel, unnest(generate_series(100,399)) as i from (select distinct buffer_id, channel from b)) select g.buffer_id, g.channel, g.i-100 as i, coalesce(w.v,0) as v from g left join w on w.buffer_id=g.buffer_id and w.channel=g.channel and w.i=g.i""")
def aud11(t):
    b = t.v_samples.withColumn("block_no", F.expr("i div 50")).where("block_no%3<>1").selectExpr("buffer_id", "channel", "block_no", "block_no*4.5D as timestamp", "i%50 as offset", "v")
    r = b.select("buffer_id").distinct().withColumn("range_start", F.lit(10.0)).withColumn("range_end", F.lit(40.0))
    return A.merge_blocks(b, r, 10.0)


@query("aud12_blocks", "select buffer_id, channel, i//128 as block_no, (i//128)*128 as start, count(*) as length, round(sum(v),6) as total from v_samples group by all")
def aud12(t):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return A.blocks_of(t.v_samples, 128).select("buffer_id", "channel", "block_no", "start", "length", F.round(total, 6).alias("total"))


# --- ledgers ------------------------------------------------------------------------------------------------------------

_JR = "jr as (select o_orderkey as signature, (o_orderkey%30+1)::double as fps, (o_orderkey%7)*1.5::double as a, (o_orderkey%7)*1.5::double+(o_orderkey%40)::double as b from orders), jf as (select *, ceil(a*fps-1e-9)::bigint as fa, ceil(b*fps-1e-9)::bigint as fb from jr)"


def ranges_of(t):
    return t.orders.selectExpr("o_orderkey as signature", "cast(o_orderkey%30+1 as double) as fps", "(o_orderkey%7)*1.5D as range_start", "(o_orderkey%7)*1.5D+cast(o_orderkey%40 as double) as range_end")


@query("job01_chunks", f"with {_JR} select signature, i as index, signature||':'||lpad(i::varchar,5,'0') as chunk_id, fa+i*120 as frame_start, least(fb, fa+i*120+120) as frame_end, round((fa+i*120)/fps,6) as time_start from jf, lateral (select unnest(generate_series(0, ceil((fb-fa)/120)::bigint-1)) as i) where fb>fa")
def job01(t):
    return J.job_plan(ranges_of(t)).select("signature", "index", "chunk_id", "frame_start", "frame_end", F.round("time_start", 6).alias("time_start"))


_K2 = """tot as (select user_id as asset_id, max(epoch_us(ts)-epoch_us(timestamp '2024-01-01'))/1e6+200000 as total from events group by 1), kf as (select distinct user_id as asset_id, (epoch_us(ts)-epoch_us(timestamp '2024-01-01'))/1e6 as time from events where event_type='purchase'),
  st as (select asset_id, total, 0.0::double as start, 0 as index from tot union all select asset_id, total, nx, index+1 from (select st.asset_id, st.total, st.index, coalesce((select min(time) from kf where kf.asset_id=st.asset_id and kf.time>=st.start+86400-0.001 and kf.time<st.total), least(st.total, st.start+86400)) as nx from st where st.start+86400<st.total) where nx<total)"""


@query("job02_segments", f"with recursive {_K2} select asset_id, index::bigint as index, round(start,6) as start, round(coalesce(lead(start) over (partition by asset_id order by index), total),6) as fin from st")
def job02(t):
    p = t.v_points.select(F.col("series_id").alias("asset_id"), "time", "ordinal")
    kf = t.v_chunks.where("is_key").select(F.col("track_id").alias("asset_id"), (F.col("timestamp_us") / 1e6).alias("time"))
    totals = p.groupBy("asset_id").agg((F.max("time") + 200000).alias("total"))
    s = J.keyframe_segments(kf, totals, 86400.0)
    return s.select("asset_id", "index", F.round("start", 6).alias("start"), F.round("end", 6).alias("fin"))


def sources_of(t):
    return t.v_footage.withColumn("duration", F.col("source_duration"))


@query("job03_derivatives", """select asset_id, 'thumbnail' as type, 320::bigint as width, case when asset_kind='video' then 12::bigint else 1 end as times from v_footage where asset_kind in ('video','image') union all
  select asset_id, 'proxy-video', greatest(1, round(width*1280/greatest(width,height)))::bigint, null from v_footage where asset_kind='video' and greatest(width,height)>1280 union all select asset_id, 'waveform', 1024, null from v_footage where asset_kind in ('audio','video')""")
def job03(t):
    return J.derivative_plan(sources_of(t)).select("asset_id", "type", "width", "times")


@query("job03_thumbnail_times", "select asset_id, i as slot, round(source_duration*i/11,6) as time from v_footage, (select unnest(generate_series(0,11)) as i)")
def job03t(t):
    return r6(J.thumbnail_times(sources_of(t)), "time")


_ST = "js as (select job_id, case when bool_and(status='complete') then 'complete' when bool_or(status='failed' and attempts>=max_attempts) then 'failed' when bool_or(status='running') then 'running' else 'pending' end as status from v_job_chunks group by 1)"


@query("job04_status", f"with {_ST} select * from js")
def job04(t):
    return J.job_status(t.v_job_chunks)


@query("job05_progress", """select job_id, sum(frame_count)::bigint as total, coalesce(sum(frame_count) filter (status='complete'),0)::bigint as completed, coalesce(sum(frame_count) filter (status='running'),0)::bigint as running, coalesce(sum(frame_count) filter (status='failed'),0)::bigint as failed, count(*) as segments, count(*) filter (status='complete') as completed_segments,
  round(coalesce(sum(frame_count) filter (status='complete'),0)/sum(frame_count),6) as ratio from v_job_chunks group by 1""")
def job05(t):
    return r6(J.job_progress(t.v_job_chunks), "ratio")


@query("job06_recover", "select job_id, idx, l_partkey, case when status='running' then case when attempts<3 then 'pending' else 'failed' end else status end as status, case when status='running' then 'Interrupted' end as error from v_job_chunks")
def job06(t):
    return J.recover(t.v_job_chunks).select("job_id", "idx", "l_partkey", "status", "error")


_LE = "le as (select user_id as chunk, event_id, row_number() over (partition by user_id order by event_id) as n, case event_type when 'view' then 'claim' when 'signup' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'release' end as event from events)"
_LX = f"""{_LE}, m as (select chunk, 0::bigint as n, 0::bigint as event_id, 'pending' as status, 0::bigint as attempts, true as legal from (select distinct chunk from le)
   union all select le.chunk, le.n, le.event_id,
    case when le.event='claim' and (m.status='pending' or (m.status='failed' and m.attempts<3)) then 'running' when m.status='running' and le.event='complete' then 'complete' when m.status='running' and le.event='fail' then case when m.attempts<3 then 'pending' else 'failed' end when m.status='running' and le.event='release' then 'pending' else m.status end,
    case when le.event='claim' and (m.status='pending' or (m.status='failed' and m.attempts<3)) then least(m.attempts+1,3) when m.status='running' and le.event='release' then greatest(0,m.attempts-1) else m.attempts end,
    (le.event='claim' and (m.status='pending' or (m.status='failed' and m.attempts<3))) or (m.status='running' and le.event<>'claim')
   from m join le on le.chunk=m.chunk and le.n=m.n+1)"""


@query("job07_replay", f"with recursive {_LX} select event_id, status, attempts, legal from m where n>0")
def job07(t):
    e = t.events.select(F.col("user_id").alias("chunk"), "event_id", F.expr("case event_type when 'view' then 'claim' when 'signup' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'release' end as event"))
    return J.replay_ledger(e, ["chunk"], ["event_id"], span_of("event_id", 2048)).select("event_id", "status", "attempts", "legal")


@query("job08_artifacts", f"with {_ST} select c.job_id, c.idx, c.l_partkey, c.frame_count from v_job_chunks c join js using (job_id) where js.status='complete'")
def job08(t):
    return J.artifact_manifest(t.v_job_chunks).select("job_id", "idx", "l_partkey", "frame_count")


# --- dependencies ---------------------------------------------------------------------------------------------------------

def tasks_of(t):
    """One task per order line number; each waits for the highest lower number of the same order."""
    from ..operators.scan import span_scan
    k = t.v_job_chunks.groupBy("job_id", "idx").agg(F.min("status").alias("status"))
    k = k.withColumn("task_id", F.col("job_id") * 10 + F.col("idx")).withColumn("optional", F.col("idx") % 3 == 0)
    d = span_scan(k, ["job_id"], ["idx"], span_of("idx", 1 << 16), depends_on=("lag", F.col("task_id")))
    return k, d.where("depends_on is not null").select("task_id", "depends_on")


_TK = "tk as (select job_id, idx, min(status) as status, job_id*10+idx as task_id, idx%3=0 as optional from v_job_chunks group by job_id, idx), dp as (select task_id, lag(task_id) over (partition by job_id order by idx) as depends_on from tk), dep as (select * from dp where depends_on is not null)"


@query("dag01_tasks", f"""with {_JR}, ck as (select signature as job_id, signature||':'||lpad(i::varchar,5,'0') as chunk_id from jf, lateral (select unnest(generate_series(0, ceil((fb-fa)/120)::bigint-1)) as i) where fb>fa), src as (select distinct l_orderkey as job_id, l_partkey as source_id from lineitem)
  select kind, count(*) as tasks from (select 'verify-source' as kind from src union all select 'sources-ready' from orders union all select 'render-frames' from ck union all select 'encode-video' from ck union all select 'mux' from orders) group by 1""")
def dag01(t):
    chunks = J.job_plan(ranges_of(t)).select(F.col("signature").alias("job_id"), "chunk_id")
    src = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("source_id"))
    tasks, _ = J.production_tasks(chunks, src, t.orders.select(F.col("o_orderkey").alias("job_id")))
    return tasks.groupBy("kind").agg(F.count("*").alias("tasks"))


def broken_of(t):
    k, d = tasks_of(t)
    loops = k.where("idx = 1 and job_id%10 = 0").select("task_id", (F.col("job_id") * 10 + 2).alias("depends_on"))
    lost = k.where("idx = 1 and job_id%25 = 0").select("task_id", F.lit(-5).cast("bigint").alias("depends_on"))
    twice = k.where("job_id%100 = 1 and idx = 1")
    return k.unionByName(twice), d.unionByName(loops).unionByName(lost)


@query("dag02_violations", f"""with {_TK}, bad as (select distinct t1.job_id from tk t1 join tk t2 on t2.job_id=t1.job_id and t2.idx=2 where t1.idx=1 and t1.job_id%10=0)
  select task_id, 'duplicate' as code from tk where job_id%100=1 and idx=1 union all select task_id, 'unknown-dependency' from tk where idx=1 and (job_id%25=0 or (job_id%10=0 and job_id not in (select job_id from tk where idx=2)))
  union all select task_id, 'cycle' from tk where job_id in (from bad)""")
def dag02(t):
    return J.dependency_violations(*broken_of(t))


@query("dag03_runnable", f"with {_TK} select task_id from tk where status='pending' and task_id not in (select dep.task_id from dep join tk p on p.task_id=dep.depends_on where p.status<>'complete')")
def dag03(t):
    return J.runnable(*tasks_of(t)).select("task_id")


@query("dag04_levels", f"with {_TK} select task_id, row_number() over (partition by job_id order by idx)-1 as level from tk")
def dag04(t):
    return J.task_levels(*tasks_of(t)).select("task_id", "level")


@query("dag05_cascade", f"""with recursive {_TK}, fl as (select task_id from tk where status='failed' union select dep.task_id from fl join dep on dep.depends_on=fl.task_id join tk on tk.task_id=dep.task_id where tk.status='pending')
  select task_id, case when task_id in (from fl) then 'failed' else status end as status, case when status='pending' and task_id in (from fl) then 'dependency-failed' end as error from tk""")
def dag05(t):
    return J.fail_cascade(*tasks_of(t)).select("task_id", "status", "error")


@query("dag06_progress", f"""with {_TK}, g as (select job_id, count(*) filter (not optional) as required, count(*) filter (not optional and status='complete') as complete, count(*) filter (not optional and status='failed') as failed, count(*) filter (status='running') as running, count(*) filter (optional) as optional_total, count(*) filter (optional and status in ('complete','failed')) as optional_terminal from tk group by 1)
  select *, round(case when required>0 then complete/required else 1::double end,6) as ratio, complete=required and optional_terminal=optional_total as done, failed>0 as blocked from g""")
def dag06(t):
    return r6(J.task_progress(tasks_of(t)[0], "job_id"), "ratio")


@query("dag06_skip", f"with {_TK} select task_id, case when optional and status='failed' then 'complete' else status end as status, optional and status='failed' as skipped from tk")
def dag06s(t):
    return J.skip_failed_optional(tasks_of(t)[0]).select("task_id", "status", "skipped")


_D7 = f"{_TK}, lv as (select task_id, row_number() over (partition by job_id order by idx)-1 as level from tk), rs as (select job_id*10+idx as task_id, l_partkey as op_no, 'op'||frame_count as op from v_job_chunks where l_partkey%7<>0), wt as (select task_id from tk where not (optional and status='failed'))"


def merged_results_of(t):
    k, d = tasks_of(t)
    rs = t.v_job_chunks.where("l_partkey%7<>0").select((F.col("job_id") * 10 + F.col("idx")).alias("task_id"), F.col("l_partkey").alias("op_no"), F.concat(F.lit("op"), "frame_count").alias("op"))
    return J.merge_results(k, J.task_levels(k, d), rs)


@query("dag07_results", f"with {_D7} select level, task_id, op_no, op from rs join lv using (task_id) where task_id in (from wt)")
def dag07(t):
    return merged_results_of(t)[0]


@query("dag07_missing", f"with {_D7} select task_id from wt where task_id not in (select task_id from rs)")
def dag07m(t):
    return merged_results_of(t)[1]
