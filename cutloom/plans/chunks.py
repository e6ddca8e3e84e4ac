"""Sample-index, transport and byte-range queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C, ranges as R
from ..operators.scan import span_of
from .registry import query

DAY = 86400e6


def t_span():
    return span_of("timestamp_us", DAY)

PROBES = (86400.5, 900000.25, 2000000.75)


def probes_of(t):
    """Every track at the fixed probe times."""
    return t.events.select(F.col("user_id").alias("track_id")).distinct().select(
        "track_id", F.explode(F.array(*[F.lit(p) for p in PROBES])).alias("probe"))


def requests_of(t):
    return t.events.select(F.col("user_id").alias("track_id")).distinct().select(
        "track_id", F.explode(F.array(*[F.struct(F.lit(i).alias("request"), F.lit(a).cast("bigint").alias("start_us"),
                                                 F.lit(b).cast("bigint").alias("end_us"))
                                        for i, a, b in ((1, 400000 * 10**6, 500000 * 10**6), (2, 10**12, 1100000 * 10**6),
                                                        (3, 1800000 * 10**6, 1800500 * 10**6))])).alias("r")).select(
        "track_id", "r.*").withColumn("preroll_us", F.lit(3600 * 10**6).cast("bigint")).withColumn(
        "postroll_us", F.lit(60 * 10**6).cast("bigint"))


_PROBES = "probes as (select distinct user_id as track_id, unnest([86400.5, 900000.25, 2000000.75])::double as probe from events)"
_REQ = """req as (select track_id, r.request, r.start_us, r.end_us, 3600000000::bigint as preroll_us, 60000000::bigint as postroll_us
  from (select distinct user_id as track_id from events), (values (1::int, 400000000000::bigint, 500000000000::bigint),
  (2, 1000000000000, 1100000000000), (3, 1800000000000, 1800500000000)) r(request, start_us, end_us))"""
_KEYS = "keys as (select track_id, timestamp_us/1e6 as time from v_chunks where is_key)"


@query("ch01_byte_ranges", """select source_id, idx, off, len, s.source_size from v_ranges r
  join (select s_suppkey as source_id, 600000+s_suppkey*1000 as source_size from supplier) s using (source_id)
  where off<0 or len<0 or off+len>s.source_size""")
def ch01(t):
    sizes = t.supplier.selectExpr("s_suppkey as source_id", "600000+s_suppkey*1000 as source_size")
    return C.byte_range_violations(t.v_ranges, sizes, "source_id").select("source_id", "idx", "off", "len", "source_size")


@query("ch02_timeline", """with x as (select track_id, event_id%16 as sequence, event_id, timestamp_us//21600000000*21600000000 as dts,
  lag(event_id%16) over w as ps from v_chunks window w as (partition by track_id order by timestamp_us//21600000000*21600000000, event_id%16, event_id))
  select track_id, sequence, dts, 'sequence-regression' as type from x where sequence<=ps""")
def ch02(t):
    c = t.v_chunks.selectExpr("track_id", "timestamp_us div 21600000000 * 21600000000 as dts", "counter as sequence")
    return C.timeline_violations(c, "track_id", "dts", "sequence", span_of("dts", DAY)).select(
        "track_id", "sequence", "dts", "type")


@query("ch03_arrival", """with x as (select track_id, event_id, timestamp_us as ts, counter, is_key, lag(timestamp_us) over w as pt,
  lag(counter) over w as ps, row_number() over w as n from v_chunks window w as (partition by track_id order by event_id))
  select track_id, event_id, 'non-monotonic-timestamp' as type from x where ts<pt
  union all select track_id, event_id, 'non-increasing-sequence' from x where counter<=ps
  union all select track_id, event_id, 'missing-initial-key' from x where n=1 and not is_key""")
def ch03(t):
    return C.arrival_violations(t.v_chunks, "track_id", "event_id", "timestamp_us", "counter", "is_key",
                                span_of("event_id", 1 << 20), True)


@query("ch03_turns", """with x as (select conv_id, turn, length(text) as n, lag(length(text)) over w as p,
  row_number() over w as rn, lag(turn) over w as pt, role from conversations window w as (partition by conv_id order by turn))
  select conv_id as track_id, turn, 'non-monotonic-timestamp' as type from x where n<p
  union all select conv_id, turn, 'non-increasing-sequence' from x where turn<=pt
  union all select conv_id, turn, 'missing-initial-key' from x where rn=1 and role<>'user'""")
def ch03t(t):
    c = t.conversations.select(F.col("conv_id").alias("track_id"), "turn", F.length("text").alias("n"),
                               (F.col("role") == "user").alias("first"))
    return C.arrival_violations(c.withColumn("seq", F.col("turn")), "track_id", "turn", "n", "seq", "first",
                                span_of("turn", 1 << 16), True)


_CH04 = """c as (select job_id, idx, l_partkey, frame_count, idx*10-10 as first, idx*10-10+least(frame_count,12) as fin from v_job_chunks),
  x as (select *, lag(fin) over w as p, row_number() over w as n from c window w as (partition by job_id order by idx, first, fin))"""


@query("ch04_partition", f"""with {_CH04}
  select job_id, idx-1 as index, 'negative-frame-range' as type, first as expected, fin as actual from x where fin<first
  union all select job_id, idx-1, 'frame-gap-or-overlap', p, first from x where p<>first
  union all select job_id, idx-1, 'chunk-index', n-1, idx-1 from x where idx-1<>n-1
  union all select o.o_orderkey, -1, 'frame-count', 40, coalesce(s,0)::bigint from orders o left join
    (select job_id, sum(greatest(0,fin-first)) as s from c group by 1) g on g.job_id=o.o_orderkey where 40<>coalesce(s,0)""")
def ch04(t):
    c = t.v_job_chunks.selectExpr("job_id", "idx-1 as index", "idx*10-10 as first", "idx*10-10+least(frame_count,12) as fin")
    totals = t.orders.select(F.col("o_orderkey").alias("job_id"), F.lit(40).cast("bigint").alias("frame_count"))
    return C.partition_violations(c, "job_id", "index", "first", "fin", span_of("index", 1 << 16), totals)


_CH05 = """s0 as (select l_suppkey as track, l_orderkey*1000 as dts, cast(l_quantity as bigint)*100 as dur, cast(l_quantity as bigint)*16 as bytes,
  row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice)-1 as row from lineitem),
  g as (select track, row, row as head, dts, dts+dur as fin, bytes, 1 as n from s0 where row=0
    union all select s.track, s.row, case when j then g.head else s.row end, case when j then g.dts else s.dts end,
      case when j then greatest(g.fin, s.dts+s.dur) else s.dts+s.dur end, case when j then g.bytes+s.bytes else s.bytes end,
      case when j then g.n+1 else 1 end
    from g join s0 s on s.track=g.track and s.row=g.row+1,
      lateral (select g.bytes+s.bytes<=4000 and greatest(g.fin, s.dts+s.dur)-g.dts<=500000 and g.n<8 as j))"""


@query("ch05_groups", f"""with recursive {_CH05} select track, head, count(*) as samples, cast(max(bytes) as bigint) as bytes,
  min(dts) as dts, max(fin)-min(dts) as duration from g group by track, head""")
def ch05(t):
    s = t.lineitem.selectExpr("l_suppkey as track", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                              "l_orderkey*1000 as dts", "cast(l_quantity as bigint)*100 as dur", "cast(l_quantity as bigint)*16 as bytes")
    return C.plan_groups(s, "track", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "bytes", "dts", "dur",
                         span_of("l_orderkey", 1 << 20), 4000, 500000, 8)


@query("ch06_runs", """with x as (select l_suppkey as track, least(cast(l_quantity as bigint)//20, 2) as samples,
  row_number() over w as first, lag(least(cast(l_quantity as bigint)//20, 2)) over w as p from lineitem
  window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice))
  select track, first, samples from x where p is null or p<>samples""")
def ch06(t):
    s = t.lineitem.selectExpr("l_suppkey as track", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                              "least(cast(l_quantity as bigint) div 20, 2) as samples")
    return C.change_runs(s, "track", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "samples",
                         span_of("l_orderkey", 1 << 20))


@query("ch07_projection", """with p as (select o_orderkey as id, o_totalprice as d from orders),
  q as (select id, ceil(d*30)+ceil(d/(1024.0::double/48000)) as samples, ceil(d)*2 as chunks, ceil(d/2) as keyframes from p),
  z as (select *, (20+samples*4)+(16+chunks*8)+(16+greatest(1,least(chunks,16))*12)+(16+8)+0+(case when keyframes>0 then 16+keyframes*4 else 0 end) as total from q)
  select id, samples::bigint as samples, chunks::bigint as chunks, keyframes::bigint as keyframes, total::bigint as table_bytes,
   total>67108864 as too_big from z""")
def ch07(t):
    return R.scale_projection(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("seconds")), "seconds").select(
        "id", "samples", "chunks", "keyframes", "table_bytes", "too_big")


@query("ch08_interleave", """with x as (select track_id, event_id, timestamp_us as dts, lag(timestamp_us) over (partition by track_id order by event_id) as p from v_chunks)
  select track_id, event_id, 'unknown-track' as type from x where track_id not in (select c_custkey from customer where c_nationkey<>3)
  union all select track_id, event_id, 'non-monotonic-dts' from x where dts<p""")
def ch08(t):
    tracks = t.customer.where("c_nationkey <> 3").select(F.col("c_custkey").alias("track_id"))
    return C.interleave_violations(t.v_chunks, tracks, "track_id", "event_id", "timestamp_us", span_of("event_id", 1 << 20))


_CH09 = """s as (select track_id as plan, timestamp_us as t, timestamp_us+duration_us as e, is_key,
    row_number() over (partition by track_id order by timestamp_us, sequence) as rn from v_chunks),
  g as (select plan, rn, t, e, 0::bigint as seg, 86400000000::bigint*(case when is_key and t>=86400000000 then t//86400000000+1 else 1 end) as boundary from s where rn=1
    union all select s.plan, s.rn, s.t, s.e, case when c then g.seg+1 else g.seg end,
      case when c then (s.t//86400000000+1)*86400000000 else g.boundary end
    from g join s on s.plan=g.plan and s.rn=g.rn+1, lateral (select s.is_key and s.t>=g.boundary as c))"""


@query("ch09_segments", f"""with recursive {_CH09} select plan, seg as segment, min(t) as start, max(e) as fin, count(*) as samples from g group by plan, seg""")
def ch09(t):
    s = t.v_chunks.selectExpr("track_id as plan", "timestamp_us", "sequence", "timestamp_us+duration_us as fin", "is_key")
    return C.segment_samples(s, "plan", ["timestamp_us", "sequence"], "timestamp_us", "fin", F.col("is_key"), 86400000000,
                             t_span()).select("plan", "segment", "start", F.col("end").alias("fin"), "samples")


@query("ch10_bytes", """select l_suppkey as track, ceil(sum(cast(l_quantity as bigint)*16)*(1+0.015::double))::bigint as bytes from lineitem group by 1""")
def ch10(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("track")).agg(
        F.ceil(F.sum(F.col("l_quantity").cast("bigint") * 16) * (F.lit(1.0) + F.lit(0.015))).cast("bigint").alias("bytes"))


@query("ix01_index", "select track_id, sequence, timestamp_us/1e6 as time, (timestamp_us+duration_us)/1e6 as end_time, is_key from v_chunks")
def ix01(t):
    return C.seek_index(t.v_chunks).select("track_id", "sequence", "time", "end_time", "is_key")


@query("ix02_keyframes", f"""with {_PROBES}, {_KEYS}, a as (select p.track_id, p.probe,
   coalesce(max(time) filter (time<=probe), min(time)) as backward, coalesce(min(time) filter (time>=probe), max(time)) as forward,
   arg_min(time, abs(time-probe)) as nearest from probes p left join keys k using (track_id) group by all) select * from a""")
def ix02(t):
    return C.nearest_keyframe(C.seek_index(t.v_chunks), probes_of(t))


@query("ix03_decode_window", f"""with {_PROBES}, {_KEYS}, w as (select p.track_id, p.probe,
   coalesce(max(time) filter (time<=probe-7200), min(time), any_value(probe)-7200) as window_start, any_value(probe)+36000 as window_end
   from probes p left join keys k using (track_id) group by p.track_id, p.probe)
  select w.track_id, w.probe, w.window_start, c.sequence from w join v_chunks c on c.track_id=w.track_id
   and c.timestamp_us/1e6<window_end and (c.timestamp_us+c.duration_us)/1e6>window_start""")
def ix03(t):
    return C.decode_windows(C.seek_index(t.v_chunks), probes_of(t), 36000.0, 7200.0, 86400.0).select(
        "track_id", "probe", "window_start", "sequence")


@query("ix04_chunk_window", f"""with {_REQ}, hits as (select r.*, c.sequence, c.timestamp_us from req r join v_chunks c on c.track_id=r.track_id
    and c.timestamp_us<r.end_us and c.timestamp_us+c.duration_us>=greatest(0,r.start_us-r.preroll_us)),
  f as (select track_id, request, start_us, end_us, min(timestamp_us) as first from hits group by all),
  k as (select f.*, (select max(timestamp_us) from v_chunks c where c.track_id=f.track_id and c.is_key and c.timestamp_us<=least(f.first,f.start_us)) as key from f)
  select k.request, k.track_id, c.sequence from k join v_chunks c on c.track_id=k.track_id and c.timestamp_us>=k.key and c.timestamp_us<k.end_us
  union all select h.request, h.track_id, h.sequence from hits h join k on k.track_id=h.track_id and k.request=h.request where k.key is null""")
def ix04(t):
    return C.extended_windows(t.v_chunks, requests_of(t), DAY).select("request", "track_id", "sequence")


@query("ix05_audio_range", f"""with {_REQ} select r.request, r.track_id, c.sequence from req r join v_chunks c on c.track_id=r.track_id
   and c.timestamp_us<r.end_us+r.postroll_us and c.timestamp_us+c.duration_us>greatest(0,r.start_us-r.preroll_us)""")
def ix05(t):
    return C.chunks_in_range(t.v_chunks, requests_of(t), DAY).select("request", "track_id", "sequence")


_L = "l_suppkey as track, l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(l_quantity as bigint) as dur, cast(l_quantity as bigint)*16 as size, l_partkey%5 as comp"


@query("ix06_sample_table", f"""with s as (select {_L}, row_number() over w as sample_number,
   sum(cast(l_quantity as bigint)) over w - cast(l_quantity as bigint) as dts,
   sum(cast(l_quantity as bigint)*16) over (partition by l_suppkey, l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - cast(l_quantity as bigint)*16 as inner_off
   from lineitem window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice))
  select track, sample_number, dts::bigint as dts, greatest(0, dts+comp)::bigint as pts, (l_orderkey*100000+inner_off)::bigint as byte_offset, sample_number%10=1 as is_sync from s""")
def ix06(t):
    s = t.lineitem.selectExpr(*[x.strip() for x in _L.split(", ")], "l_orderkey*100000 as chunk_offset")
    return C.sample_index(s, "track", "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], "dur", "size", "comp",
                          "chunk_offset", F.col("sample_number") % 10 == 1, span_of("l_orderkey", 1 << 20)).select(
        "track", "sample_number", "dts", "pts", "byte_offset", "is_sync")


@query("ix06_expand_runs", """with r as (select l_suppkey as track, l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint)//10 as n, cast(l_quantity as bigint) as delta,
   sum(cast(l_quantity as bigint)//10) over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - cast(l_quantity as bigint)//10 as before from lineitem)
  select track, (before+i)::bigint as number, delta from r, lateral (select unnest(generate_series(1, n)) as i) where n>0""")
def ix06r(t):
    r = t.lineitem.selectExpr("l_suppkey as track", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                              "cast(l_quantity as bigint) div 10 as n", "cast(l_quantity as bigint) as delta")
    return C.expand_runs(r, "track", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "n",
                         span_of("l_orderkey", 1 << 20)).select("track", "number", "delta")


@query("ix07_plan_summary", """select track_id, max(timestamp_us+duration_us)/1e6 as duration, count(distinct timestamp_us) filter (is_key) as seek_points,
  min(timestamp_us) filter (is_key) as first_seek_us, max(timestamp_us) filter (is_key) as last_seek_us from v_chunks group by 1""")
def ix07(t):
    return C.plan_summary(t.v_chunks)


@query("ix07_seek_points", "select distinct track_id, timestamp_us from v_chunks where is_key")
def ix07p(t):
    return C.seek_points(t.v_chunks)


@query("ix08_extent", """select track_id, min(timestamp_us) as start_us, max(timestamp_us+duration_us) as end_us,
  max(timestamp_us+duration_us)-min(timestamp_us) as duration_us from v_chunks group by 1""")
def ix08(t):
    return C.extent(t.v_chunks)


@query("ts01_continuity", """with p as (select track_id, event_id, counter, is_key, lag(counter) over (partition by track_id order by event_id) as prev
   from v_chunks where byte_length%10<>0 and track_id<>8191)
  select track_id, event_id, counter, prev as previous, (prev+1)%16 as expected from p where not is_key and prev is not null and counter<>(prev+1)%16""")
def ts01(t):
    return C.continuity_errors(t.v_chunks, "track_id", ["event_id"], "counter", F.col("byte_length") % 10 != 0, F.col("is_key"),
                               span_of("event_id", 1 << 20)).select("track_id", "event_id", "counter", "previous", "expected")


@query("ts02_unwrap", """with p as (select track_id, sequence, raw33, raw33-lag(raw33) over (partition by track_id order by sequence) as d from v_chunks),
  e as (select *, sum(case when d<-4294967296 then 1 when d>4294967296 then -1 else 0 end) over (partition by track_id order by sequence) as epoch from p)
  select track_id, sequence, (raw33+epoch*8589934592)::bigint as unwrapped from e""")
def ts02(t):
    # spread the raw clock over its whole range so that it wraps
    return C.unwrap_clock(t.v_chunks, "track_id", ["sequence"], "raw33", span_of("sequence", 1 << 20)).select(
        "track_id", "sequence", "unwrapped")


@query("ts02_unwrap_wrapping", """with b as (select track_id, sequence, (raw33*4099)%8589934592 as raw from v_chunks),
  p as (select *, raw-lag(raw) over (partition by track_id order by sequence) as d from b),
  e as (select *, sum(case when d<-4294967296 then 1 when d>4294967296 then -1 else 0 end) over (partition by track_id order by sequence) as epoch from p)
  select track_id, sequence, (raw+epoch*8589934592)::bigint as unwrapped from e""")
def ts02w(t):
    c = t.v_chunks.withColumn("raw", F.expr("(raw33*4099)%8589934592"))
    return C.unwrap_clock(c, "track_id", ["sequence"], "raw", span_of("sequence", 1 << 20)).select(
        "track_id", "sequence", "unwrapped")


@query("ts03_backfill", """with b as (select track_id, sequence, timestamp_us, case when sequence%2=0 then 0 else duration_us end as d,
   lead(timestamp_us) over (partition by track_id order by timestamp_us, sequence) as n from v_chunks)
  select track_id, sequence, case when d=0 and n is not null then greatest(0, n-timestamp_us) else d end as duration_us from b""")
def ts03(t):
    c = t.v_chunks.withColumn("duration_us", F.expr("case when sequence%2=0 then 0 else duration_us end"))
    return C.backfill_durations(c, "track_id", ["timestamp_us", "sequence"], "timestamp_us", "duration_us", t_span()).select(
        "track_id", "sequence", "duration_us")


@query("ts04_diagnostics", """select track_id as pid, count(*) as packets, count(*) filter (event_id%17=0) as transport_errors,
  count(*) filter (event_id%19=0) as scrambled, count(*) filter (is_key) as clock_rows from v_chunks group by 1""")
def ts04(t):
    flag = lambda c: F.count(F.when(c, 1))
    return t.v_chunks.groupBy(F.col("track_id").alias("pid")).agg(
        F.count("*").alias("packets"), flag(F.expr("event_id%17=0")).alias("transport_errors"),
        flag(F.expr("event_id%19=0")).alias("scrambled"), flag(F.col("is_key")).alias("clock_rows"))


# --- byte ranges ------------------------------------------------------------------------------------------------------

_MERGED = """r as (select * from v_ranges where len>0), m as (select *, max(off+len) over (partition by source_id order by off, idx rows between unbounded preceding and 1 preceding) as reach from r),
  i as (select *, sum(case when reach is null or off>reach+512 then 1 else 0 end) over (partition by source_id order by off, idx) as island from m),
  merged as (select source_id, island, min(off) as m_off, max(off+len)-min(off) as m_len, count(*) as members from i group by all)"""


@query("rng01_merge", f"with {_MERGED} select source_id, m_off, m_len, members from merged")
def rng01(t):
    return R.merge_ranges(t.v_ranges, gap=512).select("source_id", "m_off", "m_len", "members")


_MAXED = """r0 as (select source_id, off, len, idx, row_number() over (partition by source_id order by off, idx) as rn from v_ranges where len>0),
  g as (select source_id, rn, idx, off as m_off, off+len as m_end, off as head from r0 where rn=1
   union all select s.source_id, s.rn, s.idx, case when j then g.m_off else s.off end, case when j then greatest(g.m_end, s.off+s.len) else s.off+s.len end,
     case when j then g.head else s.off end
   from g join r0 s on s.source_id=g.source_id and s.rn=g.rn+1, lateral (select s.off<=g.m_end+512 and greatest(g.m_end, s.off+s.len)-g.m_off<=2048 as j)),
  h as (select *, sum(case when p is null or m_off<>p or m_end<pe then 1 else 0 end) over (partition by source_id order by rn) as grp from
    (select *, lag(m_off) over (partition by source_id order by rn) as p, lag(m_end) over (partition by source_id order by rn) as pe from g))"""


@query("rng01_merge_bounded", f"""with recursive {_MAXED} select source_id, m_off, max(m_end)-m_off as m_len, count(*) as members from h group by source_id, grp, m_off""")
def rng01b(t):
    return R.merge_ranges_bounded(t.v_ranges, 512, 2048).select("source_id", "m_off", "m_len", "members")


@query("rng02_assign", f"""with {_MERGED} select i.source_id, i.idx, m.m_off, i.off-m.m_off as local_offset from i join merged m using (source_id, island)""")
def rng02(t):
    return R.assign_holders(t.v_ranges, gap=512).select("source_id", "idx", "m_off", "local_offset")


@query("rng03_pages", """select source_id, idx, page, greatest(off, page*4096)-page*4096 as local_start, least(off+len,(page+1)*4096)-page*4096 as local_end from
  (select source_id, idx, off, len, unnest(generate_series(off//4096, (off+len-1)//4096)) as page from v_ranges where len>0)""")
def rng03(t):
    return R.page_slices(t.v_ranges, 4096)


@query("rng04_layout", """with p as (select doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id)::bigint as fin, source from documents),
  req as (select source, 10000*g as a, 10000*g+5000 as b from (select distinct source from documents), (select unnest([0,1,3]) as g))
  select req.source, req.a::bigint as req_start, p.doc_id, (greatest(a, fin-n_chars)-(fin-n_chars))::bigint as local_start, (least(b, fin)-(fin-n_chars))::bigint as local_end
  from req join p on p.source=req.source and p.fin>a and p.fin-n_chars<b and n_chars>0""")
def rng04(t):
    parts = t.documents.select("source", "doc_id", F.col("n_chars").alias("size"))
    laid = R.composite_layout(parts, "source", ["doc_id"], "size", span_of("doc_id", 1 << 20))
    req = t.documents.select("source").distinct().select(
        "source", F.explode(F.array(*[F.lit(10000 * g).cast("bigint") for g in (0, 1, 3)])).alias("req_start")).withColumn(
        "req_end", F.col("req_start") + 5000)
    return R.split_requests(laid, req, "source", 65536).select("source", "req_start", "doc_id", "local_start", "local_end")


@query("rng05_compact", """select source_id, idx, off as old_off, (sum(len) over (partition by source_id order by idx)-len)::bigint as new_off from v_ranges""")
def rng05(t):
    return R.compact_window(t.v_ranges, "source_id", ["idx"], "len", span_of("idx", 1 << 20)).select(
        "source_id", "idx", F.col("off").alias("old_off"), "new_off")


@query("rng06_amplification", """select l_suppkey as source_id, sum(cast(floor(l_extendedprice) as bigint))::bigint as bytes_read, sum(cast(l_quantity as bigint)*700)::bigint as consumed,
  round(sum(cast(floor(l_extendedprice) as bigint))/sum(cast(l_quantity as bigint)*700),6) as ratio,
  greatest(0, sum(cast(floor(l_extendedprice) as bigint))-sum(cast(l_quantity as bigint)*700))::bigint as overhead from lineitem group by 1""")
def rng06(t):
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("source_id")).agg(
        F.sum(F.floor("l_extendedprice").cast("bigint")).alias("bytes_read"),
        F.sum(F.col("l_quantity").cast("bigint") * 700).alias("consumed"))
    return R.read_amplification(c, "bytes_read", "consumed").withColumn("ratio", F.round("ratio", 6))
