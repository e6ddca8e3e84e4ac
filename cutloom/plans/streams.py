"""Streaming queries, run to the end of what is available and compared with their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import oplog as O
from ..sources.tables import EPOCH_US
from ..streaming import processors as P, stateful as S, stores as K
from ..streaming.sources import events_stream
from .registry import query

_US = f"unix_micros(at) - {EPOCH_US}"


def events_of(t):
    return events_stream(t.spark, f"{t.folder}/events.parquet")


@query("str01_duplicates", "select distinct user_id as actor_id, event_type as purpose, event_id%40 as nonce from events")
def str01(t):
    e = events_of(t).select(F.col("user_id").alias("actor_id"), F.col("event_type").alias("purpose"), (F.col("event_id") % 40).alias("nonce"), "at")
    out = S.suppress_duplicates(e, ["actor_id", "purpose", "nonce"], "at", "60 days")
    return K.run_to_table(out.drop("at"), "str01")


@query("str02_window", """select user_id as stream_id, event_id%60 as sequence, event_id%3=0 as partial, 'u'||(event_id%4) as url, max(event_id) as version from events where event_id%60>=user_id%20 group by all""")
def str02(t):
    e = events_of(t).select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 60).alias("sequence"), (F.col("event_id") % 3 == 0).alias("partial"), F.concat(F.lit("u"), F.col("event_id") % 4).alias("url"),
                            (F.col("event_id") % 60 * 4).cast("double").alias("start"), F.lit(4.0).alias("duration"), F.col("event_id").alias("version"))
    streams = t.events.select(F.col("user_id").alias("stream_id")).distinct().withColumn("first_sequence", F.col("stream_id") % 20)
    folder = K.new_folder(t.spark, "str02")
    K.keep_windows(e, streams, f"{folder}/store", f"{folder}/checkpoint", 8).awaitTermination()
    return K.read_store(t.spark, f"{folder}/store", K.SEGMENT_SCHEMA).select("stream_id", "sequence", "partial", "url", "version")


@query("str03_correlate", """with x as (select source_key%200 as k, stage, at_ms, event_id, coalesce(sum(case when stage='output' then 1 else 0 end) over (partition by source_key%200 order by at_ms, event_id rows between unbounded preceding and 1 preceding),0)::bigint as record from v_stages),
  rec as (select k, record, min(at_ms) filter (stage='source') as source_at, max(at_ms) filter (stage='submitted') as submitted_at, max(at_ms) filter (stage='decoded') as decoded_at, max(at_ms) filter (stage='output') as output_at from x group by all) select * from rec where output_at is not null""")
def str03(t):
    e = events_of(t).selectExpr("(event_id div 5)%200 as k", "case event_id%5 when 1 then 'submitted' when 2 then 'decoded' when 3 then 'output' else 'source' end as stage",
                                "cast(unix_micros(at) as double)/1000 as at_ms", "event_id", "at")
    out = K.run_to_table(S.correlate(e, ["k"], "at_ms", "event_id", "at", "60 days"), "str03")
    return out.where("not evicted").drop("evicted")


_TRACK = """epoch_ms(ts) as ms, user_id as session, 'm'||((event_id*7)%9) as key, case event_type when 'view' then 'source' when 'signup' then 'source' when 'click' then 'submitted' when 'error' then 'decoded' else 'output' end as stage from events"""


@query("str03_tracker", f"""with recursive e as (select *, row_number() over (partition by session order by event_id) as n from (select event_id, epoch_us(ts)/1000.0::double as at_ms, {_TRACK})),
  s as (select session, 0::bigint as n, 0::bigint as records, 0::bigint as evicted, []::struct(key varchar, record bigint, src double, sub double, decd double, ms bigint)[] as held,
      null::struct(key varchar, record bigint, src double, sub double, decd double, ms bigint) as gone, null::varchar as reason, null::double as output_at from e group by 1
    union all select session, n, case when was is null then records+1 else records end, evicted+case when stage<>'output' and len(now_)>4 then 1 else 0 end,
      case when stage='output' then rest when len(now_)>4 then now_[2:] else now_ end, case when stage='output' then coalesce(was, {{'key': key, 'record': records, 'src': null, 'sub': null, 'decd': null, 'ms': null}}) when len(now_)>4 then now_[1] end,
      case when stage='output' then 'output' when len(now_)>4 then 'cap' end, case when stage='output' then at_ms end
    from (select *, case when was is null then held||[r] else list_transform(held, lambda x: case when x.key=key then r else x end) end as now_ from
      (select *, {{'key': key, 'record': coalesce(was.record, records), 'src': case when stage='source' then coalesce(was.src, at_ms) else was.src end, 'sub': case when stage='submitted' then at_ms else was.sub end,
                  'decd': case when stage='decoded' then at_ms else was.decd end, 'ms': ms}} as r from
        (select e.*, s.records, s.evicted, s.held, list_filter(s.held, lambda x: x.key=e.key)[1] as was, list_filter(s.held, lambda x: x.key<>e.key) as rest from s join e on e.session=s.session and e.n=s.n+1)))),
  w as (select max(ms)-600000 as at from e), z as (select session, arg_max(held, n) as held, arg_max(evicted, n) as evicted from s group by 1),
  a as (select session, evicted, held, list_filter(held, lambda x: x.ms+86400000<=w.at) as old from z, w)
  select session, gone.key as key, gone.record as record, reason, gone.src as source_at, gone.sub as submitted_at, gone.decd as decoded_at, output_at, evicted, len(held) as open from s where reason is not null
  union all select session, old[i].key, old[i].record, 'age', old[i].src, old[i].sub, old[i].decd, null, evicted+i, len(held)-i from a, unnest(range(1, len(old)+1)) as u(i)""")
def str03t(t):
    e = events_of(t).selectExpr("user_id as session", "concat('m', (event_id*7)%9) as key", "event_id", "at", "cast(unix_micros(at) as double)/1000 as at_ms",
                                "case event_type when 'view' then 'source' when 'signup' then 'source' when 'click' then 'submitted' when 'error' then 'decoded' else 'output' end as stage")
    out = K.run_to_table(P.track_stages(e, ["session"], ["event_id"], time="at", cap=4, keep="1 days", idle="2 days"), "str03t")
    return out.drop("late")


_DL = "d as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n, greatest(1, value*100000*8/greatest(0.001, event_id%7*0.25::double)) as bps from events)"


@query("str04_throughput", f"""with recursive {_DL}, e as (select user_id, event_id, n, 4e6::double+(bps-4e6)*(1-pow(0.5::double,1/3.0::double)) as fast, 4e6::double+(bps-4e6)*(1-pow(0.5::double,1/10.0::double)) as slow from d where n=1
  union all select d.user_id, d.event_id, d.n, e.fast+(d.bps-e.fast)*(1-pow(0.5::double,1/3.0::double)), e.slow+(d.bps-e.slow)*(1-pow(0.5::double,1/10.0::double)) from e join d on d.user_id=e.user_id and d.n=e.n+1)
  select event_id, round(least(fast,slow)/1e6::double,4) as estimate_mbps, false as late from e""")
def str04(t):
    d = events_of(t).select("user_id", "event_id", F.expr(f"{_US} as at_us"), (F.col("value") * 100000).alias("bytes"), (F.col("event_id") % 7 * 0.25).alias("seconds"), "at")
    out = K.run_to_table(S.throughput(d, "user_id", ["at_us", "event_id"], ["event_id"], initial=4e6, time="at"), "str04")
    return out.select("event_id", F.round(F.col("estimate") / 1e6, 4).alias("estimate_mbps"), "late")


@query("str05_quarantine", """with att as (select user_id as backend_id, event_id, epoch_us(ts)//1000 as at_, case when event_id%7<4 then 'failure' when event_type='view' then 'success' else 'unsupported' end as result from events),
  c as (select *, sum(case when result='failure' then 1 else 0 end) over w as f from att window w as (partition by backend_id order by at_, event_id)), d as (select *, f-coalesce(last_value(case when result='success' then f end ignore nulls) over (partition by backend_id order by at_, event_id),0) as consecutive from c),
  m as (select *, case when result='success' then 0 when result='failure' then case when consecutive>=3 then at_+40000000 else 0 end end as mark from d)
  select event_id, consecutive::bigint as consecutive, coalesce(last_value(mark ignore nulls) over w,0)::bigint as until from m window w as (partition by backend_id order by at_, event_id)""")
def str05(t):
    a = events_of(t).selectExpr("user_id as backend_id", "event_id", "unix_micros(at) div 1000 as at_ms", "case when event_id%7<4 then 'failure' when event_type='view' then 'success' else 'unsupported' end as result", "at as event_time").withColumn("at", F.col("at_ms"))
    out = K.run_to_table(S.quarantine(a, ["at_ms", "event_id"], ["event_id"], 3, 40_000_000, "event_time"), "str05")
    return out.select("event_id", "consecutive", "until")


@query("str05_job_states", """with recursive e as (select user_id as chunk, event_id, row_number() over (partition by user_id order by event_id) as n,
    case event_type when 'view' then 'claim' when 'signup' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'release' end as event from events),
  s as (select chunk, 0::bigint as n, null::bigint as event_id, 'pending' as status, 0::bigint as attempts, true as legal from e group by 1
    union all select e.chunk, e.n, e.event_id,
      case when event='claim' and (s.status='pending' or (s.status='failed' and s.attempts<3)) then 'running' when s.status<>'running' or event='claim' then s.status
           when event='complete' then 'complete' when event='fail' then case when s.attempts<3 then 'pending' else 'failed' end else 'pending' end,
      case when event='claim' and (s.status='pending' or (s.status='failed' and s.attempts<3)) then s.attempts+1 when event='release' and s.status='running' then greatest(0, s.attempts-1) else s.attempts end,
      case when event='claim' then s.status='pending' or (s.status='failed' and s.attempts<3) else s.status='running' end
    from s join e on e.chunk=s.chunk and e.n=s.n+1)
  select event_id, chunk, status, attempts, legal, false as late from s where n>0""")
def str05j(t):
    e = events_of(t).select(F.col("user_id").alias("chunk"), "event_id", "at", F.expr("case event_type when 'view' then 'claim' when 'signup' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'release' end as event"))
    out = K.run_to_table(S.job_states(e, ["chunk"], ["event_id"], ["event_id"], time="at"), "str05j")
    return out.select("event_id", "chunk", "status", "attempts", "legal", "late")


@query("str06_transport", """with p as (select user_id as pid, event_id, event_id%16 as counter, (event_id*104729*4099)%8589934592 as raw from events), x as (select *, lag(counter) over w as pc, raw-lag(raw) over w as d from p window w as (partition by pid order by event_id)),
  e as (select *, sum(case when d<-4294967296 then 1 when d>4294967296 then -1 else 0 end) over (partition by pid order by event_id) as epoch from x) select event_id, case when pc is not null and counter<>(pc+1)%16 then (pc+1)%16 end as expected, (raw+epoch*8589934592)::bigint as unwrapped from e""")
def str06(t):
    p = events_of(t).selectExpr("user_id as pid", "event_id", "event_id%16 as counter", "(event_id*104729*4099)%8589934592 as raw", "true as has_payload", "false as discontinuity", "at")
    out = K.run_to_table(S.transport(p, "pid", ["event_id"], ["event_id"], "at"), "str06")
    return out.select("event_id", "expected", "unwrapped")


@query("str07_state", """with o as (select user_id as project_id, event_id as seq, case event_type when 'signup' then 'node.add' when 'error' then 'node.remove' else 'node.update' end as op_type, event_id%20 as entity_id, 'p'||(event_id%4) as prop, value from events),
  life as (select project_id, entity_id, max(seq) as born, arg_max(op_type, seq) as ty from o where op_type<>'node.update' group by all)
  select w.project_id, w.entity_id, w.prop, arg_max(w.value, w.seq) as value from o w join life l on l.project_id=w.project_id and l.entity_id=w.entity_id and l.ty='node.add' where w.op_type<>'node.remove' and w.seq>=l.born group by all""")
def str07(t):
    ops = events_of(t).selectExpr("user_id as project_id", "event_id%20 as entity_id", "event_id as seq", "case event_type when 'signup' then 'node.add' when 'error' then 'node.remove' else 'node.update' end as op_type",
                                  "concat('p', event_id%4) as prop", "value")
    folder = K.new_folder(t.spark, "str07")
    K.materialise_changes(ops, f"{folder}/store", f"{folder}/checkpoint", 8).awaitTermination()
    return O.replay_nodes(K.read_store(t.spark, f"{folder}/store", K.OPS_SCHEMA))


@query("str07_edges", """with o as (select user_id as project_id, event_id as seq, event_id%20 as entity_id, (event_id%20+event_id%7)%20 as other_id, event_id%30 as edge_id, case when event_type='signup' then 'node.add' when event_type='error' and event_id%3=0 then 'node.remove' when event_type='click' then 'edge.remove' when event_type='view' then 'node.update' else 'edge.add' end as op_type from events),
  l as (select project_id, edge_id, max(seq) as seq, arg_max(op_type, seq) as ty, arg_max(entity_id, seq) as src, arg_max(other_id, seq) as dst from o where op_type in ('edge.add','edge.remove') group by all)
  select project_id, edge_id, src, dst from l where ty='edge.add' and not exists (select 1 from o r where r.project_id=l.project_id and r.op_type='node.remove' and r.entity_id in (l.src, l.dst) and r.seq>l.seq)""")
def str07e(t):
    ops = events_of(t).selectExpr("user_id as project_id", "event_id%20 as entity_id", "(event_id%20+event_id%7)%20 as other_id", "event_id%30 as edge_id", "event_id as seq", "case when event_type='signup' then 'node.add' when event_type='error' and event_id%3=0 then 'node.remove' when event_type='click' then 'edge.remove' when event_type='view' then 'node.update' else 'edge.add' end as op_type",
                                  "concat('p', event_id%4) as prop", "value")
    folder = K.new_folder(t.spark, "str07e")
    K.materialise_changes(ops, f"{folder}/store", f"{folder}/checkpoint", 8).awaitTermination()
    return O.replay_edges(K.read_store(t.spark, f"{folder}/store", K.OPS_SCHEMA))


_LIVE = """user_id as track_id, case event_type when 'purchase' then 'through' when 'error' then 'one' else 'chunk' end as kind, event_id//450*1000+(event_id*13)%5*250 as "offset", 100+(event_id%2)*100 as size from events"""


@query("str08_live_index", f"""with recursive e as (select *, row_number() over (partition by track_id order by event_id) as n, {{'o': "offset", 'e': "offset"+size}} as c from (select event_id, {_LIVE})),
  s as (select track_id, 0::bigint as n, null::bigint as event_id, []::struct(o bigint, e bigint)[] as held, false as is_new, 0::bigint as acked, 0::bigint as total, 0::bigint as acked_total, 0::bigint as cursor, 0::bigint as safe from e group by 1
    union all select track_id, n, event_id, now_, is_new, len(held)-len(now_)+is_new::bigint, total+is_new::bigint, acked_total+len(held)-len(now_)+is_new::bigint, cur, case when kind='chunk' then safe else greatest(safe, least(coalesce(list_min(list_transform(now_, lambda x: x.o)), cur), cur)) end
    from (select *, case when is_new then greatest(cursor, c.e) else cursor end as cur, case when is_new then held||[c] when kind='one' then list_filter(held, lambda x: x<>c) when kind='through' then list_filter(held, lambda x: x.e>c.o) else held end as now_ from
      (select e.*, s.held, s.total, s.acked_total, s.cursor, s.safe, e.kind='chunk' and e.c.e>s.safe and not list_contains(s.held, e.c) as is_new from s join e on e.track_id=s.track_id and e.n=s.n+1)))
  select track_id, event_id, is_new, acked, len(held) as pending, total, acked_total, safe from s where n>0""")
def str08(t):
    e = events_of(t).selectExpr("user_id as track_id", "event_id", "at", "case event_type when 'purchase' then 'through' when 'error' then 'one' else 'chunk' end as kind",
                                "event_id div 450*1000+(event_id*13)%5*250 as offset", "100+(event_id%2)*100 as size")
    out = K.run_to_table(P.live_index(e, ["track_id"], ["event_id"], ["event_id"], time="at", idle="30 days", range_bytes=4000), "str08")
    return out.drop("late")


_DIST = "list_sort(list(ms))[(ceil((count(*)-1)*{p}))::int+1]"


@query("str09_latency", f"""with c as (select epoch_us(time_bucket(interval '1 day', ts, timestamp '1970-01-01')) as window_us, event_type, round(value)::bigint as ms from events)
  select window_us, event_type, count(*) as count, min(ms) as min, {_DIST.format(p=.5)} as p50, {_DIST.format(p=.95)} as p95, max(ms) as max from c group by all""")
def str09(t):
    folder = K.new_folder(t.spark, "str09")
    cells = S.latency_cells(events_of(t), "at", "value", "1 day", groups=["event_type"])

    def sink(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/cells")

    # complete counts of every window after the last batch: the newest batch holds them all
    cells.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    c = t.spark.read.parquet(f"{folder}/cells")
    newest = c.agg(F.max("batch").alias("batch"))
    return S.distribution_of_cells(c.join(F.broadcast(newest), "batch"), ["window_us", "event_type"])


@query("str09_sessions", """with x as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts)>ts-interval '6 hours' then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by ts) as sid from x)
  select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)+interval '6 hours') as end_us, count(*) as events from s group by user_id, sid having max(ts)+interval '6 hours' <= (select max(ts) - interval '10 minutes' from events)""")
def str09s(t):
    """Sessions closed by the watermark: those that end at least the allowed delay before the newest event."""
    return K.run_to_table(S.sessions(events_of(t), "user_id", "at", "6 hours"), "str09s")
