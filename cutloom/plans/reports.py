"""Report, history and latency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latency as L, reports as R
from ..operators.scan import span_of
from .registry import query

METRICS = ["index_ms", "read_amplification"]
_LONG = """long as (select kind, 'index_ms' as metric, index_ms as value from v_runs where status<>'skipped'
  union all select kind, 'read_amplification', read_amplification from v_runs where status<>'skipped')"""
_SUM = """count(value) as count, min(value) as min, max(value) as max, round(avg(value),6) as mean, round(quantile_cont(value,0.5),6) as p50,
  round(quantile_cont(value,0.95),6) as p95, round(quantile_cont(value,0.99),6) as p99"""


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("perf01_percentile", "select kind, round(quantile_cont(index_ms,0.5),6) as p50, round(quantile_cont(index_ms,0.9),6) as p90, round(quantile_cont(index_ms,0.01),6) as p01 from v_runs group by kind")
def perf01(t):
    from ..operators.quantiles import exact_quantiles
    return rounded(exact_quantiles(t.v_runs, ["kind"], "index_ms", {"p50": .5, "p90": .9, "p01": .01}), "p50", "p90", "p01")


@query("perf02_summary", f"""select l_returnflag, l_linestatus, {_SUM.replace('value', 'l_extendedprice')} from lineitem group by all""")
def perf02(t):
    return rounded(R.summarize(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"), "mean", "p50", "p95", "p99")


@query("perf03_report", f"""with {_LONG} select '*' as kind, metric, {_SUM} from long group by metric
  union all select kind, metric, {_SUM} from long group by kind, metric""")
def perf03(t):
    return rounded(R.performance_report(t.v_runs, METRICS), "mean", "p50", "p95", "p99")


@query("perf03_status", """select count(*) as total, count(*) filter (status<>'skipped') as executed, count(*) filter (status='passed') as passed,
  count(*) filter (status='failed') as failed, count(*) filter (status='skipped') as skipped from v_runs""")
def perf03s(t):
    return R.status_counts(t.v_runs)


@query("perf04_compare", """with s as (select at_us<1296000000000 as base, 'index_ms' as metric, index_ms as v from v_runs where status<>'skipped'
   union all select at_us<1296000000000, 'read_amplification', read_amplification from v_runs where status<>'skipped'
   union all select at_us<1296000000000, 'hit', 1/(1+index_ms) from v_runs where status<>'skipped'),
  q as (select metric, base, quantile_cont(v,0.5) as p50, quantile_cont(v,0.95) as p95 from s group by all),
  j as (select c.metric, case when c.metric='hit' then 'min' else 'max' end as direction, case when c.metric='hit' then c.p50 else c.p95 end as cur,
    case when c.metric='hit' then b.p50 else b.p95 end as bas from q c join q b on b.metric=c.metric and b.base and not c.base)
  select metric, direction, round(cur,6) as current, round(bas,6) as baseline,
   round(case when direction='min' then bas-cur else cur-bas end/abs(bas),6) as regression,
   case when direction='min' then bas-cur else cur-bas end/abs(bas)<=0.15 as pass from j""")
def perf04(t):
    runs = t.v_runs.where("status <> 'skipped'").withColumn("hit", 1 / (1 + F.col("index_ms")))
    ms = [*METRICS, "hit"]
    side = lambda cond: R.exact_quantiles(R.unpivot(runs.where(cond), [], ms), ["metric"], "value", {"p50": .5, "p95": .95})
    out = R.compare_reports(side("at_us >= 1296000000000"), side("at_us < 1296000000000"), METRICS, ["hit"])
    return rounded(out, "current", "baseline", "regression")


@query("perf05_retention", """select run_id, environment from (select run_id, environment, row_number() over (partition by environment order by at_us desc, run_id desc) as rn from v_runs) where rn<=50""")
def perf05(t):
    return R.retain_history(t.v_runs, "environment", ["at_us", "run_id"]).select("run_id", "environment")


@query("perf05_environment_key", """select concat_ws('|', regexp_replace(lower(trim(p_name)),'\\s+','-','g'), regexp_replace(lower(trim(p_brand)),'\\s+','-','g'),
  regexp_replace(lower(trim(p_type)),'\\s+','-','g'), p_size::varchar) as environment, count(*) as parts from part group by 1""")
def perf05k(t):
    return t.part.groupBy(R.environment_key(["p_name", "p_brand", "p_type", "p_size"]).alias("environment")).agg(
        F.count("*").alias("parts"))


_TREND = """l as (select environment, 'index_ms' as metric, index_ms as v, at_us, run_id from v_runs union all select environment, 'read_amplification', read_amplification, at_us, run_id from v_runs),
  r as (select *, row_number() over (partition by environment, metric order by at_us desc, run_id desc) as rn, count(*) over (partition by environment, metric) as samples from l),
  tr as (select environment, metric, any_value(samples) as samples, max(v) filter (rn=1) as current, coalesce(avg(v) filter (rn>1), max(v) filter (rn=1)) as baseline from r where rn<=6 group by all),
  td as (select *, (current-baseline)/baseline as change from tr)"""


@query("perf06_trend", f"""with {_TREND} select environment, metric, samples, round(current,6) as current, round(baseline,6) as baseline, round(change,6) as change,
  case when abs(change)<0.02 then 'flat' when change>0 then 'up' else 'down' end as direction from td""")
def perf06(t):
    long = R.unpivot(t.v_runs, ["environment", "at_us", "run_id"], METRICS)
    return rounded(R.metric_trend(long, ["environment", "metric"], ["at_us", "run_id"]), "current", "baseline", "change")


_BUD = "(values ('index_ms', 60.0::double, 5.0::double, 0.2::double), ('read_amplification', 20.0, 1.0, 0.15)) b(metric, mx, mn, rg)"


@query("perf07_budgets", f"""with {_TREND} select environment, td.metric, 'max' as type, round(current,6) as actual, mx as lim from td join {_BUD} on b.metric=td.metric where current>mx
  union all select environment, td.metric, 'min', round(current,6), mn from td join {_BUD} on b.metric=td.metric where current<mn
  union all select environment, td.metric, 'regression', round(change,6), rg from td join {_BUD} on b.metric=td.metric where change>rg""")
def perf07(t):
    long = R.unpivot(t.v_runs, ["environment", "at_us", "run_id"], METRICS)
    trends = R.metric_trend(long, ["environment", "metric"], ["at_us", "run_id"])
    budgets = t.spark.createDataFrame([("index_ms", 60.0, 5.0, .2), ("read_amplification", 20.0, 1.0, .15)],
                                      "metric string, max double, min double, max_regression double")
    return R.budget_violations(trends, budgets).select("environment", "metric", "type", F.round("actual", 6).alias("actual"),
                                                       F.col("limit").alias("lim"))


@query("perf08_run_budget", """select run_id, 'read_amplification' as name, read_amplification as value, 3.0::double as lim, 'max' as direction, read_amplification<=3 as pass from v_runs
  union all select run_id, 'index_ms', index_ms, 100.0, 'max', index_ms<=100 from v_runs""")
def perf08(t):
    return R.run_budgets(t.v_runs, ["run_id"], {"index_ms": 100.0}).withColumnRenamed("limit", "lim")


_CNT = "event_id%5000 as source_bytes_read, event_id%3000 as encoded_bytes_consumed, event_id%7 as frame_requests, event_id%3 as frame_cache_hits, event_id%4 as stale_frames, event_id%9 as presented_frames, event_id%2 as dropped_frames, value as decode_ms, value/2 as decoded_seconds"


@query("perf09_counters", f"""with c as (select user_id, {_CNT} from events), s as (select user_id, sum(source_bytes_read) a, sum(encoded_bytes_consumed) b, sum(frame_requests) fr, sum(frame_cache_hits) fh, sum(stale_frames) sf, sum(presented_frames) pf, sum(dropped_frames) df, sum(decode_ms) dm, sum(decoded_seconds) ds from c group by 1)
  select user_id, a::bigint as source_bytes_read, round(case when b>0 then a/b when a>0 then 'inf'::double else 1.0::double end,6) as read_amplification, round(case when ds>0 then dm/ds else 0 end,6) as decode_ms_per_second,
   round(case when fr>0 then fh/fr else 0::double end,6) as frame_cache_hit_ratio, round(case when pf+sf>0 then sf/(pf+sf) else 0::double end,6) as stale_frame_ratio,
   round(case when pf+df>0 then df/(pf+df) else 0::double end,6) as dropped_frame_ratio from s""")
def perf09(t):
    c = t.events.selectExpr("user_id", *_CNT.split(", "))
    cols = ["read_amplification", "decode_ms_per_second", "frame_cache_hit_ratio", "stale_frame_ratio", "dropped_frame_ratio"]
    return rounded(R.counter_snapshot(c, ["user_id"]), *cols).select("user_id", "source_bytes_read", *cols)


@query("perf10_expectations", """with j as (select d.doc_id, d.lang, d.n_chars, d.source, l.quality, case when d.doc_id%2=0 then 'en' end as e_lang, 2000 as e_chars, 1 as e_quality, 'src1' as e_prefix
   from documents d left join labels l using (doc_id))
  select doc_id, 'lang' as type, e_lang as expected, lang as actual from j where e_lang is not null and e_lang<>lang
  union all select doc_id, 'quality', '1', quality::varchar from j where quality is null or quality<>1
  union all select doc_id, 'n_chars', '2000', n_chars::varchar from j where abs(n_chars-2000)>1500
  union all select doc_id, 'source', 'src1', source from j where not starts_with(source, 'src1')""")
def perf10(t):
    j = t.documents.drop("text").join(t.labels.drop("toxic"), "doc_id", "left").withColumn(
        "e_lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("e_chars", F.lit(2000)).withColumn(
        "e_quality", F.lit(1)).withColumn("e_prefix", F.lit("src1"))
    return R.expectation_violations(j, "doc_id", {"e_lang": "lang", "e_quality": "quality"}, {"e_chars": ("n_chars", 1500)},
                                    {"e_prefix": "source"})


@query("perf11_run_summary", """select status, count(*) as runs, round(sum(index_ms),4) as duration_ms from v_runs group by status""")
def perf11(t):
    return t.v_runs.groupBy("status").agg(F.count("*").alias("runs"), F.round(F.sum("index_ms"), 4).alias("duration_ms"))


@query("dq07_manifest", """with m as (select url, page_id, case when page_id%5=0 then 'stream' when page_id%5=1 then 'camera' when page_id%5=2 then 'audio' when page_id%5=3 then 'book' end as kind, case when page_id%9=0 then '' else url end as loc from pages)
  select url as id, 'kind-unsupported' as code from m where kind is null or kind='book' union all select url, 'location-required' from m where loc=''
  union all select url, 'id-required' from m where url='' union all select url, 'id-duplicate' from m group by url having count(*)>1""")
def dq07(t):
    kind = F.when(F.col("page_id") % 5 == 0, "stream").when(F.col("page_id") % 5 == 1, "camera").when(
        F.col("page_id") % 5 == 2, "audio").when(F.col("page_id") % 5 == 3, "book")
    m = t.pages.select("url", kind.alias("kind"), F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("url")).alias("loc"))
    kinds = ["camera", "screen-recording", "generated", "stream", "audio", "image-sequence"]
    return R.manifest_violations(m, "url", "kind", kinds, ["loc"])


# --- latency ----------------------------------------------------------------------------------------------------------

_REC = """x as (select source_key%200 as k, stage, at_ms, event_id, coalesce(sum(case when stage='output' then 1 else 0 end) over (partition by source_key%200 order by at_ms, event_id rows between unbounded preceding and 1 preceding),0)::bigint as record from v_stages),
  rec as (select k, record, min(at_ms) filter (stage='source') as source_at, max(at_ms) filter (stage='submitted') as submitted_at, max(at_ms) filter (stage='decoded') as decoded_at, max(at_ms) filter (stage='output') as output_at from x group by all),
  dur as (select k, record, round(submitted_at-source_at,3) as source_to_submit_ms, round(decoded_at-submitted_at,3) as submit_to_decode_ms, round(output_at-decoded_at,3) as decode_to_output_ms, round(output_at-source_at,3) as source_to_output_ms from rec where output_at is not null)"""
STAGES = ["source_to_submit_ms", "submit_to_decode_ms", "decode_to_output_ms", "source_to_output_ms"]


def records_of(t):
    s = t.v_stages.withColumn("k", F.col("source_key") % 200)
    return L.correlate(s, ["k"], "at_ms", "event_id", span_of("at_ms", 86400e3))


def durations_of(t):
    d = L.stage_durations(records_of(t))
    for c in STAGES:
        d = d.withColumn(c, F.round(c, 3))
    return d.select("k", "record", *STAGES)


@query("lat01_correlate", f"with {_REC} select * from rec")
def lat01(t):
    return records_of(t)


@query("lat02_durations", f"with {_REC} select * from dur")
def lat02(t):
    return durations_of(t)


def _nearest(p):
    return f"list_sort(list(value))[(ceil((count(value)-1)*{p}))::int+1]"


_DIST = f"""{_REC}, lg as (select '{STAGES[0]}' as metric, {STAGES[0]} as value from dur {' '.join(f"union all select '{s}', {s} from dur" for s in STAGES[1:])}),
  dist as (select metric, count(value) as count, min(value) as min, max(value) as max, {_nearest(.5)} as p50, {_nearest(.95)} as p95 from lg where value is not null group by metric)"""


@query("lat03_distribution", f"with {_DIST} select * from dist")
def lat03(t):
    return L.distribution(R.unpivot(durations_of(t), [], STAGES), ["metric"], "value")


_LIVE = "select event_id, event_id%100*0.1::double as playhead, case when event_id%7<>0 then event_id%100*0.1::double+value/10 end as edge, event_id%100*0.1::double+value/20 as now, event_id%100*0.1::double+1.5::double as pos, 2.0::double as target from events"


def live_of(t):
    p = F.col("event_id") % 100 * F.lit(0.1)
    return t.events.select("event_id", p.alias("playhead"), F.when(F.col("event_id") % 7 != 0, p + F.col("value") / 10).alias("edge"),
                           (p + F.col("value") / 20).alias("now"), (p + 1.5).alias("pos"), F.lit(2.0).alias("target"))


@query("lat04_live", f"with l as ({_LIVE}) select event_id, round((edge-playhead)*1000,3) as edge_ms, round((now-playhead)*1000,3) as presentation_ms, round((pos-playhead)*1000,3) as position_error_ms, round(((now-playhead)-target)*1000,3) as target_error_ms from l")
def lat04(t):
    d = L.live_distances(live_of(t), "playhead", "edge", "now", "pos", "target")
    cols = ["edge_ms", "presentation_ms", "position_error_ms", "target_error_ms"]
    return d.select("event_id", *[F.round(c, 3).alias(c) for c in cols])


@query("lat05_budgets", f"""with {_DIST}, b as (select metric, case when metric<>'submit_to_decode_ms' then p95<=6e8 end as p95_ok, case when metric like 'source%' then p50<=5e8 end as p50_ok from dist)
  select metric, p95_ok, p50_ok, case when p95_ok is null and p50_ok is null then null else coalesce(p95_ok,true) and coalesce(p50_ok,true) end as pass from b""")
def lat05(t):
    d = L.distribution(R.unpivot(durations_of(t), [], STAGES), ["metric"], "value")
    d = d.withColumn("b95", F.when(F.col("metric") != "submit_to_decode_ms", F.col("p95"))).withColumn(
        "b50", F.when(F.col("metric").startswith("source"), F.col("p50")))
    return L.judge(d, {"p95_ok": ("b95", 6e8, False), "p50_ok": ("b50", 5e8, False)}).select("metric", "p95_ok", "p50_ok", "pass")
