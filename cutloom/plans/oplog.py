"""Operation-log, conflict and trust queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import conflicts as C, graph as G, invariants as I, oplog as O, trust as T
from ..operators.scan import span_of, span_scan
from ..session import durable
from ..sources.tables import micros
from .registry import query



def seq_span():
    return span_of("seq", 1 << 20)



def ops_of(t):
    return t.v_ops.withColumn("other_id", (F.col("entity_id") + 7) % 20).withColumn("op_idx", F.lit(0)).withColumn(
        "payload", F.concat_ws(":", "tx_id", "op_type", "entity_id", "prop")).withColumn("edge_id", F.col("tx_id"))


def edge_ops_of(t):
    """The log with edges removed again, edges added twice under one id, and now and then an unknown kind of op."""
    x = span_scan(ops_of(t), ["project_id"], ["seq"], seq_span(), __e=("prev", F.when(F.col("op_type") == "edge.add", F.col("tx_id"))))
    kind = F.expr("case when op_type='node.update' and tx_id%3=0 and __e is not null then 'edge.remove' when tx_id%997=0 then 'node.paint' else op_type end")
    old = F.expr("__e is not null and ((op_type='node.update' and tx_id%3=0) or (op_type='edge.add' and tx_id%5=0))")
    return x.withColumn("edge_id", F.when(old, F.col("__e")).otherwise(F.col("tx_id"))).withColumn("op_type", kind).drop("__e")


_EDGE_OPS = """eo0 as (select *, (entity_id+7)%20 as other_id, last_value(case when op_type='edge.add' then tx_id end ignore nulls) over (partition by project_id order by seq rows between unbounded preceding and 1 preceding) as e from v_ops),
  eo as (select project_id, seq, tx_id, entity_id, other_id, case when op_type='node.update' and tx_id%3=0 and e is not null then 'edge.remove' when tx_id%997=0 then 'node.paint' else op_type end as op_type,
    case when e is not null and ((op_type='node.update' and tx_id%3=0) or (op_type='edge.add' and tx_id%5=0)) then e else tx_id end as edge_id from eo0)"""


_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, flatten(list_transform(string_split(props,''), lambda c: [ascii(c)::uhugeint, 0::uhugeint]))), lambda h, b: (xor(h,b)*1099511628211::uhugeint) % 18446744073709551616::uhugeint)"


@query("lg01_checksum", f"select event_id, lpad(lower(hex(({_FNV})::ubigint)),16,'0') as checksum from (select event_id, replace(props, ' ', '') as props from events)")
def lg01(t):
    return t.events.select("event_id", H.fnv64(H.canonical_json("props")).alias("checksum"))


_UNITS = "list_reduce(list_prepend({0}::uhugeint, list_transform(string_split(props,''), lambda c: ascii(c)::uhugeint)), lambda h, b: (xor(h,b)*{1}::uhugeint) % {2}::uhugeint)"
_U64, U32 = _UNITS.format(14695981039346656037, 1099511628211, 1 << 64), _UNITS.format(2166136261, 16777619, 1 << 32)


@query("lg01_variants", f"select event_id, lpad(lower(hex(({_U64})::ubigint)),16,'0') as units, lpad(lower(hex(({U32})::ubigint)),8,'0') as short from (select event_id, replace(props, ' ', '') as props from events)")
def lg01v(t):
    c = H.canonical_json("props")
    return t.events.select("event_id", H.fnv64_units(c).alias("units"), H.fnv32(c).alias("short"))


_CHAIN = """o as (select *, (entity_id+7)%20 as other_id, concat_ws(':', tx_id, op_type, entity_id, prop) as payload from v_ops),
  ch as (select project_id, seq, tx_id, payload, null::varchar as previous, sha256('|'||seq||'|'||payload) as checksum from o where seq=1
   union all select o.project_id, o.seq, o.tx_id, o.payload, ch.checksum, sha256(ch.checksum||'|'||o.seq||'|'||o.payload) from ch join o on o.project_id=ch.project_id and o.seq=ch.seq+1)"""


@query("lg02_append", f"with recursive {_CHAIN} select project_id, seq, previous, checksum from ch")
def lg02(t):
    return O.append_chain(ops_of(t).select("project_id", "seq", "tx_id", "payload")).select("project_id", "seq", "previous", "checksum")


_TAMPER = "ta as (select project_id, case when tx_id%89=0 then seq+1 else seq end as seq, tx_id, case when tx_id%31=0 then payload||'x' else payload end as payload, case when tx_id%47=0 then 'bad' else previous end as previous, checksum from ch)"


@query("lg03_validate", f"""with recursive {_CHAIN}, {_TAMPER}, x as (select *, row_number() over w as n, lag(checksum) over w as before, sha256(coalesce(previous,'')||'|'||seq||'|'||payload) as expected from ta window w as (partition by project_id order by seq, tx_id))
  select project_id, seq, 'sequence-gap' as code from x where seq<>n union all select project_id, seq, 'chain-mismatch' from x where previous is distinct from before union all select project_id, seq, 'checksum-mismatch' from x where checksum<>expected""")
def lg03(t):
    ch = O.append_chain(ops_of(t).select("project_id", "seq", "tx_id", "payload"))
    bad = ch.withColumn("seq", F.expr("if(tx_id%89=0, seq+1, seq)")).withColumn("payload", F.expr("if(tx_id%31=0, concat(payload,'x'), payload)")).withColumn(
        "previous", F.expr("if(tx_id%47=0, 'bad', previous)"))
    return O.chain_violations(bad, seq_span())


@query("lg04_head", "select project_id, max(seq) as head_seq, arg_max(tx_id, seq) as head_tx from v_ops group by 1")
def lg04(t):
    return O.heads(t.v_ops)


@query("lg05_truncate", "select project_id, seq, tx_id from (select *, max(seq) over (partition by project_id)//2 as upto from v_ops) where seq<=upto")
def lg05(t):
    marks = O.heads(t.v_ops).select("project_id", F.expr("head_seq div 2").alias("upto"))
    return O.truncate(t.v_ops, marks).select("project_id", "seq", "tx_id")


def _state_sql(src, keys="project_id"):
    return f"""life as (select {keys}, entity_id, max(seq) as born, arg_max(op_type, seq) as ty from {src} where op_type in ('node.add','node.remove') group by all),
  st as (select {', '.join('w.' + k for k in keys.split(', '))}, w.entity_id, w.prop, arg_max(w.value, w.seq) as value from {src} w join life l on {' and '.join(f'l.{k}=w.{k}' for k in keys.split(', '))} and l.entity_id=w.entity_id and l.ty='node.add'
   where w.op_type in ('node.add','node.update') and w.seq>=l.born group by all)"""


@query("lg06_replay_nodes", f"with {_state_sql('v_ops')} select project_id, entity_id, prop, value from st")
def lg06(t):
    return O.replay_nodes(ops_of(t))


@query("lg06_replay_edges", f"""with {_EDGE_OPS}, l as (select project_id, edge_id, max(seq) as seq, arg_max(op_type, seq) as ty, arg_max(entity_id, seq) as src, arg_max(other_id, seq) as dst from eo where op_type in ('edge.add','edge.remove') group by all)
  select project_id, edge_id, src, dst from l where ty='edge.add' and not exists (select 1 from eo r where r.project_id=l.project_id and r.op_type='node.remove' and r.entity_id in (l.src, l.dst) and r.seq>l.seq)""")
def lg06e(t):
    return O.replay_edges(edge_ops_of(t))


@query("lg07_as_of", f"""with m as (select o.*, mk.mark from v_ops o join (values (1,10),(2,25),(3,40)) mk(mark, upto) on o.seq<=mk.upto), {_state_sql('m', 'project_id, mark')} select project_id, mark, entity_id, prop, value from st""")
def lg07(t):
    marks = t.v_ops.select("project_id").distinct().select("project_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mark"), F.lit(u).alias("upto")) for m, u in ((1, 10), (2, 25), (3, 40))])).alias("x")).select("project_id", "x.*")
    return O.states_at(ops_of(t), marks)


@query("lg08_snapshot", f"with {_state_sql('v_ops')} select st.project_id, h.head_seq, count(*) as cells, round(sum(value),4) as total from st join (select project_id, max(seq) as head_seq from v_ops group by 1) h using (project_id) group by all")
def lg08(t):
    """What a compaction writes: the state of every project with the head it stands for."""
    s = O.replay_nodes(ops_of(t)).groupBy("project_id").agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("total"))
    return s.join(O.heads(t.v_ops).select("project_id", "head_seq"), "project_id")


@query("lg09_recovery", f"""with {_state_sql('v_ops')}, sd as (select project_id, entity_id, prop, case when project_id%10=0 then value+1 else value end as value from st)
  select *, 'replayed' as side from (select * from st except all select * from sd) union all select *, 'stored' from (select * from sd except all select * from st)""")
def lg09(t):
    s = O.replay_nodes(ops_of(t))
    return O.state_difference(s, s.withColumn("value", F.expr("if(project_id%10=0, value+1, value)")))


@query("lg10_tail", "select project_id, seq, tx_id from (select *, row_number() over (partition by project_id order by seq) as rn from v_ops where seq>20) where rn<=5")
def lg10(t):
    after = t.v_ops.select("project_id").distinct().withColumn("after_seq", F.lit(20))
    return O.tail(t.v_ops, after, 5).select("project_id", "seq", "tx_id")


_PREFLIGHT = """ex as (select o.project_id, o.seq, w.ent, arg_max(n.op_type, n.seq) as ty from eo o, lateral (values (o.entity_id), (o.other_id)) w(ent) join eo n on n.project_id=o.project_id and n.entity_id=w.ent and n.seq<o.seq and n.op_type in ('node.add','node.remove') group by all),
  pe as (select o.project_id, o.seq, arg_max(p.op_type, p.seq) as ty, max(p.seq) as at_, arg_max(p.entity_id, p.seq) as src, arg_max(p.other_id, p.seq) as dst from eo o join eo p on p.project_id=o.project_id and p.edge_id=o.edge_id and p.seq<o.seq and p.op_type in ('edge.add','edge.remove') where o.op_type='edge.add' group by all),
  live as (select project_id, seq from pe where ty='edge.add' and not exists (select 1 from eo r where r.project_id=pe.project_id and r.op_type='node.remove' and r.entity_id in (pe.src, pe.dst) and r.seq>pe.at_ and r.seq<pe.seq)),
  b as (select o.project_id, o.seq, case when o.op_type='node.paint' then 'schema' else 'apply' end as phase,
    case when o.op_type='node.paint' then 'unsupported-operation' when o.op_type='node.add' and a.ty='node.add' then 'already-exists' when o.op_type='node.update' and a.ty is distinct from 'node.add' then 'unknown-node'
      when o.op_type='node.remove' and o.entity_id=3 then 'project-root' when o.op_type='edge.add' and live.seq is not null then 'edge-exists'
      when o.op_type='edge.add' and (a.ty is distinct from 'node.add' or z.ty is distinct from 'node.add') then 'unknown-node' end as code
    from eo o left join ex a on a.project_id=o.project_id and a.seq=o.seq and a.ent=o.entity_id left join ex z on z.project_id=o.project_id and z.seq=o.seq and z.ent=o.other_id left join live on live.project_id=o.project_id and live.seq=o.seq),
  f as (select project_id, seq, phase, code from b where code is not null qualify row_number() over (partition by project_id order by phase desc, seq)=1)"""


@query("lg11_preflight", f"with {_EDGE_OPS}, {_PREFLIGHT} select * from f")
def lg11(t):
    ops = edge_ops_of(t)
    roots = ops.select("project_id").distinct().withColumn("entity_id", F.lit(3).cast("bigint"))
    return O.first_failures(ops, seq_span(), 1 << 20, roots)


_GROWN = """gt as (select *, case when event_type='signup' then case event_id%8 when 0 then 'composition' when 1 then 'track' when 2 then 'clip' when 3 then 'clip' when 4 then 'object' when 5 then 'composition' when 6 then 'track' else 'project' end end as kind from events),
  gl as (select *, {prev}(case when kind in ('composition','project') then event_id end) as home, {prev}(case when kind in ('track','object') then event_id end) as child, {prev}(case when kind='clip' then event_id end) as clip, {prev}(case when kind='composition' then event_id end) as comp,
    {prev}(case when event_type in ('view','click') then event_id end) as edge from gt),
  eo as (select user_id as project_id, event_id as seq, kind, case when event_type='signup' then 'node.add' when event_type in ('view','click') then 'edge.add' when event_type='error' then 'node.update' when event_id%4=0 then 'edge.remove' when event_id%9=1 then 'node.remove' else 'node.update' end as op_type,
    case when event_type='signup' then event_id when event_type in ('view','click') then home when event_type='error' then clip when event_id%4=0 then 0 when event_id%9=1 then child else comp end as entity_id, child as other_id,
    case when event_type='purchase' and event_id%4=0 then edge else event_id end as edge_id, case when event_type='error' then case event_id%4 when 0 then 'start' when 1 then 'duration' when 2 then 'pan' else 'inPoint' end when event_type='purchase' then case event_id%2 when 0 then 'fps' else 'duration' end else case kind when 'composition' then 'fps' else 'start' end end as prop,
    case when event_id%5=0 then -0.5::double else 0.5::double end as value from gl)"""
_GROWN_FIT = "entity_id is not null and (op_type<>'edge.add' or other_id is not null) and (op_type<>'edge.remove' or edge_id is not null)"


def grown_ops(t):
    """Logs of projects that add nodes, put them into each other and change them; most apply, and many leave a rule broken."""
    e = t.events.withColumn("kind", F.expr("case when event_type='signup' then case event_id%8 when 0 then 'composition' when 1 then 'track' when 2 then 'clip' when 3 then 'clip' when 4 then 'object' when 5 then 'composition' when 6 then 'track' else 'project' end end"))
    last = lambda sql: ("prev", F.expr(f"case when {sql} then event_id end"))
    x = span_scan(e, ["user_id"], ["event_id"], span_of("event_id", 1 << 20), home=last("kind in ('composition','project')"), child=last("kind in ('track','object')"),
                  clip=last("kind='clip'"), comp=last("kind='composition'"), edge=last("event_type in ('view','click')"))
    return x.selectExpr("user_id as project_id", "event_id as seq", "kind", """case when event_type='signup' then 'node.add' when event_type in ('view','click') then 'edge.add' when event_type='error' then 'node.update' when event_id%4=0 then 'edge.remove' when event_id%9=1 then 'node.remove' else 'node.update' end as op_type""",
        "case when event_type='signup' then event_id when event_type in ('view','click') then home when event_type='error' then clip when event_id%4=0 then 0 when event_id%9=1 then child else comp end as entity_id", "child as other_id",
        "case when event_type='purchase' and event_id%4=0 then edge else event_id end as edge_id",
        "case when event_type='error' then case event_id%4 when 0 then 'start' when 1 then 'duration' when 2 then 'pan' else 'inPoint' end when event_type='purchase' then case event_id%2 when 0 then 'fps' else 'duration' end else case kind when 'composition' then 'fps' else 'start' end end as prop",
        "case when event_id%5=0 then -0.5D else 0.5D end as value").where(_GROWN_FIT)


_PREV = "last_value({x} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)"


def _grown_sql():
    import re
    return re.sub(r"\{prev\}\((case when [^()]*(?:\([^()]*\)[^()]*)* end)\)", lambda m: _PREV.format(x=m[1]), _GROWN)


@query("lg11_invariants", f"""with {_grown_sql().replace("eo as (", "eo0 as (")}, eo as (select * from eo0 where {_GROWN_FIT}), {_PREFLIGHT},
  nl as (select a.project_id, a.entity_id, a.kind, a.seq as born, (select min(r.seq) from eo r where r.project_id=a.project_id and r.entity_id=a.entity_id and r.op_type='node.remove' and r.seq>a.seq) as dead from eo a where op_type='node.add'),
  el as (select a.project_id, a.entity_id as src, a.other_id as dst, a.seq as opened, (select min(r.seq) from eo r where r.project_id=a.project_id and r.seq>a.seq and ((r.op_type='edge.remove' and r.edge_id=a.edge_id) or (r.op_type='node.remove' and r.entity_id in (a.entity_id, a.other_id)))) as closed from eo a where op_type='edge.add'),
  ek as (select el.*, p.kind from el left join nl p on p.project_id=el.project_id and p.entity_id=el.src and p.born<el.opened and (p.dead is null or p.dead>el.opened)),
  tick as (select nl.*, o.seq from nl join eo o on o.project_id=nl.project_id and o.seq>=nl.born and (nl.dead is null or o.seq<nl.dead)),
  pr as (select t.project_id, t.entity_id, t.kind, t.dead, t.seq, count(e.opened) as n, count(case when e.kind='composition' then 1 end) as c, count(case when e.kind in ('project','object') then 1 end) as po
    from tick t left join ek e on e.project_id=t.project_id and e.dst=t.entity_id and e.opened<=t.seq and (e.closed is null or e.closed>t.seq) where t.kind in ('track','object') group by all),
  vr(kind, prop, code, lo, hi, strict, dflt) as (values ('composition','fps','composition.fps',0.0,1e9,true,null), ('composition','duration','composition.duration',0.0,1e9,false,null), ('clip','start','clip.start',0.0,1e9,false,null), ('clip','duration','clip.duration',0.0,1e9,true,null),
    ('clip','inPoint','clip.in-point',0.0,1e9,false,0.0), ('clip','playbackRate','clip.playback-rate',0.0,1e9,true,1.0), ('clip','gainDb','clip.gain-db',-96.0,24.0,false,0.0), ('clip','pan','clip.pan',-1.0,1.0,false,0.0), ('clip','fadeIn','clip.fade-in',0.0,1e9,false,0.0), ('clip','fadeOut','clip.fade-out',0.0,1e9,false,0.0)),
  va as (select t.project_id, t.entity_id, t.dead, t.seq, r.code, r.lo, r.hi, r.strict, coalesce(arg_max(w.value, w.seq), max(r.dflt)) as v from tick t join vr r on r.kind=t.kind left join eo w on w.project_id=t.project_id and w.entity_id=t.entity_id and w.op_type in ('node.add','node.update') and w.prop=r.prop and w.seq>=t.born and w.seq<=t.seq group by all),
  fl as (select project_id, entity_id, dead, seq, code, v is null or v<lo or v>hi or (strict and v<=lo) as bad from va
    union all select project_id, entity_id, dead, seq, case kind when 'track' then 'track.parent' else 'object.parent' end, case kind when 'track' then c<>1 else n<>1 or po<>1 end from pr),
  en as (select project_id, entity_id, code, max(case when bad and not was then seq end) as since from (select *, coalesce(lag(bad) over (partition by project_id, entity_id, code order by seq), false) as was from fl where dead is null) group by all having arg_max(bad, seq)),
  iv as (select project_id, since as seq, 'invariants' as phase, code from en where project_id not in (select project_id from f) qualify row_number() over (partition by project_id order by since, code)=1)
  select * from f union all select * from iv""")
def lg11i(t):
    """Schema, apply and invariants phases together: of every log the op to blame."""
    return I.preflight(durable(grown_ops(t)), seq_span(), 1 << 20)


@query("lg12_review", """with x as (select *, sum(case when op_type in ('node.add','node.remove') then 1 else 0 end) over (partition by project_id, entity_id order by seq) as life from v_ops),
  y as (select *, lag(value) over (partition by project_id, entity_id, prop, life order by seq) as before from x where op_type in ('node.add','node.update')) select project_id, seq, entity_id, prop, before, value as after from y where op_type='node.update'""")
def lg12(t):
    return O.review_changes(ops_of(t), seq_span())


@query("lg13_verdicts", """select o_orderkey as batch_id, case when o_custkey%5<>o_orderkey%5 and o_orderkey%3=0 then 'project-mismatch' when c.c_custkey is null then 'actor-not-allowed' when o_orderkey%50=0 then 'issued-at-required'
   when 1000000-(o_orderkey*97%1200000)<0 or 1000000-(o_orderkey*97%1200000)>500000 then 'outside-window' else 'accepted' end as verdict from orders left join (select c_custkey from customer where c_acctbal>0) c on c.c_custkey=o_custkey""")
def lg13(t):
    b = t.orders.select(F.col("o_orderkey").alias("batch_id"), F.lit(1).alias("project_id"), F.expr("if(o_custkey%5<>o_orderkey%5 and o_orderkey%3=0, 2, 1) as target_project"),
                        F.col("o_custkey").alias("actor_id"), F.expr("if(o_orderkey%50=0, null, o_orderkey*97%1200000) as issued_at"))
    allowed = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("actor_id"))
    return O.batch_verdicts(b, allowed, 1_000_000, 500_000).select("batch_id", "verdict")


@query("lg14_append_batch", """with h as (select project_id, max(seq) as s from v_ops group by 1) select project_id*10+k as batch_id, project_id, case when k=1 then 'accepted' else 'stale' end as status from h, (values (0),(1),(2)) v(k)""")
def lg14(t):
    """Three batches per project: one behind the head, two that both name it."""
    h = O.heads(t.v_ops)
    b = h.select("project_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "head_seq", "head_tx").select(
        (F.col("project_id") * 10 + F.col("k")).alias("batch_id"), "project_id", (F.col("head_seq") - F.expr("if(k = 0, 1, 0)")).alias("previous_seq"), F.col("head_tx").alias("previous_tx"))
    return O.append_if_current(b, t.v_ops)


def fingerprints_of(t):
    cells = O.replay_nodes(ops_of(t)).withColumn("cell", F.round(F.col("value") * 1e6).cast("bigint"))
    return G.fingerprint(cells, ["project_id"], ["entity_id", "prop", "cell"])


_FP = f"""{_state_sql('v_ops')}, h as (select project_id, sha256(entity_id||'|'||prop||'|'||coalesce(round(value*1e6)::bigint::varchar, '\\N')) as h from st), fp as (select project_id, lower(hex(bit_xor(('0x'||left(h,15))::bigint))) as fingerprint from h group by 1)"""


@query("lg15_stale", f"with {_FP}, p as (select distinct project_id from v_ops) select p.project_id*7 as plan_id, p.project_id, case when p.project_id%3=0 then true else fingerprint is null end as stale from p left join fp using (project_id)")
def lg15(t):
    fp = fingerprints_of(t)
    p = t.v_ops.select("project_id").distinct().join(fp, "project_id", "left").select(
        (F.col("project_id") * 7).alias("plan_id"), "project_id", F.expr("if(project_id%3=0, 'old', coalesce(fingerprint, 'none')) as base_fingerprint"))
    return O.stale_proposals(p, fp)


@query("lg15_select", """with pk as (select project_id as plan_id, seq*2-3 as op_idx from v_ops union all select project_id, seq from v_ops where seq%5=0), sz as (select project_id as plan_id, count(*) as size from v_ops group by 1),
  g as (select plan_id, op_idx, count(*) as n, any_value(size) as size from pk join sz using (plan_id) group by all), r as (select *, case when op_idx<0 or op_idx>=size then 'out-of-range' when n>1 then 'duplicate' end as reason from g)
  select plan_id, op_idx, reason from r where reason is not null union all select r.plan_id, r.op_idx, 'kept' from r join v_ops o on o.project_id=r.plan_id and o.seq-1=r.op_idx where reason is null""")
def lg15s(t):
    o = t.v_ops.select(F.col("project_id").alias("plan_id"), (F.col("seq") - 1).alias("op_idx"))
    picks = t.v_ops.select(F.col("project_id").alias("plan_id"), (F.col("seq") * 2 - 3).alias("op_idx")).unionByName(
        t.v_ops.where("seq%5=0").select(F.col("project_id").alias("plan_id"), F.col("seq").alias("op_idx")))
    sizes = o.groupBy("plan_id").agg(F.count("*").alias("size"))
    kept, bad = O.select_plan_ops(o, picks, sizes)
    return bad.unionByName(kept.withColumn("reason", F.lit("kept")))


# --- conflicts ----------------------------------------------------------------------------------------------------------

def sides_of(t):
    """Local: the second half of every log. Remote: a batch made of the first half, moved by three entities."""
    half = F.expr("head_seq div 2")
    x = ops_of(t).join(O.heads(t.v_ops).select("project_id", half.alias("half")), "project_id")
    local = x.where("seq > half").drop("half")
    remote = x.where("seq <= half").drop("half").withColumn("entity_id", (F.col("entity_id") + 3) % 20).withColumn("tx_id", -F.col("tx_id") - 1).withColumn(
        "edge_id", F.col("tx_id")).withColumn("op_type", F.expr("if(tx_id%200=-1, 'node.paint', op_type)"))
    return local, remote


_SIDES = """b as (select *, (entity_id+7)%20 as other_id, max(seq) over (partition by project_id)//2 as half from v_ops),
  loc as (select project_id, seq, op_type, entity_id, other_id, prop, tx_id from b where seq>half), rem as (select project_id, seq, case when (-tx_id-1)%200=-1 then 'node.paint' else op_type end as op_type, (entity_id+3)%20 as entity_id, other_id, prop, -tx_id-1 as tx_id from b where seq<=half)"""


def _res(src, out):
    return f"""{out} as (select project_id, seq, 'node' as scope, entity_id::varchar as id, '*' as path from {src} where op_type in ('node.add','node.remove') union all select project_id, seq, 'node', entity_id::varchar, 'props:'||prop from {src} where op_type='node.update'
   union all select project_id, seq, 'edge', tx_id::varchar, '*' from {src} where op_type='edge.add' union all select project_id, seq, 'node', entity_id::varchar, '@links' from {src} where op_type='edge.add' union all select project_id, seq, 'node', other_id::varchar, '@links' from {src} where op_type='edge.add'
   union all select project_id, seq, 'global', '*', '*' from {src} where op_type='node.paint')"""


_PAIRS = f"""{_SIDES}, {_res('loc', 'lr')}, {_res('rem', 'rr')}, hits as (select l.project_id, l.seq as l_seq, r.seq as r_seq from lr l join rr r on l.project_id=r.project_id and (l.scope='global' or r.scope='global' or (l.scope=r.scope and l.id=r.id and (l.path='*' or r.path='*' or l.path=r.path)))),
  pairs as (select distinct project_id, l_seq, 0 as l_op_idx, r_seq, 0 as r_op_idx from hits)"""


@query("cf01_resources", f"with {_SIDES}, {_res('rem', 'rr')} select project_id, seq, scope, id, path from rr")
def cf01(t):
    return C.resources(sides_of(t)[1]).select("project_id", "seq", "scope", "id", "path")


@query("cf02_pairs", f"with {_PAIRS} select * from pairs")
def cf02(t):
    return C.conflict_pairs(*sides_of(t))


@query("cf02_counts", f"with {_PAIRS}, k as (select project_id, seq as r_seq, 0 as r_op_idx from rem), h as (select project_id, r_seq, count(*) as n from hits group by all) select k.project_id, k.r_seq, k.r_op_idx, coalesce(n,0)::bigint as hits from k left join h using (project_id, r_seq)")
def cf02c(t):
    return C.conflict_counts(*sides_of(t))


@query("cf03_rebase", f"""with {_PAIRS}, m as (select project_id, max(seq) as head from v_ops group by 1), cf as (select distinct project_id*3+r_seq%2 from hits)
  select project_id*3+k as batch_id, project_id, case when project_id%11=0 then 'different-base' when project_id%7=0 then 'different-history' when project_id%5=0 then 'current' when project_id*3+k in (from cf) then 'conflict' else 'rebase-safe' end as status from m, (values (0),(1)) v(k)""")
def cf03(t):
    local, remote = sides_of(t)
    h = O.heads(t.v_ops)
    fork = h.withColumn("fork_seq", F.expr("if(project_id%5=0, head_seq, head_seq div 2)")).join(
        t.v_ops.select("project_id", F.col("seq").alias("fork_seq"), F.col("tx_id").alias("fork_tx")), ["project_id", "fork_seq"])
    fork = fork.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))  # two batches: even and odd operations
    remote = remote.withColumn("batch_id", F.col("project_id") * 3 + F.col("seq") % 2)
    b = fork.select((F.col("project_id") * 3 + F.col("k")).alias("batch_id"), "project_id", F.expr("if(project_id%11=0, 2, 1) as base_revision"), F.lit(1).alias("log_revision"),
                    "fork_seq", F.expr("if(project_id%7=0, -1, fork_tx) as fork_tx"))
    return C.rebase_status(b, ops_of(t), remote)


@query("cf04_plan_rebase", f"""with {_PAIRS}, {_state_sql('v_ops')}, cf as (select distinct project_id*2+r_seq%2 from hits), p as (select distinct project_id from v_ops), sp as (select distinct project_id from st)
  select project_id*2+k as plan_id, project_id, case when project_id%13=0 and project_id in (from sp) then 'reconstruction-failed' when project_id*2+k in (from cf) then 'conflict' else 'rebase-safe' end as status from p, (values (0),(1)) v(k)""")
def cf04(t):
    local, remote = sides_of(t)
    fp = fingerprints_of(t)
    plans = O.heads(t.v_ops).select("project_id", F.expr("head_seq div 2 as base_seq"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        (F.col("project_id") * 2 + F.col("k")).alias("plan_id"), "project_id", "base_seq")
    remote = remote.withColumn("plan_id", F.col("project_id") * 2 + F.col("seq") % 2)
    rebuilt = fp.withColumn("fingerprint", F.expr("if(project_id%13=0, 'x', fingerprint)"))
    return C.plan_rebase(plans, remote, ops_of(t), fp, rebuilt)


_NAMES = "nm as (select p_partkey as entity_id, p_name as name from part where p_partkey%3>0)"


@query("cf05_model", f"""with {_PAIRS}, {_NAMES}, lab as (select s.*, coalesce(nm.name, s.entity_id::varchar) as who from (select 'l' as side, * from loc union all select 'r', * from rem) s left join nm using (entity_id)),
  sm as (select side, project_id, seq, case op_type when 'node.add' then 'Add node '||who when 'node.remove' then 'Remove node '||who when 'node.update' then 'Update '||who||' · props:'||prop when 'edge.add' then 'Add edge '||tx_id else 'Unknown operation '||op_type end as txt from lab)
  select pairs.project_id, l_seq||':0|'||r_seq||':0' as row_id, a.txt as l_summary, b.txt as r_summary from pairs join sm a on a.side='l' and a.project_id=pairs.project_id and a.seq=l_seq join sm b on b.side='r' and b.project_id=pairs.project_id and b.seq=r_seq""")
def cf05(t):
    local, remote = sides_of(t)
    return model_of(t, local, remote).select("project_id", "row_id", "l_summary", "r_summary")


def model_of(t, local, remote):
    names = t.part.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return C.conflict_model(C.conflict_pairs(local, remote), local, remote, names)


_GROUPS = f"""{_PAIRS}, gr as (select project_id, r_seq, count(*) as rows, min(l_seq||':0|'||r_seq||':0') as first_row, lower(hex(bit_xor(('0x'||left(sha256(l_seq||':0|'||r_seq||':0'),15))::bigint))) as fingerprint from pairs group by all)"""


@query("cf06_groups", f"with {_GROUPS} select project_id, r_seq, 0 as r_op_idx, rows, first_row, fingerprint from gr")
def cf06(t):
    local, remote = sides_of(t)
    return C.decision_groups(model_of(t, local, remote))


_DEC = "dec as (select project_id, r_seq, case r_seq%4 when 0 then 'keep-local' when 1 then 'reapply-remote' when 2 then 'manual' end as choice from gr where project_id%2=0 or r_seq%4<>3)"


def decided_of(t):
    local, remote = sides_of(t)
    g = C.decision_groups(model_of(t, local, remote))
    d = g.where("project_id%2=0 or r_seq%4<>3").select("project_id", "r_seq", "r_op_idx", F.expr(
        "case r_seq%4 when 0 then 'keep-local' when 1 then 'reapply-remote' when 2 then 'manual' end as choice"))
    complete = g.select("project_id").distinct().withColumn("complete", F.col("project_id") % 9 != 0)
    return g, d, complete


@query("cf06_progress", f"""with {_GROUPS}, {_DEC} select project_id, count(choice) as decided, count(*) as total, count(*)-count(choice) as remaining, round(count(choice)/count(*),6) as ratio, project_id%9<>0 and count(choice)=count(*) as ready from gr left join dec using (project_id, r_seq) group by 1""")
def cf06p(t):
    return C.decision_progress(*decided_of(t)).withColumn("ratio", F.round("ratio", 6))


@query("cf07_finalize", f"""with {_GROUPS}, {_DEC}, rp as (select project_id, seq as r_seq, case when seq%6=0 then 5 when seq%6=1 then tx_id else -tx_id-1 end as tx_id from v_ops where seq%3<>2), n as (select project_id, r_seq, count(*) as n from rp group by all),
  x as (select gr.project_id, gr.r_seq, dec.choice, coalesce(n,0) as n from gr left join dec using (project_id, r_seq) left join n using (project_id, r_seq))
  select project_id, r_seq||':0' as group_id, 'incomplete' as code from x where project_id%9=0 union all select project_id, r_seq||':0', 'undecided' from x where choice is null
  union all select project_id, r_seq||':0', 'keep-local-with-replacement' from x where choice='keep-local' and n>0 union all select project_id, r_seq||':0', 'missing-replacement' from x where choice<>'keep-local' and n=0
  union all select project_id, r_seq||':0', 'unknown-group' from rp where not exists (select 1 from gr where gr.project_id=rp.project_id and gr.r_seq=rp.r_seq)
  union all select project_id, r_seq||':0', 'transaction-reused' from rp where exists (select 1 from v_ops o where o.project_id=rp.project_id and o.tx_id=rp.tx_id)
  union all select project_id, max(r_seq||':0'), 'transaction-repeated' from rp group by project_id, tx_id having count(*)>1""")
def cf07(t):
    g, d, complete = decided_of(t)
    rp = t.v_ops.where("seq%3<>2").select("project_id", F.col("seq").alias("r_seq"), F.lit(0).alias("r_op_idx"), F.expr("case when seq%6=0 then 5 when seq%6=1 then tx_id else -tx_id-1 end as tx_id"))
    return C.resolution_violations(g, d, rp, t.v_ops, complete)


# --- trust --------------------------------------------------------------------------------------------------------------

_US = micros("ts")
_ACT = """actors as (select c_custkey as actor_id, case when c_acctbal<0 then 'revoked' else 'active' end as status from customer),
  ks as (select c_custkey as actor_id, k as key_id, case when c_custkey%17=0 and k=1 then 'revoked' else 'active' end as status, case c_custkey%3 when 0 then ['*'] when 1 then ['sign','view'] else ['click','purchase'] end as purposes,
   (c_custkey*1000000)::bigint as not_before, case when c_custkey%5<>0 then (1500000000+c_custkey*1000)::bigint end as expires_at from customer, (values (0::bigint),(1::bigint)) v(k))"""


def trust_of(t):
    actors = t.customer.select(F.col("c_custkey").alias("actor_id"), F.expr("if(c_acctbal<0,'revoked','active') as status"), F.lit(None).cast("bigint").alias("revoked_at"))
    keys = t.customer.select(F.col("c_custkey").alias("actor_id"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("key_id"), "c_custkey").select(
        "actor_id", "key_id", F.expr("if(c_custkey%17=0 and key_id=1,'revoked','active') as status"),
        F.expr("case c_custkey%3 when 0 then array('*') when 1 then array('sign','view') else array('click','purchase') end as purposes"),
        F.expr("c_custkey*1000000 as not_before"), F.expr("if(c_custkey%5<>0, 1500000000+c_custkey*1000, null) as expires_at"), F.lit(None).cast("bigint").alias("revoked_at"))
    msgs = t.events.select("event_id", (F.col("user_id") + F.col("event_id") % 7).alias("actor_id"), (F.col("event_id") % 3).alias("key_id"), F.col("event_type").alias("purpose"),
                           F.expr(f"({_US}-1704067200000000) div 1000 as at"))
    return actors, keys, msgs


_MSG = "msg as (select event_id, user_id+event_id%7 as actor_id, event_id%3 as key_id, event_type as purpose, (epoch_us(ts)-epoch_us(timestamp '2024-01-01'))//1000 as at_ from events)"


@query("tr01_keys", f"""with {_ACT}, {_MSG} select event_id, case when a.actor_id is null then 'unknown-actor' when a.status<>'active' then 'actor-revoked' when k.key_id is null then 'unknown-key' when k.status<>'active' then 'key-revoked'
   when not (list_contains(purposes, purpose) or list_contains(purposes,'*')) then 'purpose' when at_<not_before then 'not-yet-valid' when at_>=expires_at then 'expired' end as reason from msg left join actors a on a.actor_id=msg.actor_id left join ks k on k.actor_id=msg.actor_id and k.key_id=msg.key_id""")
def tr01(t):
    actors, keys, msgs = trust_of(t)
    return T.resolve_keys(msgs, actors, keys).select("event_id", "reason")


@query("tr02_replays", f"with {_MSG} select event_id, row_number() over (partition by actor_id, key_id, purpose, event_id%4 order by at_, event_id)>1 as replayed from msg")
def tr02(t):
    m = trust_of(t)[2].withColumn("nonce", F.col("event_id") % 4)
    return T.replays(m, ["actor_id", "key_id", "purpose", "nonce"], ["at", "event_id"]).select("event_id", "replayed")


@query("tr03_freshness", f"with {_MSG} select event_id, case when 1500000000-at_>900000000 then 'too-old' when 1500000000-at_< -60000 then 'in-future' end as reason from msg")
def tr03(t):
    return T.freshness(trust_of(t)[2], 1_500_000_000, 900_000_000, 60_000).select("event_id", "reason")


@query("tr04_retention", f"with {_MSG} select event_id from (select event_id, row_number() over (partition by actor_id%10 order by at_ desc, lpad(event_id::varchar,12,'0')) as rn from msg where 2500000000-at_<=1500000000) where rn<=100")
def tr04(t):
    m = trust_of(t)[2].select("event_id", (F.col("actor_id") % 10).alias("registry"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("nonce"), F.col("at").alias("consumed_at"))
    return T.retain_nonces(m, 2_500_000_000, 1_500_000_000, 100, ["registry"]).select("event_id")


@query("tr05_revocation", f"""with {_ACT}, ra as (select o_custkey as actor_id, min(o_orderkey) as t from orders where o_orderstatus='F' and o_custkey%4=0 group by 1), rk as (select o_custkey as actor_id, o_orderkey%2 as key_id, min(o_orderkey) as t from orders where o_orderstatus='P' group by all)
  select ks.actor_id, ks.key_id, case when ks.status='active' and (ra.t is not null or rk.t is not null) then 'revoked' else ks.status end as status, case when ks.status='active' then least(ra.t, rk.t) end as revoked_at from ks left join ra using (actor_id) left join rk using (actor_id, key_id)""")
def tr05(t):
    actors, keys, _ = trust_of(t)
    ra = t.orders.where("o_orderstatus='F' and o_custkey%4=0").select(F.col("o_custkey").alias("actor_id"), F.col("o_orderkey").alias("revoked_at"))
    rk = t.orders.where("o_orderstatus='P'").select(F.col("o_custkey").alias("actor_id"), (F.col("o_orderkey") % 2).alias("key_id"), F.col("o_orderkey").alias("revoked_at"))
    return T.revoke(actors, keys, ra, rk)[1].select("actor_id", "key_id", "status", "revoked_at")


@query("tr05_enrolment", f"""with {_ACT}, k2 as (select actor_id+case when actor_id%40=0 then 100000 else 0 end as actor_id, key_id, not_before, expires_at from ks union all select actor_id, key_id, not_before, expires_at from ks where actor_id%50=1)
  select actor_id||'/'||key_id as id, 'key-exists' as code from k2 group by actor_id, key_id having count(*)>1 union all select actor_id||'/'||key_id, 'unknown-actor' from k2 where actor_id not in (select actor_id from actors) union all select actor_id||'/'||key_id, 'empty-window' from k2 where expires_at<=not_before""")
def tr05e(t):
    actors, keys, _ = trust_of(t)
    k2 = keys.withColumn("actor_id", F.expr("actor_id + if(actor_id%40=0, 100000, 0)")).unionByName(keys.where("actor_id%50=1"))
    return T.enrolment_violations(actors, k2)
