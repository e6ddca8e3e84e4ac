"""Storage, retention, cache, matching and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H, udf as U
from ..operators import matching as M, retention as R
from ..operators.scan import span_of
from ..sources import files as FS, graph_files as GF
from ..streaming.stores import new_folder
from .oplog import U32
from .registry import query


def saved_projects(t):
    """The graph written to project files in the shared folder, and what a reader finds there."""
    folder = new_folder(t.spark, "projects")
    GF.write_projects(GF.graph_documents(t.v_nodes, t.v_edges), folder)
    return GF.read_projects(t.spark, folder, one_per_file=False)


@query("src01_graph_round_trip", "select id, kind, name from v_nodes")
def src01(t):
    """Nodes to project files of bounded documents and back."""
    nodes, _, _ = GF.parse_documents(saved_projects(t))
    return nodes.select("id", "kind", "name")


@query("src02_graph_edges", "select src, dst, type, count(*) as copies from v_edges group by all")
def src02(t):
    _, edges, _ = GF.parse_documents(saved_projects(t))
    return edges.select("src", "dst", "type", F.variant_get("props", "$.copies", "bigint").alias("copies"))


@query("src03_manifest", "select 'P'||p_partkey as id, p_name as name, coalesce(case when p_size%7>0 then p_type end,'unknown') as asset_kind, p_brand as mime_type, coalesce(case when p_size%5>0 then p_size end,0) as size from part")
def src03(t):
    a = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("if(p_size%7>0, p_type, null) as asset_kind"),
                      F.col("p_brand").alias("mime_type"), F.expr("if(p_size%5>0, p_size, null) as size"))
    return R.source_manifest(a)


@query("src04_classify", """with c as (select page_id, case page_id%9 when 0 then 'video/webm' when 1 then 'application/mp2t' else '' end as mime, case page_id%9 when 2 then 'a.MOV' when 3 then 'b.m4s' when 4 then 'c.oga' when 5 then 'd.mp3' else 'x.html' end as name, page_id%9 as k from pages)
  select page_id, case k when 0 then 'webm' when 1 then 'mpegts' when 2 then 'mov' when 3 then 'mp4' when 4 then 'ogg' when 5 then 'mp3' when 6 then 'wav' when 7 then 'mp4' else 'unknown' end as container from c""")
def src04(t):
    k = F.col("page_id") % 9
    head = F.when(k == 6, F.concat(F.lit("RIFF0000WAVE"), "html")).when(k == 7, F.concat(F.lit("0000ftyp"), "html")).otherwise(F.col("html")).cast("binary")
    c = t.pages.select("page_id", F.expr("case page_id%9 when 0 then 'video/webm' when 1 then 'application/mp2t' else '' end as mime"),
                       F.expr("case page_id%9 when 2 then 'a.MOV' when 3 then 'b.m4s' when 4 then 'c.oga' when 5 then 'd.mp3' else 'x.html' end as name"), head.alias("head"))
    return c.select("page_id", R.classify(F.col("mime"), F.col("name"), F.col("head")).alias("container"))


def _whole(group):
    return "".join(group["html"]).encode()


def _indexed(group):
    """A small container: magic, number of chunks, an index of (id, offset, size), then the chunks."""
    import struct
    bodies = [h.encode() for h in group["html"]]
    at, index = 8 + 24 * len(bodies), b""
    for page_id, body in zip(group["page_id"], bodies):
        index += struct.pack("<qqq", page_id, at, len(body))
        at += len(body)
    return b"CLX1" + struct.pack("<I", len(bodies)) + index + b"".join(bodies)


def _chunks_of(source):
    """Chunk rows of such a file; the chunks themselves are never read."""
    import struct
    magic, n = struct.unpack("<4sI", source.read(0, 8))
    if magic != b"CLX1":
        raise ValueError("not an indexed file")
    index = source.read(8, 24 * n)
    for k in range(n):
        page_id, offset, size = struct.unpack_from("<qqq", index, 24 * k)
        yield k, page_id, offset, size


_FILE = "(page_id//20)||case (page_id//20)%5 when 0 then '.webm' when 1 then '.MOV' when 2 then '.m4s' when 3 then '.ogv' else '.bin' end"


def corpus_of(t, content):
    """The pages as files of 20, written by the tasks into the shared folder."""
    folder = new_folder(t.spark, "corpus")
    name = F.expr("concat(page_id div 20, case (page_id div 20)%5 when 0 then '.webm' when 1 then '.MOV' when 2 then '.m4s' when 3 then '.ogv' else '.bin' end)")
    FS.write_files(t.pages.select("page_id", "html", name.alias("file")), folder, "file", ["page_id"], content)
    return folder


@query("src04_classify_files", f"""select {_FILE} as name, sum(strlen(html))::bigint as bytes, case (page_id//20)%5 when 0 then 'webm' when 1 then 'mov' when 2 then 'mp4' when 3 then 'ogg' else 'unknown' end as container from pages group by page_id//20""")
def src04f(t):
    """Files by name and leading bytes; nothing else of them is read."""
    return FS.classify_files(t.spark, corpus_of(t, _whole))


@query("src05_fingerprint_files", f"""with f as (select {_FILE} as name, string_agg(html, '' order by page_id) as body from pages group by page_id//20)
  select name, strlen(body)::bigint as bytes, sha256(encode(strlen(body)||':text/html:')||encode(body)[1:1000]||encode(body)[greatest(strlen(body)-1000,0)+1:strlen(body)]) as fingerprint from f""")
def src05f(t):
    return FS.fingerprint_files(t.spark, corpus_of(t, _whole), "text/html", 1000)


def _sizes(texts):
    return [len(x) if len(x) % 3 else ValueError("refused") for x in texts]


def _down(texts):
    raise ConnectionError("down")


@query("udf01_invoke", """with p as (select doc_id, text, case doc_id%4 when 0 then ['sizes','marks'] when 1 then ['down','sizes','marks'] when 2 then ['gone','down'] else ['marks'] end as plan from documents),
  r as (select doc_id, case when list_contains(plan,'sizes') and length(text)%3<>0 then 'sizes' when list_contains(plan,'marks') then 'marks' end as backend_id, plan, text from p)
  select doc_id, backend_id, case backend_id when 'sizes' then length(text) when 'marks' then -1 end::bigint as result, case when backend_id is null then len(plan) else list_position(plan, backend_id) end::int as attempts, case when backend_id is null then 'down' end as error from r""")
def udf01(t):
    """User models called in batches, with fallback row by row along each request's plan."""
    plan = F.expr("case doc_id%4 when 0 then array('sizes','marks') when 1 then array('down','sizes','marks') when 2 then array('gone','down') else array('marks') end")
    models = {"sizes": _sizes, "down": _down, "marks": lambda texts: [-1] * len(texts)}
    out = U.invoke_models(t.documents.select("doc_id", "text", plan.alias("plan")), "plan", "text", models, "bigint")
    return out.select("doc_id", "backend_id", "result", F.size("attempts").alias("attempts"), "error")


@query("udf04_demux", f"""with p as (select page_id, {_FILE} as name, strlen(html) as n, row_number() over w-1 as k, count(*) over (partition by page_id//20) as c, coalesce(sum(strlen(html)) over (partition by page_id//20 order by page_id rows between unbounded preceding and 1 preceding),0) as before, sum(strlen(html)) over (partition by page_id//20) as total from pages window w as (partition by page_id//20 order by page_id))
  select name, k::int as k, page_id, (8+24*c+before)::bigint as "offset", n::bigint as size, (8+24*c+total)::bigint as source_bytes, (8+24*c)::bigint as bytes_read from p""")
def udf04(t):
    """Chunk rows by a user reader that reads the index of each file and no chunk."""
    rows = FS.demux_files(t.spark, corpus_of(t, _indexed), _chunks_of, "k int, page_id bigint, offset bigint, size bigint")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "k", "page_id", "offset", "size", "source_bytes", "bytes_read")


@query("src05_fingerprint", "select page_id, sha256(encode(strlen(html)||':text/html:')||encode(html)[1:1000]||encode(html)[greatest(strlen(html)-1000,0)+1:strlen(html)]) as fingerprint from pages")
def src05(t):
    p = t.pages.withColumn("b", F.col("html").cast("binary")).withColumn("n", F.octet_length("html"))
    return p.select("page_id", R.blob_fingerprint(F.col("b"), F.col("n"), F.lit("text/html"), 1000).alias("fingerprint"))


@query("src06_verify", """with d as (select doc_id, case when doc_id%5=0 then 'sha256-'||base64(unhex(sha256(text))) when doc_id%5=1 then sha256(text||'x') when doc_id%5=2 then 'md5-1' else upper(sha256(text)) end as integrity from documents)
  select d.doc_id as key, case when d.doc_id%7<>0 then strlen(text)::bigint end as bytes, case when d.doc_id%7=0 then 'missing' when strlen(text)>20000 then 'too-large' when d.doc_id%5=2 then 'unsupported-integrity' when d.doc_id%5=1 then 'mismatch' else 'verified' end as status from d join documents t on t.doc_id=d.doc_id""")
def src06(t):
    h = F.sha2("text", 256)
    d = t.documents.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("sha256-"), F.base64(F.unhex(h)))).when(
        F.col("doc_id") % 5 == 1, F.sha2(F.concat("text", F.lit("x")), 256)).when(F.col("doc_id") % 5 == 2, "md5-1").otherwise(F.upper(h)).alias("integrity"))
    s = t.documents.where("doc_id%7<>0").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("content"))
    return R.verify_artifacts(d, s, 20_000)


def artifacts_of(t):
    return t.documents.select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("key"), F.col("n_chars").alias("size"))


@query("src07_list", "select source||'/'||lpad(doc_id::varchar,9,'0') as key, n_chars as size from documents where source like 'src1%' order by 1 limit 50")
def src07(t):
    return R.list_by_prefix(artifacts_of(t), "src1", 50)


@query("src07_delete", "select source||'/'||lpad(doc_id::varchar,9,'0') as key, n_chars as size from documents where not source like 'src1%'")
def src07d(t):
    return R.without_prefix(artifacts_of(t), "src1")


@query("src08_duplicates", "select hash, count(*) as copies, min(id) as first_id, max(size) as size, (count(*)-1)*max(size) as spare_bytes from v_assets group by 1 having count(*)>1")
def src08(t):
    return R.duplicates_by_hash(t.v_assets)


_QUO = "q as (select distinct owner, (90000+length(owner)*10000)::bigint as quota from v_assets)"


def usage_of(t):
    a = t.documents.select(F.col("source").alias("owner"), F.col("n_chars").alias("size"))
    q = a.select("owner").distinct().withColumn("quota", (90000 + F.length("owner") * 10000).cast("bigint"))
    return R.usage(a, q)


@query("src09_usage", f"with {_QUO} select owner, sum(size)::bigint as usage, count(*) as assets, quota, greatest(0, quota-sum(size))::bigint as available, round(least(1, sum(size)/quota),6) as ratio from v_assets join q using (owner) group by owner, quota")
def src09(t):
    return usage_of(t).withColumn("ratio", F.round("ratio", 6))


_GC = """a as (select o_orderkey as id, case when o_orderkey%3=0 then null else 'h'||(o_orderkey%5000) end as hash, cast(o_totalprice as bigint) as size, case when o_orderkey%17=0 then null else o_orderkey*10 end as saved_at from orders),
  ri as (select distinct l_orderkey as id from lineitem where l_returnflag='A'), rh as (select distinct 'h'||(l_partkey%5000) as hash from lineitem where l_discount>=0.09),
  gc as (select a.*, case when ri.id is not null then 'referenced-id' when rh.hash is not null then 'referenced-hash' when saved_at is null then 'unknown-age' when 100000-saved_at<50000 then 'recent' end as reason from a left join ri using (id) left join rh on rh.hash=a.hash)"""


@query("gc01_plan", f"with {_GC} select id, reason from gc")
def gc01(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.expr("if(o_orderkey%3=0, null, concat('h', o_orderkey%5000)) as hash"), F.expr("if(o_orderkey%17=0, null, o_orderkey*10) as saved_at"))
    ri = t.lineitem.where("l_returnflag='A'").select(F.col("l_orderkey").alias("id"))
    rh = t.lineitem.where("l_discount>=0.09").select(F.concat(F.lit("h"), F.col("l_partkey") % 5000).alias("hash"))
    return R.retention_reasons(a, ri, rh, 100_000, 50_000).select("id", "reason")


_GC2 = """s as (select source as owner, doc_id, n_chars as size, row_number() over (partition by source order by doc_id) as rn from documents),
  g as (select owner, doc_id, rn, size<=40000 as taken, case when size<=40000 then 40000-size else 40000 end as room from s where rn=1
   union all select s.owner, s.doc_id, s.rn, s.size<=g.room, case when s.size<=g.room then g.room-s.size else g.room end from g join s on s.owner=g.owner and s.rn=g.rn+1)"""


@query("gc02_budget", f"with recursive {_GC2} select owner, doc_id, taken from g")
def gc02(t):
    d = t.documents.select(F.col("source").alias("owner"), "doc_id", F.col("n_chars").alias("size"))
    b = d.select("owner").distinct().withColumn("budget", F.lit(40000).cast("bigint"))
    return R.within_budget(d, b, "owner", ["doc_id"], "size", span_of("doc_id", 1 << 20)).select("owner", "doc_id", "taken")


@query("gc03_references", "select distinct 1::int as project_id, o_orderkey as id, 'h'||(o_orderkey%5000) as hash from orders where o_orderstatus='O' union select 1, l_orderkey, 'h'||(l_orderkey%5000) from lineitem where l_linestatus='F'")
def gc03(t):
    ref = lambda df, k: df.select(F.lit(1).alias("project_id"), F.col(k).alias("id"), F.concat(F.lit("h"), F.col(k) % 5000).alias("hash"))
    return R.retention_references(ref(t.orders.where("o_orderstatus='O'"), "o_orderkey"), ref(t.lineitem.where("l_linestatus='F'"), "l_orderkey"))


@query("gc04_pressure", f"with {_QUO}, u as (select owner, sum(size)::bigint as usage, quota from v_assets join q using (owner) group by owner, quota) select owner, ceil(usage-quota*0.8::double)::bigint as budget from u where usage/quota>=0.9")
def gc04(t):
    return R.pressure_budgets(usage_of(t))


@query("cache01_keys", """select event_id, 'preview:'||(event_id%2000)||':f'||round(value*30)::bigint||'@30:'||(event_id%640)||'x'||(event_id%360) as frame_key,
  'source:'||case when event_id%2=0 then 'h'||event_id else (event_id%2000)::varchar end||':'||(event_id%4096)||':'||event_type as source_key from events""")
def cache01(t):
    e = t.events
    d = lambda c: c.cast("double")
    return e.select("event_id", R.frame_key(F.col("event_id") % 2000, F.col("value"), 30, d(F.col("event_id") % 640), d(F.col("event_id") % 360)).alias("frame_key"),
                    R.source_key(F.col("event_id") % 2000, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("h"), "event_id")), F.col("event_id") % 4096, F.col("event_type")).alias("source_key"))


@query("cache01_derivative_keys", f"""select event_id, 'derived:'||(event_id%2000)||':'||event_type||':'||lpad(lower(hex(({U32})::ubigint)),8,'0') as key from (select event_id, event_type, replace(props, ' ', '') as props from events)""")
def cache01d(t):
    from ..operators.ledger import derivative_key
    return t.events.select("event_id", derivative_key(F.col("event_id") % 2000, F.col("event_type"), F.col("props")).alias("key"))


@query("cache02_prune", """with c as (select source as project_id, lang as kinds, max(doc_id) as fp from documents where lang<>'es' group by all) select d.doc_id as key, case when c.fp is null then 'other' when c.fp=d.doc_id then 'retain' else 'remove' end as state from documents d left join c on c.project_id=d.source and c.kinds=d.lang""")
def cache02(t):
    d = t.documents.select(F.col("doc_id").alias("key"), F.lit("v1").alias("schema"), F.col("source").alias("project_id"), F.col("lang").alias("kinds"), F.col("doc_id").alias("fingerprint"))
    cur = d.where("kinds <> 'es'").groupBy("schema", "project_id", "kinds").agg(F.max("fingerprint").alias("fingerprint"))
    return R.prune_states(d, cur).select("key", "state")


@query("cache03_missing", "select doc_id as key from documents where doc_id not in (select vec_id from embeddings)")
def cache03(t):
    return R.missing_keys(t.documents.select(F.col("doc_id").alias("key")), t.embeddings.select(F.col("vec_id").alias("key")))


@query("cache03_first_valid", "with c as (select o_custkey as key, o_orderkey as preference, o_orderstatus<>'F' as valid, o_totalprice as value from orders) select c_custkey as key, arg_min(value, preference) filter (valid) as value, min(preference) filter (valid) as preference from customer left join c on c.key=c_custkey group by 1")
def cache03v(t):
    c = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("preference"), (F.col("o_orderstatus") != "F").alias("valid"), F.col("o_totalprice").alias("value"))
    return R.first_valid(t.customer.select(F.col("c_custkey").alias("key")), c)[0]


# --- matching -----------------------------------------------------------------------------------------------------------

def matching_of(t):
    d = t.documents
    base = lambda name: M.basename(name)
    attrs = [F.lit("text").alias("asset_kind")]
    a = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), *attrs, F.when(F.col("doc_id") % 3 > 0, F.sha2("text", 256)).alias("hash"),
                 F.col("n_chars").alias("size"), base(F.concat(F.lit("dir/"), "source", F.lit("-"), F.expr("doc_id div 100"), F.lit(".txt"))).alias("base"), F.col("lang").alias("mime"), F.lit(None).cast("double").alias("duration"))
    c = d.select((F.col("doc_id") + 1_000_000).alias("id"), (-F.col("doc_id")).alias("position"), *attrs, F.when(F.col("doc_id") % 4 > 0, F.sha2("text", 256)).alias("hash"),
                 F.col("n_chars").alias("size"), base(F.concat("source", F.lit("-"), F.expr("doc_id div 100"), F.lit(".TXT"))).alias("base"), F.col("lang").alias("mime"), F.lit(None).cast("double").alias("duration"))
    return a, c


_REL = """a as (select doc_id as id, case when doc_id%3>0 then sha256(text) end as h, n_chars as sz, source||(doc_id//100) as b, lang as m from documents), c as (select doc_id+1000000 as id, -doc_id as pos, case when doc_id%4>0 then sha256(text) end as h, n_chars as sz, source||(doc_id//100) as b, lang as m from documents),
  sc as (select a.id, c.id as cid, c.pos, case when a.h is not null and c.h is not null then case when a.h=c.h then 1000 end else case when a.sz>0 and a.sz=c.sz then 120 else 0 end+case when a.b=c.b then 80 else 0 end+case when a.m=c.m then 20 else 0 end end as score from a, c)"""


@query("rel01_best_candidate", f"with {_REL}, b as (select id, max(score) as score from sc where score>=100 group by 1) select b.id, min(pos) as candidate, any_value(b.score) as score from b join sc on sc.id=b.id and sc.score=b.score group by b.id")
def rel01(t):
    return M.best_candidates(*matching_of(t)).select("id", "candidate", "score")


@query("rel02_match")
def rel02(t):
    return M.match(*matching_of(t))


# --- routing ------------------------------------------------------------------------------------------------------------

_RT = """b as (select s_suppkey as backend_id, unnest(case s_suppkey%3 when 0 then ['embed','generate'] when 1 then ['embed'] else ['generate','describe'] end) as operation, s_suppkey%4 as cost, case when s_suppkey%2=0 then 'local' else 'remote' end as location, s_suppkey%5=0 as trusted, (floor(s_acctbal)::bigint)%7 as priority from supplier),
  rq as (select o_orderkey as request_id, case o_orderkey%3 when 0 then 'embed' when 1 then 'generate' else 'describe' end as operation, o_orderkey%4 as max_cost, case o_orderkey%5 when 0 then 'local' when 1 then 'trusted' else 'any' end as data_policy, o_orderkey%2=0 as prefer_local from orders),
  po as (select distinct operation, max_cost, data_policy, prefer_local from rq),
  rk as (select po.*, backend_id, row_number() over (partition by operation, max_cost, data_policy, prefer_local order by case when prefer_local and location<>'local' then 1 else 0 end, priority desc, backend_id) as rank from po join b using (operation)
   where cost<=max_cost and (data_policy='any' or location='local' or (data_policy='trusted' and trusted)) and not (operation='embed' and backend_id%11=0))"""


def routing_of(t):
    b = t.supplier.select(F.col("s_suppkey").alias("backend_id"), F.expr("case s_suppkey%3 when 0 then array('embed','generate') when 1 then array('embed') else array('generate','describe') end as operations"),
                          (F.col("s_suppkey") % 4).alias("cost"), F.expr("if(s_suppkey%2=0,'local','remote') as location"), (F.col("s_suppkey") % 5 == 0).alias("trusted"), (F.floor("s_acctbal").cast("bigint") % 7).alias("priority"))
    r = t.orders.select(F.col("o_orderkey").alias("request_id"), F.expr("case o_orderkey%3 when 0 then 'embed' when 1 then 'generate' else 'describe' end as operation"), (F.col("o_orderkey") % 4).alias("max_cost"),
                        F.expr("case o_orderkey%5 when 0 then 'local' when 1 then 'trusted' else 'any' end as data_policy"), (F.col("o_orderkey") % 2 == 0).alias("prefer_local"))
    denied = t.supplier.where("s_suppkey%11=0").select(F.lit("embed").alias("operation"), F.col("s_suppkey").alias("backend_id"))
    return r, M.eligible(r, b, denied)


@query("rt01_eligible", f"with {_RT} select operation, max_cost, data_policy, prefer_local, backend_id, rank from rk")
def rt01(t):
    return routing_of(t)[1]


_OUT = "oc as (select l_orderkey as request_id, l_suppkey as backend_id, case min(l_returnflag) when 'A' then 'ok' when 'N' then 'unsupported' else 'error' end as outcome from lineitem group by all)"


@query("rt02_fallback", f"""with {_RT}, {_OUT}, x as (select oc.*, rk.rank from oc join rq using (request_id) join rk on rk.operation=rq.operation and rk.max_cost=rq.max_cost and rk.data_policy=rq.data_policy and rk.prefer_local=rq.prefer_local and rk.backend_id=oc.backend_id),
  s as (select request_id, min(rank) filter (outcome<>'unsupported') as stop from x group by 1)
  select x.request_id, max(backend_id) filter (rank=stop) as backend_id, coalesce(max(outcome) filter (rank=stop),'unsupported') as outcome, count(*) filter (stop is null or rank<=stop) as attempts from x join s using (request_id) group by 1""")
def rt02(t):
    r, ranking = routing_of(t)
    outcome = F.expr("case min(l_returnflag) when 'A' then 'ok' when 'N' then 'unsupported' else 'error' end")
    oc = t.lineitem.groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("backend_id")).agg(outcome.alias("outcome"))
    return M.resolve(r, ranking, oc)


_ATT = "att as (select user_id as backend_id, event_id, epoch_us(ts)//1000 as at_, case when event_id%7<4 then 'failure' when event_type='view' then 'success' else 'unsupported' end as result, value as duration_ms from events)"


def attempts_of(t):
    from ..sources.tables import micros
    return t.events.select(F.col("user_id").alias("backend_id"), "event_id", F.expr(f"{micros('ts')} div 1000 as at"),
                           F.expr("case when event_id%7<4 then 'failure' when event_type='view' then 'success' else 'unsupported' end as result"), F.col("value").alias("duration_ms"))


@query("rt03_health", f"with {_ATT} select backend_id, count(*) filter (result='success') as successes, count(*) filter (result='failure') as failures, count(*) filter (result='unsupported') as unsupported, round(avg(duration_ms),6) as mean_ms from att group by 1")
def rt03(t):
    return M.health(attempts_of(t)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("rt04_quarantine", f"""with {_ATT}, c as (select *, sum(case when result='failure' then 1 else 0 end) over w as f from att window w as (partition by backend_id order by at_, event_id)),
  d as (select *, f-coalesce(last_value(case when result='success' then f end ignore nulls) over (partition by backend_id order by at_, event_id),0) as consecutive from c),
  m as (select *, case when result='success' then 0 when result='failure' then case when consecutive>=3 then at_+40000000 else 0 end end as mark from d)
  select event_id, consecutive::bigint as consecutive, coalesce(last_value(mark ignore nulls) over w,0)::bigint as until, coalesce(last_value(mark ignore nulls) over (partition by backend_id order by at_, event_id rows between unbounded preceding and 1 preceding),0)<=at_ as allowed from m window w as (partition by backend_id order by at_, event_id)""")
def rt04(t):
    return M.quarantine(attempts_of(t), ["at", "event_id"], span_of("at", 86400e3), 3, 40_000_000).select("event_id", "consecutive", "until", "allowed")


@query("udf03_verifier", "select event_id, length(props)%2=0 as verified from events")
def udf03(t):
    """A user verifier as a vectorised boolean UDF."""
    from ..functions.udf import verifier
    check = verifier(lambda text: len(text) % 2 == 0)
    return t.events.select("event_id", check("props").alias("verified"))


@query("udf02_custom_fold", "select user_id as project_id, count(*) as entries, round(sum(value),4) as total from events group by 1")
def udf02(t):
    """A user fold over each log, streamed in order; only the last row of each project is kept."""
    from ..functions.udf import replay_with
    ops = t.v_ops.select("project_id", "seq", "value")
    out = replay_with(ops, ["project_id"], ["seq"], lambda: (0, 0.0), lambda s, row: (s[0] + 1, s[1] + row[0]), ["value"], "entries bigint, total double")
    return out.groupBy("project_id").agg(F.max("entries").alias("entries"), F.round(F.max_by("total", "seq"), 4).alias("total"))


@query("udf05_sql_names", "select doc_id, length(text) as n from documents")
def udf05(t):
    """The shipped UDFs called from SQL text by name."""
    H.register_sql(t.spark)
    from ..functions.text import nfkc_udf
    t.spark.udf.register("nfkc", nfkc_udf)
    return t.sql("select doc_id, cast(length(nfkc(text)) as bigint) as n from {docs}", docs=t.documents)
