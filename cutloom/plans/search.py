"""Lexical, vector and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.text import tokens
from ..operators import lexindex as L, privacy, search as S, vectors as V
from ..session import durable
from ..streaming.stores import new_folder
from .registry import query

FIELDS = [S.Field("name", 10, "name"), S.Field("kind", 4, "kind"), S.Field("text", 4, "props:text")]
QUERIES = {"q1": "src3 the", "q2": "of the and", "q3": "SRC7", "q4": "rc1", "q5": "para el en"}

_POSTINGS = """
  toks as (select id, kind, name, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) as term, 10 as weight, 'name' as source from v_docs
    union all select id, kind, name, unnest(regexp_extract_all(lower(kind), '[\\p{L}\\p{N}]+')), 4, 'kind' from v_docs
    union all select id, kind, name, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), 4, 'props:text' from v_docs),
  postings as materialized (select id, kind, name, term, cast(max(weight) as bigint) as weight,
    string_agg(distinct source, ',' order by source) as sources from toks group by all)"""

_QUERIES = "queries(query, qt) as (values ('q1','src3 the'),('q2','of the and'),('q3','src7'),('q4','rc1'),('q5','para el en'))"
_SCORED = f"""{_POSTINGS}, {_QUERIES},
  qterms as (select distinct query, unnest(string_split(qt,' ')) as term from queries),
  qn as (select query, count(*) as n from qterms group by query),
  hits as (select q.query, p.id, sum(p.weight) as pts, count(*) as n, string_agg(p.term, ' ' order by p.term) as matched
    from postings p join qterms q using (term) group by all),
  bonus as (select query, id, case when lower(name)=qt then 20 else 8 end as pts from v_docs, queries
    where lower(name)=qt or (length(qt)>=2 and contains(lower(name), qt))),
  scored as (select coalesce(h.query,b.query) as query, coalesce(h.id,b.id) as id, coalesce(h.matched,'') as matched,
    cast(coalesce(h.pts,0)+coalesce(b.pts,0)+case when h.n=qn.n and qn.n>1 then 4 else 0 end as bigint) as score
    from hits h full join bonus b on h.query=b.query and h.id=b.id join qn on qn.query=coalesce(h.query,b.query)),
  ranked as (select s.query, s.id, d.kind, d.name, s.score, s.matched,
    row_number() over (partition by s.query order by s.score desc, d.name, s.id) as rank
    from scored s join v_docs d on d.id=s.id where s.score>=1)"""


@query("lex01_tokens", r"""select term, count(*) as n, count(distinct id) as docs from
  (select id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from v_docs) group by term""")
def lex01(t):
    per_doc = t.v_docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").count()
    return per_doc.groupBy("term").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


@query("lex02_postings", f"with {_POSTINGS} select id, term, weight, sources from postings")
def lex02(t):
    return S.build_postings(t.v_docs, FIELDS).select("id", "term", "weight", F.array_join("sources", ",").alias("sources"))


@query("lex02_relation_terms", """with ends as (select src as id, dst as other, type from v_edges union all
  select dst, src, type from v_edges),
  texts as (select id, type as x from ends union select e.id, n.name from ends e join v_nodes n on n.id=e.other
    union select e.id, n.kind from ends e join v_nodes n on n.id=e.other)
  select distinct id, unnest(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+')) as term, cast(3 as bigint) as weight,
    'relationships' as source from texts""")
def lex02r(t):
    return S.relation_emissions(t.v_nodes, t.v_edges)


_GRAPH_TOKS = r"""
  n as (select id, kind, case when id in ('N1','N2') or (kind='asset' and right(id,1)='{renamed}') then name||' renamed' else name end as name from v_nodes union all select object_id, 'object', name from v_objects),
  e as (select src, dst, type, null as role from v_edges union all select object_id, 'P'||substr(object_id,2), 'relates-to', 'shown in' from v_objects),
  o as (select *, {{'main color': string_split(name,' ')[1], 'size class': tags[2]}} as semantics from v_objects),
  w as (select id, unnest(regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+')) as term, 10 as weight, 'name' as source from n
    union select id, unnest(regexp_extract_all(lower(kind), '[\p{{L}}\p{{N}}]+')), 4, 'kind' from n
    union select object_id, unnest(regexp_extract_all(lower(object_type), '[\p{{L}}\p{{N}}]+')), 8, 'object:type' from o
    union select object_id, unnest(regexp_extract_all(lower(semantic_id), '[\p{{L}}\p{{N}}]+')), 6, 'object:semanticId' from o
    union select object_id, unnest(regexp_extract_all(lower(array_to_string(tags,' ')), '[\p{{L}}\p{{N}}]+')), 7, 'object:tags' from o
    union select object_id, unnest(['main','color','size','class']), 4, 'object:semantics:key' from o
    union select object_id, unnest(regexp_extract_all(lower(string_split(name,' ')[1]), '[\p{{L}}\p{{N}}]+')), 5, 'object:semantics:main color' from o
    union select object_id, unnest(regexp_extract_all(lower(tags[2]), '[\p{{L}}\p{{N}}]+')), 5, 'object:semantics:size class' from o
    union select id, unnest(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+')), 3, 'relationships' from (
      select src as id, type as x from e union select dst, type from e union select src, role from e union select dst, role from e
      union select src, name from e join n on n.id=dst union select src, kind from e join n on n.id=dst union select dst, name from e join n on n.id=src union select dst, kind from e join n on n.id=src)),
  gp as (select id, term, max(weight)::bigint as weight, string_agg(distinct source, ',' order by source) as sources from w where id in (select id from n) group by all)"""


def graph_of(t):
    """The graph with objects that show parts; objects have nested semantics."""
    o = t.v_objects.select(F.col("object_id").alias("id"), F.lit("object").alias("kind"), "name", "object_type", "semantic_id", "tags", F.create_map(
        F.lit("main color"), F.split("name", " ")[0], F.lit("size class"), F.col("tags")[1]).alias("semantics"))
    nodes = t.v_nodes.unionByName(o, allowMissingColumns=True)
    shown = t.v_objects.select(F.col("object_id").alias("src"), F.concat(F.lit("P"), F.expr("substring(object_id, 2)")).alias("dst"),
                               F.lit("relates-to").alias("type"), F.lit("shown in").alias("role"))
    return nodes, t.v_edges.unionByName(shown, allowMissingColumns=True)


def renamed(nodes, digit):
    return nodes.withColumn("name", F.when(F.expr(f"id in ('N1', 'N2') or (kind = 'asset' and right(id, 1) = '{digit}')"), F.concat("name", F.lit(" renamed"))).otherwise(F.col("name")))


@query("lex02_index", f"with {_GRAPH_TOKS.format(renamed='-').replace(chr(39) + 'N1' + chr(39) + ',' + chr(39) + 'N2' + chr(39), chr(39) * 2)} select * from gp")
def lex02i(t):
    """The stored index, read back: own, nested and relation terms in one."""
    nodes, edges = graph_of(t)
    index = L.StoredIndex(t.spark, new_folder(t.spark, "lex02"), 8)
    index.add(L.graph_postings(nodes, edges), nodes)
    return index.rows().select("id", "term", "weight", F.array_join("sources", ",").alias("sources"))


@query("lex02_index_update", f"with {_GRAPH_TOKS.format(renamed='7')} select * from gp where term in ('renamed','red','lemon','argentina','composition','contains')")
def lex02u(t):
    """Names change: only the documents named and those next to them are indexed anew; a lookup reads the buckets of its terms."""
    nodes, edges = (durable(x) for x in graph_of(t))
    index = L.StoredIndex(t.spark, new_folder(t.spark, "lex02u"), 8)
    index.add(L.graph_postings(nodes, edges), nodes)
    index.update(renamed(nodes, "7"), edges, nodes.where("id in ('N1', 'N2') or (kind = 'asset' and right(id, 1) = '7')"))
    return index.rows(["renamed", "red", "lemon", "argentina", "composition", "contains"]).select(
        "id", "term", "weight", F.array_join("sources", ",").alias("sources"))


@query("lex02_relation_search", f"""with {_GRAPH_TOKS.format(renamed='-').replace(chr(39) + 'N1' + chr(39) + ',' + chr(39) + 'N2' + chr(39), chr(39) * 2)},
  q(query, term, qt) as (values ('r1','argentina','argentina track'), ('r1','track','argentina track'), ('r2','shown','shown size3'), ('r2','size3','shown size3'), ('r3','canada','canada')),
  h as (select query, any_value(qt) as qt, id, sum(weight) as pts, count(*) as n from q join gp using (term) group by query, id), k as (select query, count(*) as k from q group by 1),
  s as (select query, h.id, n.kind, n.name, (pts+case when lower(name)=qt then 20 when contains(lower(name), qt) then 8 else 0 end+case when h.n=k.k and k.k>1 then 4 else 0 end)::bigint as score from h join k using (query) join n on n.id=h.id)
  select query, id, score, row_number() over (partition by query order by score desc, name, id) as rank from s qualify rank<=20""")
def lex02s(t):
    """Nodes found by what they are linked to, through the stored index."""
    nodes, edges = graph_of(t)
    index = L.StoredIndex(t.spark, new_folder(t.spark, "lex02s"), 8)
    index.add(L.graph_postings(nodes, edges), nodes)
    queries = {"r1": "argentina track", "r2": "shown size3", "r3": "canada"}
    rows = index.rows(sorted({x for q in queries.values() for x in S.query_terms(q)}))
    return S.top_k(S.score(t.spark, rows, nodes, queries), 20).select("query", "id", "score", "rank")


@query("lex03_score", f"with {_SCORED} select query, id, score, matched from scored where score>=1")
def lex03(t):
    only = sorted({x for text in QUERIES.values() for x in S.query_terms(text)})
    p = S.build_postings(t.v_docs, FIELDS, only=only)
    return S.score(t.spark, p, t.v_docs, QUERIES).select("query", "id", "score", F.array_join("matched", " ").alias("matched"))


@query("lex04_rank", f"with {_SCORED} select query, id, kind, name, score, rank, matched from ranked where rank<=20")
def lex04(t):
    return S.search(t.v_docs, FIELDS, QUERIES, 20).select(
        "query", "id", "kind", "name", "score", "rank", F.array_join("matched", " ").alias("matched"))


@query("lex04_kind_filter", f"""with {_SCORED}, k as (select query, id, score,
  row_number() over (partition by query order by score desc, name, id) as rank from ranked where kind in ('de','fr'))
  select * from k where rank<=10""")
def lex04k(t):
    return S.search(t.v_docs, FIELDS, QUERIES, 10, kinds=["de", "fr"]).select("query", "id", "score", "rank")


# of the postings only query terms are needed: nothing else is aggregated
_FEW = _SCORED.replace("from toks group by all", "from toks where term in (select unnest(string_split(qt,' ')) from queries) group by all").replace(f", {_QUERIES}", "")


@query("lex04_evidence", f"""with {_QUERIES}, {_FEW} select r.query, r.id, p.term, unnest(string_split(p.sources, ',')) as source
  from ranked r join qterms q on q.query=r.query join postings p on p.id=r.id and p.term=q.term where r.rank<=20""")
def lex04e(t):
    only = sorted({x for text in QUERIES.values() for x in S.query_terms(text)})
    p = S.build_postings(t.v_docs, FIELDS, only=only)
    ranked = S.top_k(S.score(t.spark, p, t.v_docs, QUERIES), 20)
    return S.evidence(ranked, p)


@query("lex05_integrity", f"""with {_POSTINGS} select cast(count(*) as bigint) as postings, cast(count(distinct id) as bigint) as docs,
  cast(sum(case when weight<=0 or weight>100 then 1 else 0 end) as bigint) as violations from postings""")
def lex05(t):
    p = S.build_postings(t.v_docs, FIELDS)
    totals = p.groupBy("id").count().agg(F.sum("count").alias("postings"), F.count("*").alias("docs"))
    v = S.index_violations(p).agg(F.count("*").alias("violations"))
    return totals.crossJoin(F.broadcast(v))  # one row each


_CENTROIDS = """cent as (select label, list(m order by pos) as vec from (select label, pos, avg(x) as m from
  (select label, unnest(embedding)::double as x, generate_subscripts(embedding,1) as pos from embeddings) group by all) group by label)"""


def index_of(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"),
                               F.concat(F.lit("v"), F.col("vec_id") % 7).alias("name"),
                               F.col("embedding").alias("vector"))


def centroids_of(t):
    """One query vector per label: the label's mean vector (labels are a small fixed set)."""
    n = F.count("*")
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector")
                                  ).select(F.col("label").cast("string").alias("query"), "vector")


@query("vec01_cosine", """with c as (select list(m order by pos) as vec from (select pos, avg(x) as m from
  (select unnest(embedding)::double as x, generate_subscripts(embedding,1) as pos from embeddings) group by pos))
  select vec_id, round(list_cosine_similarity(embedding::double[], c.vec), 6) as score from embeddings, c""")
def vec01(t):
    mean = t.embeddings.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vec"))
    return t.embeddings.crossJoin(F.broadcast(mean)).select(  # one-row side: a single mean vector
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("vec")), 6).alias("score"))


@query("vec02_topk", f"""with {_CENTROIDS}, s as (select cast(c.label as varchar) as query, e.vec_id as id, 'v'||(e.vec_id%7) as name,
  list_cosine_similarity(e.embedding::double[], c.vec) as score from embeddings e, cent c),
  r as (select query, id, round(score,6) as score, row_number() over (partition by query order by score desc, name, id) as rank from s)
  select * from r where rank<=10""")
def vec02(t):
    return V.vector_top_k(index_of(t), centroids_of(t), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("vec02_kind_min", f"""with {_CENTROIDS}, s as (select cast(c.label as varchar) as query, e.vec_id as id, 'v'||(e.vec_id%7) as name,
  list_cosine_similarity(e.embedding::double[], c.vec) as score from embeddings e, cent c where e.label in (1,2,3)),
  r as (select query, id, round(score,6) as score, row_number() over (partition by query order by score desc, name, id) as rank from s where score>=0.1)
  select * from r where rank<=10""")
def vec02k(t):
    return V.vector_top_k(index_of(t), centroids_of(t), 10, 0.1, ["1", "2", "3"]).select(
        "query", "id", F.round("score", 6).alias("score"), "rank")


_EMBED = """{name}_w as (select {id}, unnest(string_split_regex(trim(text, ' '||chr(10)), '[ \n]+')) as term from {texts}),
  {name}_v as (select {id}, (('0x'||md5(term)[1:8])::bigint)%16 as pos, sum(case when (('0x'||md5(term)[1:8])::bigint//1024)%2=1 then 1.0::double else -1.0::double end) as x from {name}_w group by all),
  {name}_n as (select {id}, sqrt(sum(x*x)) as n from {name}_v group by all)"""
_DOC_TEXT = f"""{_POSTINGS}, tb as (select id, string_agg(term, ' ' order by term) as body from (select id, term from postings) group by id),
  dt as (select d.id, d.kind, d.name, d.name||chr(10)||d.kind||chr(10)||coalesce(body,'') as text from v_docs d left join tb using (id))"""


@query("vec03_embed", f"""with {_DOC_TEXT}, {_EMBED.format(name='e', id='id', texts='dt')}, p as (select id, pos, case when n>0 then x/n else 0 end as x from e_v join e_n using (id))
  select d.id, d.kind, 16::bigint as dims, round(sum(x*x),6) as norm, round(coalesce(sum(x) filter (pos=0),0),6) as first, round(coalesce(sum(x) filter (pos=15),0),6) as last from v_docs d join p using (id) group by all""")
def vec03(t):
    out = V.embed(V.text_of_terms(S.document_terms(t.v_docs, FIELDS)), V.hash_model(16))
    return out.select("id", "kind", F.size("vector").cast("bigint").alias("dims"), F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("norm"),
                      F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[15], 6).alias("last"))


@query("vec03_text", f"""with {_POSTINGS}, tt as (select id, string_agg(term, ' ' order by term) as body from
  (select id, term from postings) group by id)
  select d.id, d.kind, d.name, d.name||chr(10)||d.kind||chr(10)||coalesce(body,'') as text from v_docs d left join tt using (id)""")
def vec03t(t):
    return V.text_of_terms(S.document_terms(t.v_docs, FIELDS))


_HYBRID_Q = {"h1": "src3 the", "h2": "of the and"}


@query("vec04_hybrid", f"""with {_SCORED},
  lex as (select query, id, row_number() over (partition by query order by score desc, name, id) as rank from ranked where query in ('q1','q2')),
  c as (select list(m order by pos) as vec from (select pos, avg(x) as m from
    (select unnest(embedding)::double as x, generate_subscripts(embedding,1) as pos from embeddings) group by pos)),
  es as (select d.id, d.name, list_cosine_similarity(e.embedding::double[], c.vec) as score from embeddings e join v_docs d on d.id=e.vec_id, c),
  em as (select id, row_number() over (order by score desc, name, id) as rank from es),
  parts as (select query, id, 1.0::double/(60+rank) as p from lex where rank<=40
    union all select q.query, em.id, 1.0::double/(60+rank) from em, (values ('q1'),('q2')) q(query) where rank<=40),
  f as (select query, id, sum(p) as score from parts group by all),
  fr as (select f.query, f.id, d.kind, d.name, round(f.score,6) as score,
    row_number() over (partition by f.query order by round(f.score,12) desc, d.name, f.id) as rank from f join v_docs d using (id))
  select * from fr where rank<=10""")
def vec04(t):
    lex = S.search(t.v_docs, FIELDS, {"q1": QUERIES["q1"], "q2": QUERIES["q2"]}, 40)
    docs = t.v_docs.select("id", "kind", "name")
    index = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(docs, "id")
    mean = t.embeddings.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))
    qs = mean.select(F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("query"), "vector")
    em = V.vector_top_k(index, qs, 40)
    return V.fuse(lex, em, 10).select("query", "id", "kind", "name", F.round("score", 6).alias("score"), "rank")


@query("vec05_validation", """select vec_id as id, 'dimension-mismatch' as code from embeddings,
  (select len(embedding) as n from embeddings group by 1 order by count(*) desc, 1 desc limit 1) where len(embedding)<>n
  union all select vec_id, 'non-finite' from embeddings where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))>0
  union all select vec_id, 'empty' from embeddings where embedding is null or len(embedding)=0
  union all select vec_id, 'duplicate-id' from embeddings group by vec_id having count(*)>1""")
def vec05(t):
    return V.vector_violations(index_of(t))


@query("vec06_query_embedding", f"""with {_DOC_TEXT}, {_EMBED.format(name='e', id='id', texts='dt')}, kt as (select kind, term from (select kind, term, row_number() over (partition by kind order by count(*) desc, term) as rn from postings group by kind, term) where rn<=8),
  qt as (select kind, string_agg(term, ' ' order by term) as text from kt group by 1), {_EMBED.format(name='q', id='kind', texts='qt')},
  s as (select q.kind as query, e.id, round(sum(q.x*e.x)/(any_value(qn.n)*any_value(en.n)), 6) as score from q_v q join e_v e using (pos) join e_n en on en.id=e.id join q_n qn on qn.kind=q.kind group by q.kind, e.id)
  select query, s.id, score, row_number() over (partition by query order by score desc, d.name, s.id) as rank from s join v_docs d on d.id=s.id qualify rank<=10""")
def vec06(t):
    """Documents of each language searched with the language's own embedded text, same model as the index."""
    d = durable(S.document_terms(t.v_docs, FIELDS))  # texts are cut into terms once, for the index and for the queries
    index = V.embed(V.text_of_terms(d), V.hash_model(16))
    df = d.select("kind", F.explode("terms").alias("term")).groupBy("kind", "term").count()
    w = W.partitionBy("kind").orderBy(F.desc("count"), "term")
    top = df.withColumn("rn", F.row_number().over(w)).where("rn <= 8")
    texts = top.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("text"))
    qs = V.embed(texts, V.hash_model(16)).select(F.col("kind").alias("query"), "vector")
    return V.vector_top_k(index, qs, 10, digits=6).select("query", "id", "score", "rank")


@query("vec07_source_fingerprint", f"""with {_POSTINGS}, tt as (select id, string_agg(term, ' ' order by term) as body from
  (select id, term from postings) group by id),
  h as (select d.kind, d.id, sha256(d.id||':'||d.name||chr(10)||d.kind||chr(10)||coalesce(body,'')) as h
    from v_docs d left join tt using (id))
  select kind, lower(hex(bit_xor(('0x'||left(h,15))::bigint))) as fingerprint, count(*) as docs from h group by kind""")
def vec07(t):
    """Order-free fingerprint per kind: row digests folded with XOR, so no ordered list of a kind is ever built."""
    text = V.text_of_terms(S.document_terms(t.v_docs, FIELDS))
    h = text.select("kind", F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), "text"), 256), 1, 15), 16, 10)
                    .cast("bigint").alias("h"))
    return h.groupBy("kind").agg(F.lower(F.hex(F.bit_xor("h"))).alias("fingerprint"), F.count("*").alias("docs"))


@query("prv01_mask", """with a as (select d.*, case when l.toxic=1 then 'none' when l.quality=0 then 'metadata' else 'full' end as access
  from v_docs d left join labels l on l.doc_id=d.id)
  select id, kind, name, access, case when access='metadata' then null else text end as text from a where access<>'none'""")
def prv01(t):
    access = F.when(F.col("toxic") == 1, "none").when(F.col("quality") == 0, "metadata").otherwise("full")
    rows = t.v_docs.join(t.labels, F.col("doc_id") == F.col("id"), "left").withColumn("access", access).drop(
        "doc_id", "quality", "toxic")
    return privacy.mask(rows, "access", ["text"])


@query("prv01_masked_search", f"""with a as (select d.*, case when l.toxic=1 then 'none' when l.quality=0 then 'metadata' else 'full' end as access
  from documents d left join labels l on l.doc_id=d.doc_id),
  toks as (select doc_id as id, source as name, unnest(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+')) as term, 10 as weight from a where access<>'none'
    union all select doc_id, source, lang, 4 from a where access<>'none'
    union all select doc_id, source, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), 4 from a where access='full'),
  p as (select id, name, term, max(weight) as weight from toks group by all),
  s as (select id, name, sum(weight)+case when count(*)=3 then 4 else 0 end as score from p where term in ('of','the','and') group by all),
  r as (select id, cast(score as bigint) as score, row_number() over (order by score desc, name, id) as rank from s)
  select * from r where rank<=20""")
def prv01s(t):
    return S.search(prv01(t), FIELDS, {"q": "of the and"}, 20).select("id", "score", "rank")
