"""Lexical search: postings, scoring and ranking as joins and aggregates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.text import normalized, tokens
from .scan import union_all

# Scoring constants and limits.
EXACT_NAME_BONUS, PART_NAME_BONUS, ALL_TERMS_BONUS = 20, 8, 4
MAX_QUERY_TERMS, MAX_QUERY_CHARS, MAX_RESULTS = 128, 4096, 200
RELATION_WEIGHT = 3
MAX_QUERIES = 128


@dataclass(frozen=True)
class Field:
    """A searchable column: its weight and the evidence label it leaves."""

    column: str
    weight: int
    source: str


def _field_terms(fields: Sequence[Field], max_terms: int | None, only: Sequence[str] | None) -> list[Column]:
    """Distinct terms per field of one row; the cap counts repeats in field order."""
    parts, used = [], F.lit(0)
    for f in fields:
        terms = F.coalesce(tokens(F.col(f.column).cast("string")), F.array().cast("array<string>"))
        if max_terms is not None:
            terms = F.slice(terms, F.lit(1), F.greatest(F.lit(0), F.lit(max_terms) - used))
            used = used + F.size(terms)
        parts.append(F.array_distinct(terms) if only is None else F.array_intersect(terms, F.lit(list(only)).cast("array<string>")))
    return parts


def build_postings(docs: DataFrame, fields: Sequence[Field], max_terms: int | None = None,
                   only: Sequence[str] | None = None) -> DataFrame:
    """(id, kind, name, term, weight, sources): the largest weight and all evidence labels of each term of a document.

    One row is one document, so the merge over fields happens inside the row and nothing is shuffled. The last field is
    taken to be the long one: its own terms need no lookup, the few terms of the other fields are checked against it.
    ``only`` keeps the given terms before anything is exploded (search without a stored index).
    """
    parts = _field_terms(fields, max_terms, only)
    names = [f"f{i}" for i in range(len(fields))]
    # explode of a one-element array evaluates the tokens once per row; a plain projection could be inlined again below
    cells = docs.select("id", "kind", "name", F.explode(F.array(F.struct(*[p.alias(n) for p, n in zip(parts, names)]))).alias("t"))
    short = F.array_distinct(F.concat(*[F.col(f"t.{n}") for n in names[:-1]])) if len(names) > 1 else F.array().cast("array<string>")
    # which short terms each field holds: small arrays, safe to use inside the lambda below
    held = [F.array_intersect(F.col("s"), F.col(f"t.{n}")).alias(n) for n in names]
    x = cells.select("id", "kind", "name", F.col("t"), F.explode(F.array(F.struct(short.alias("s")))).alias("b")).select(
        "id", "kind", "name", "t", "b.s")
    x = x.select("id", "kind", "name", F.explode(F.array(F.struct(
        F.array_except(F.col(f"t.{names[-1]}"), "s").alias("rest"), "s", *held))).alias("h"))
    order = sorted(range(len(fields)), key=lambda i: fields[i].source)

    def merged(term):
        has = [F.array_contains(F.col(f"h.{n}"), term) for n in names]
        return F.struct(term.alias("term"), F.greatest(*[F.when(h, f.weight).otherwise(0) for h, f in zip(has, fields)], F.lit(0)).cast("bigint").alias("weight"),
                        F.array_compact(F.array(*[F.when(has[i], F.lit(fields[i].source)) for i in order])).alias("sources"))

    last = fields[-1]
    own = lambda term: F.struct(term.alias("term"), F.lit(last.weight).cast("bigint").alias("weight"), F.array(F.lit(last.source)).alias("sources"))
    e = x.select("id", "kind", "name", F.explode(F.concat(F.transform("h.rest", own), F.transform("h.s", merged))).alias("e"))
    return e.select("id", "kind", "name", "e.term", "e.weight", "e.sources")


def document_terms(docs: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """(id, kind, name, terms): the distinct terms of all fields in order; one row is one document, so nothing is shuffled."""
    terms = F.sort_array(F.array_distinct(F.concat(*_field_terms(fields, None, None))))
    return docs.select("id", "kind", "name", terms.alias("terms"))


def nested_emissions(docs: DataFrame, column: str, weight: int, source: str) -> DataFrame:
    """(id, term, weight, source) of a map column: keys count one less, values carry ``source:key``."""
    kv = docs.select("id", F.explode(column).alias("k", "v"))
    key_terms = kv.select("id", F.explode(tokens(F.col("k"))).alias("term"),
                          F.lit(max(1, weight - 1)).cast("bigint").alias("weight"), F.lit(f"{source}:key").alias("source"))
    val_terms = kv.select("id", F.explode(tokens(F.col("v").cast("string"))).alias("term"),
                          F.lit(weight).cast("bigint").alias("weight"), F.concat(F.lit(f"{source}:"), "k").alias("source"))
    return key_terms.unionByName(val_terms)


def relation_emissions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms a node gets from its edges: edge type, role, and the name and kind of the other end, both directions.

    Names and kinds are cut into words once per node, not once per edge, and travel as words; kept distinct per (node, term) before the
    shuffle, so a hub with very many edges folds map-side.
    """
    role = F.col("role") if "role" in edges.columns else F.lit(None).cast("string")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")),
                                          F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("x"),
                        "type", role.alias("role")).select("x.*", "type", "role")
    words = F.array_distinct(tokens(F.concat_ws("\n", F.col("name").cast("string"), F.col("kind").cast("string"))))
    other = nodes.select(F.col("id").alias("other"), words.alias("__words"))
    named = ends.select("id", "other").join(other, "other").select("id", F.explode("__words").alias("term"))
    said = ends.select("id", F.explode(F.array("type", "role")).alias("x")).where("x is not null").distinct().select("id", F.explode(tokens(F.col("x"))).alias("term"))
    return named.unionByName(said).distinct().withColumn("weight", F.lit(RELATION_WEIGHT).cast("bigint")).withColumn("source", F.lit("relationships"))


def relation_words(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, words): what a node gets from an edge, as ``relation_emissions`` has it, one row for each end of an edge and its words in one text.

    Types, roles, names and kinds are cut into words before they are joined by blanks. Of edges with ``src_told`` and ``dst_told`` only ends
    where these hold get a row.
    """
    text = lambda *parts: F.array_join(F.array_distinct(tokens(F.concat_ws("\n", *(F.col(p).cast("string") for p in parts)))), " ")
    ends = [F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a, b in (("src", "dst"), ("dst", "src"))]
    if "src_told" in edges.columns:
        ends = [F.when(F.col(told), end) for end, told in zip(ends, ("src_told", "dst_told"))]
    said = edges.select("src", "dst", *(c for c in ("src_told", "dst_told") if c in edges.columns),
                        text("type", *(["role"] if "role" in edges.columns else [])).alias("__said"))
    rows = said.select(F.explode(F.array_compact(F.array(*ends))).alias("x"), "__said").select("x.*", "__said")
    other = nodes.select(F.col("id").alias("other"), text("name", "kind").alias("__words"))
    return rows.join(other, "other", "left").select("id", F.concat_ws(" ", "__words", "__said").alias("words"))


def normalize_query(text: str) -> str:
    if len(text) > MAX_QUERY_CHARS:
        raise ValueError(f"query exceeds {MAX_QUERY_CHARS} characters")
    return unicodedata.normalize("NFKC", text).lower().strip()


def query_terms(text: str) -> list[str]:
    found = list(dict.fromkeys(w for w in re.split(r"[\W_]+", normalize_query(text)) if w))
    if len(found) > MAX_QUERY_TERMS:
        raise ValueError(f"query exceeds {MAX_QUERY_TERMS} unique terms")
    return found


def score(spark: SparkSession, postings: DataFrame, docs: DataFrame, queries: Mapping[str, str],
          kinds: Sequence[str] | None = None, minimum: float = 1) -> DataFrame:
    """(query, id, kind, name, score, matched): one row per query and document at or above ``minimum``.

    A block of at most ``MAX_QUERIES`` queries has at most 128 terms each, so its terms are broadcast and the name bonuses
    are a projection over ``docs``; both meet in one aggregate keyed by (query, id). Longer lists run block by block.
    """
    if len(queries) > MAX_QUERIES:
        names = list(queries)
        blocks = [{q: queries[q] for q in names[i:i + MAX_QUERIES]} for i in range(0, len(names), MAX_QUERIES)]
        return union_all([score(spark, postings, docs, b, kinds, minimum) for b in blocks])
    terms = {q: query_terms(text) for q, text in queries.items()}
    rows = [(q, t) for q, ts in terms.items() for t in ts]
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField("term", T.StringType())])
    wanted = spark.createDataFrame(rows, schema)
    if kinds is not None:
        postings, docs = postings.where(F.col("kind").isin(*kinds)), docs.where(F.col("kind").isin(*kinds))
    hits = postings.join(F.broadcast(wanted), "term").select(
        "query", "id", "kind", "name", F.col("weight").cast("bigint").alias("points"), "term")
    bonus = name_bonuses(docs, {q: normalize_query(t) for q, t in queries.items() if terms[q]})
    both = hits.unionByName(bonus, allowMissingColumns=True)
    n_terms = F.element_at(F.create_map(*[x for q, ts in terms.items() for x in (F.lit(q), F.lit(len(ts)))]),
                           F.col("query"))
    agg = both.groupBy("query", "id", "kind", "name").agg(
        F.sum("points").alias("points"), F.sort_array(F.collect_set("term")).alias("matched"))
    full = F.when((F.size("matched") == n_terms) & (n_terms > 1), ALL_TERMS_BONUS).otherwise(0)
    out = agg.select("query", "id", "kind", "name", (F.col("points") + full).cast("bigint").alias("score"), "matched")
    return out.where(F.col("score") >= minimum)


def name_bonuses(docs: DataFrame, queries: Mapping[str, str]) -> DataFrame:
    """Bonus points for documents whose name equals or contains a query text."""
    name = F.col("__norm")
    each = F.array(*[F.struct(
        F.lit(q).alias("query"),
        F.when(name == text, EXACT_NAME_BONUS).when(
            name.contains(text) if len(text) >= 2 else F.lit(False), PART_NAME_BONUS).otherwise(0)
        .cast("bigint").alias("points")) for q, text in queries.items()])
    base = docs.select("id", "kind", "name", normalized(F.col("name")).alias("__norm"))
    return base.select("id", "kind", "name", F.explode(F.filter(each, lambda e: e["points"] > 0)).alias("e")).select(
        "e.query", "id", "kind", "name", "e.points")


def top_k(scored: DataFrame, limit: int = 20) -> DataFrame:
    """Best ``limit`` rows per query by score, name, id, with ``rank`` (pruned map-side before the shuffle)."""
    if not 1 <= limit <= MAX_RESULTS:
        raise ValueError(f"limit must be between 1 and {MAX_RESULTS}")
    w = W.partitionBy("query").orderBy(F.desc("score"), "name", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn(
        "rank", F.col("rank").cast("bigint"))


def search(docs: DataFrame, fields: Sequence[Field], queries: Mapping[str, str], limit: int = 20,
           kinds: Sequence[str] | None = None, max_terms: int | None = None) -> DataFrame:
    """Ranked search straight over a document table: only query terms leave the scan."""
    only = sorted({t for text in queries.values() for t in query_terms(text)})
    postings = build_postings(docs, fields, max_terms, only)
    return top_k(score(docs.sparkSession, postings, docs, queries, kinds), limit)


def evidence(ranked: DataFrame, postings: DataFrame) -> DataFrame:
    """Long form (query, id, term, source) of the evidence behind ranked rows."""
    terms = ranked.select("query", "id", F.explode("matched").alias("term"))
    return terms.join(postings.select("id", "term", "sources"), ["id", "term"]).select(
        "query", "id", "term", F.explode("sources").alias("source"))


def index_violations(postings: DataFrame) -> DataFrame:
    """Integrity problems of a stored postings table: (id, term, code)."""
    w = F.col("weight").cast("double")
    codes = F.array_compact(F.array(
        F.when(F.col("id").isNull(), F.lit("missing-id")),
        F.when(w.isNull() | F.isnan(w) | (w <= 0) | (w > 100), F.lit("weight-out-of-range")),
        F.when(F.col("sources").isNull() | (F.size("sources") == 0), F.lit("missing-sources"))))
    rows = postings.select("id", "term", F.explode(codes).alias("code"))
    dup = postings.groupBy("id", "term").count().where("count > 1").select(
        "id", "term", F.lit("duplicate-term").alias("code"))
    return rows.unionByName(dup)
