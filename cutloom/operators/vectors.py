"""Vector search: exact cosine top-k, embedding with a user model, rank fusion."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scan import union_all

RRF_OFFSET = 60  # fixed value: rank fusion constant
MAX_QUERY_VECTORS = 1024
EMBED_ROWS, KNOWN_TERMS = 1024, 65_536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; a zero vector scores 0."""
    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(aa * bb))


def vector_top_k(index: DataFrame, queries: DataFrame, k: int = 20, minimum: float = -1.0,
                 kinds: Sequence | None = None, digits: int | None = None) -> DataFrame:
    """Exact top-k of ``index`` (id, kind, name, vector) for each of ``queries`` (query, vector).

    With ``digits`` scores are rounded before they are ranked: those that agree so far are ordered by name and id.

    Query vectors are checked to be few and shipped to the tasks; each Arrow batch is one matrix product and keeps
    only rows that can still be in the top k, so what is shuffled grows with batches * queries * k, not with pairs.
    """
    held = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).limit(
        MAX_QUERY_VECTORS + 1).collect()
    if len(held) > MAX_QUERY_VECTORS:
        # more queries than one block may ship: run hash blocks of about half the limit, each checked again
        blocks = -(-queries.count() // (MAX_QUERY_VECTORS // 2))
        part = F.pmod(F.xxhash64("query"), F.lit(blocks))
        return union_all([vector_top_k(index, queries.where(part == i), k, minimum, kinds, digits) for i in range(blocks)])
    if kinds is not None:
        index = index.where(F.col("kind").isin(*kinds))
    names = [r["query"] for r in held]
    q = np.array([r["vector"] for r in held], dtype="float64").reshape(len(held), -1)
    qn = np.sqrt((q * q).sum(axis=1))
    near = 1e-12 + (0 if digits is None else 10.0 ** -digits)  # what rounds to the same score is no further apart

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            v = np.array(batch.column("vector").to_pylist(), dtype="float64")
            vn = np.sqrt((v * v).sum(axis=1))
            den = vn[:, None] * qn[None, :]
            s = np.divide(v @ q.T, den, out=np.zeros_like(den), where=den != 0)
            keep_rows, keep_q = [], []
            for j in range(len(names)):
                ok = np.flatnonzero(s[:, j] >= minimum)
                if len(ok) > k:
                    cut = np.partition(s[ok, j], len(ok) - k)[len(ok) - k]
                    ok = ok[s[ok, j] >= cut - near]  # ties at the cut stay
                keep_rows.append(ok)
                keep_q.append(np.full(len(ok), j))
            r, c = np.concatenate(keep_rows), np.concatenate(keep_q)
            t = batch.take(pa.array(r))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[j] for j in c], type=qtype), t.column("id"), t.column("kind"), t.column("name"),
                 pa.array(s[r, c])], names=["query", "id", "kind", "name", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    qtype = to_arrow_type(queries.schema["query"].dataType)
    types = dict(index.dtypes)
    schema = (f"query {dict(queries.dtypes)['query']}, id {types['id']}, kind {types['kind']}, name {types['name']}, "
              "score double")
    s = index.select("id", "kind", "name", "vector").mapInArrow(block, schema)
    s = s if digits is None else s.withColumn("score", F.round("score", digits))
    w = W.partitionBy("query").orderBy(F.desc("score"), "name", "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint"))


def fuse(lexical: DataFrame, embedded: DataFrame, k: int, lexical_weight: float = 1.0,
         embedding_weight: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked frames (query, id, kind, name, rank)."""
    def side(df, weight):
        return df.select("query", "id", "kind", "name", (F.lit(float(weight)) / (RRF_OFFSET + F.col("rank"))).alias("part"))

    both = side(lexical, lexical_weight).unionByName(side(embedded, embedding_weight))
    total = both.groupBy("query", "id", "kind", "name").agg(F.sum("part").alias("score"))
    # round away the last bits so that equal sums tie whatever the order of addition
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "name", "id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint"))


def embed(texts: DataFrame, model: Callable[[list[str]], Sequence[Sequence[float]]], batch_size: int = 32) -> DataFrame:
    """Add ``vector`` from a user model that maps a list of texts to vectors, ``batch_size`` texts a call.

    Texts are taken out of their Arrow batch for one call at a time; all other columns pass through untouched.
    """
    out = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + ", vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, EMBED_ROWS):
                block, vectors = batch.slice(start, EMBED_ROWS), []
                for at in range(0, block.num_rows, batch_size):
                    part = block.column("text").slice(at, batch_size).to_pylist()
                    got = [np.fromiter(map(float, v), dtype="float64") for v in model(part)]
                    if len(got) != len(part):
                        raise ValueError(f"model must return exactly {len(part)} vectors")
                    vectors += got
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(vectors, type=pa.list_(pa.float64()))], names=[*block.schema.names, "vector"])

    return texts.mapInArrow(run, out)


def hash_model(dimensions: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in model: signed term hashing (the first 32 bits of the MD5 of a term), unit length."""
    known: dict[str, int] = {}  # hashes of terms seen by this task, given up when there are too many

    def hashed(term):
        if len(known) >= KNOWN_TERMS:
            known.clear()
        return known.setdefault(term, int(hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()[:8], 16))

    def model(texts):
        out = []
        for text in texts:
            h = np.array([hashed(term) if (x := known.get(term)) is None else x for term in text.split()], dtype="int64")
            v = np.bincount(h % dimensions, np.where(h & 1024, 1.0, -1.0), dimensions)
            n = math.sqrt(float((v * v).sum()))
            out.append(v / n if n else v)
        return out

    return model


def document_text(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Stable text to embed: name, kind and all sorted terms of a document, from stored postings."""
    # one document's distinct terms: bounded by the document itself
    terms = postings.groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return text_of_terms(docs.select("id", "kind", "name").join(terms, "id", "left"))


def text_of_terms(documents: DataFrame) -> DataFrame:
    """The same text of rows that hold their sorted terms (id, kind, name, terms): no join and no shuffle."""
    body = F.array_join(F.coalesce("terms", F.array().cast("array<string>")), " ")
    return documents.select("id", "kind", "name", F.concat_ws("\n", "name", "kind", body).alias("text"))


def vector_violations(vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """(id, code) for empty, non-finite, wrongly sized or duplicated vectors. The usual size is the most common one."""
    sizes = vectors.groupBy(F.size("vector").alias("n")).count()
    expected = (vectors.sparkSession.range(1).select(F.lit(dimensions).alias("dims")) if dimensions
                else sizes.agg(F.max_by("n", F.struct("count", "n")).alias("dims")))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    codes = F.array_compact(F.array(
        F.when(F.col("vector").isNull() | (F.size("vector") == 0), F.lit("empty")),
        F.when(bad, F.lit("non-finite")),
        F.when(F.size("vector") != F.col("dims"), F.lit("dimension-mismatch"))))
    rows = vectors.crossJoin(F.broadcast(expected)).select("id", F.explode(codes).alias("code"))  # one-row side
    dup = vectors.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate-id").alias("code"))
    return rows.unionByName(dup)


def accumulate(frames: DataFrame, group: Sequence[str], vector: str, weight: str) -> DataFrame:
    """Weighted sum of vectors per group and position: (group.., pos, value), folded map-side."""
    e = frames.select(*group, F.posexplode(vector).alias("pos", "x"), F.col(weight).alias("__w"))
    return e.groupBy(*group, F.col("pos").cast("bigint").alias("pos")).agg(
        F.sum(F.col("x").cast("double") * F.col("__w")).alias("value"))
