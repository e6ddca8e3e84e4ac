"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at what the level before could not tell apart. Which (length, prefix) groups have several members is
kept in a bit table of fixed size that every task holds; a text is hashed whole, and its row shuffled, only if its slot is
set. A slot shared by chance costs one needless hash and changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .columns import field, fresh, one_space, whole
from .slots import bit_table, mark

PREFIX = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """``docs`` with keep_id, group_size and kept: texts are equal if identical after white-space runs became one space.

    keep_id is the smallest id of the equal texts, group_size their number of rows, kept marks the rows that bear keep_id.
    Null texts count as empty, so all empty and null rows are one group. Null ids never win against others; in a group of null ids
    only, keep_id is null and all are kept. Rows that repeat an id and its text count in group_size and are kept or dropped
    together. Columns of ``docs`` named like a result are replaced; all others pass through. An empty table gives no rows.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    size, head, full, shared_ = fresh(docs, "size", "head", "full", "shared")
    norm = one_space(whole(field(text_col)))
    levels = {size: F.length(norm), head: F.xxhash64(F.substring(norm, 1, prefix))}

    narrow = durable(docs.select(*[c.alias(n) for n, c in levels.items()]))
    counts = narrow.groupBy(size, head).count()
    lengths = counts.groupBy(size).agg(F.sum("count").alias("n")).where("n > 1").select(size)
    heads = counts.where("count > 1").join(lengths, size, "left_semi").select(size, head)
    marked = mark(docs.withColumns(levels), bit_table(heads, [size, head]), [size, head], shared_)
    alone = marked.where(~field(shared_)).withColumns(
        {"keep_id": field(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    shared = marked.where(field(shared_)).withColumn(full, F.sha2(norm, 256))
    key = [size, head, full]
    # one row per group, written: the join then deals both sides out itself, and Spark can split a hot group's rows
    groups = durable(shared.groupBy(*key).agg(F.min(field(id_col)).alias("keep_id"), F.count("*").alias("group_size")))
    joined = shared.join(groups, key).withColumn("kept", field(id_col).eqNullSafe(F.col("keep_id")))
    names = [*docs.columns, "keep_id", "group_size", "kept"]
    return alone.select(*map(field, names)).unionByName(joined.select(*map(field, names)))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id, with the columns of ``docs``."""
    return exact_groups(docs, id_col, text_col).where("kept").select(*map(field, docs.columns))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.sha2(one_space(whole(F.col("text"))), 256).alias("text_sha256"))


OP8_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from t join g using (norm)
"""
