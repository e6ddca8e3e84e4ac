"""A bounded sample of labelled texts for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import field, whole

FOLDS = 5


def held_out(id_col: str = "doc_id"):
    """The rows that no model may learn from: crc32 of the id as text divides by FOLDS."""
    return F.coalesce(F.crc32(field(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, targets: dict[str, str], rows: int, id_col: str = "doc_id",
                    text_col: str = "text", inputs: list[str] | None = None) -> list:
    """At most ``rows`` labelled documents outside the held-out part, as rows (id, text, one 0/1 column per target).

    ``targets`` are SQL expressions over the labels and the ``inputs`` columns of the documents. The rows with the smallest
    hash of their id are taken, from all rows; a target that is null for a row counts as 0, an id that is null takes no part.
    """
    ids = labels.where(field(id_col).isNotNull() & ~held_out(id_col)).dropDuplicates([id_col])
    ids = ids.orderBy(F.xxhash64(field(id_col)), field(id_col)).limit(rows)
    narrow = docs.select(field(id_col), whole(field(text_col)).alias("__text"), *map(field, inputs or []))
    both = narrow.join(F.broadcast(ids), id_col)  # at most ``rows`` ids
    both = both.select(field(id_col).alias("id"), F.col("__text").alias("text"),
                       *(F.coalesce(F.expr(sql).cast("int"), F.lit(0)).alias(name) for name, sql in targets.items()))
    return sorted(both.collect(), key=lambda r: (r["id"], r["text"]))
