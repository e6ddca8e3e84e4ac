"""From raw documents to encoded training text, in stages; each stage works on all rows that the one before it kept.

Stages take (spark, docs, sf_dir) and return a frame; all but the last return the columns of ``docs``. Null and empty texts go
through: they are not toxic, equal each other in exact dedup (the least id stays), link with nothing, hold no benchmark passage
and have no pieces. Rows with a null id stay where ids decide. Extra columns pass through every stage but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cutloom.llm.decontaminate import drop_contaminated
from cutloom.llm.exact_dedup import drop_copies
from cutloom.llm.jaccard_join import one_of_each
from cutloom.llm.pieces import encode_and_check, load_vocabulary
from cutloom.llm.toxicity import drop_toxic, learn_toxicity
from cutloom.session import checkpoint_dir

SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; it learns from labelled rows of ``docs``."""
    return drop_toxic(docs, learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similar texts connect, the document with the least id."""
    return one_of_each(docs, width=SHINGLE, percent=PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, the piece ids of the whole text, and whether they decode to it."""
    return encode_and_check(docs, load_vocabulary())


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", benchmark),
          ("SentencePiece encoding and decoding", pieces)]

ORACLE_SQL = None  # a trained model decides in the first stage; tests compare the run with a brute-force one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
