"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app: str = "cutloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, AQE-enabled session. Partition counts are left to AQE unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return named


@contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write inside are removed when it is done, and Arrow batches are small."""
    before = {name: spark.conf.get(name) for name in WHILE_WRITING}
    try:
        for name, value in WHILE_WRITING.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, computes the input once (an eager checkpoint runs it twice) and
    gives the optimizer true sizes for the next join. The shuffle files of the write are removed when it is done: nobody
    reads them again, and on a long job they would pile up until the driver collects garbage. Arrow batches of the write
    hold 8 MB at most, or one row, since rows may be whole texts and Spark and Python both hold a batch of each task.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with while_writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
