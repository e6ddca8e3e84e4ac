"""Sinks that keep a current table: bucketed, versioned by micro-batch, safe to run again.

A store is Parquet under ``bucket=B/batch=N``. A batch reads the newest version below its own id of the buckets it touches,
merges, and overwrites only ``batch=<id>`` of those buckets: repeating a batch gives the same files, untouched buckets are
not read or written, and the newest batch of each bucket is the current state. Once a batch is written, versions that neither readers
nor a repetition of that batch can need are removed, so a store holds two versions of a bucket at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.segments import merge_window
from ..session import checkpoint_dir
from .processors import keyed_store


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_store(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Current rows of a store (or as of just before a batch)."""
    full = f"{schema}, __row boolean, bucket int, batch bigint"
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["bucket", "batch"], "left_semi").where("__row")


def upsert_batch(batch: DataFrame, batch_id: int, path: str, schema: str, keys: Sequence[str], buckets: int,
                 merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Merge one micro-batch into the store; ``merge(old, new)`` gets and returns plain rows of ``schema``."""
    spark = batch.sparkSession
    names = [p.strip().split()[0].strip("`") for p in schema.split(",")]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.select(*names).withColumn("bucket", bucket).persist()  # read three times
    try:
        touched = new.select("bucket").distinct()
        old = read_store(spark, path, schema, batch_id).join(touched, "bucket", "left_semi")
        merged = merge(old.select(*names), new.select(*names)).select(*names).withColumn("__row", F.lit(True)).withColumn("bucket", bucket)
        # a marker row per touched bucket keeps an emptied bucket from falling back to its previous version
        marks = touched.select(*[F.lit(None).cast(dict(merged.dtypes)[n]).alias(n) for n in names], F.lit(False).alias("__row"), "bucket")
        out = merged.unionByName(marks).withColumn("batch", F.lit(batch_id).cast("bigint"))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    finally:
        new.unpersist()
    remove_versions(spark, path, batch_id)


def remove_versions(spark: SparkSession, path: str, batch_id: int) -> None:
    """Removes of each bucket all versions but those above ``batch_id``, that one, and the newest one below it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory() and folder.getPath().getName().startswith("bucket="):
            versions = sorted((int(v.getPath().getName().split("=")[1]), v.getPath()) for v in fs.listStatus(folder.getPath())
                              if v.getPath().getName().startswith("batch="))
            for _, old in [v for v in versions if v[0] < batch_id][:-1]:
                fs.delete(old, True)


# --- change log -> current state --------------------------------------------------------------------------------------------

OPS_SCHEMA = "project_id bigint, owner bigint, entity_id bigint, other_id bigint, edge_id bigint, seq bigint, op_type string, prop string, value double"


def owned(ops: DataFrame) -> DataFrame:
    """Ops in the columns of the store: ``owner`` is the edge of an edge op and the node of any other; missing columns are null."""
    edge = F.col("op_type").startswith("edge.")
    for c in ("other_id", "edge_id"):
        if c not in ops.columns:
            ops = ops.withColumn(c, F.lit(None).cast("bigint"))
    own = ops.withColumn("owner", F.when(edge, F.col("edge_id")).otherwise(F.col("entity_id")).cast("bigint"))
    return own.select(*[p.split()[0] for p in OPS_SCHEMA.split(", ")])


def compact_ops(ops: DataFrame) -> DataFrame:
    """The fewest ops with the same effect: of each node the last add and the last remove and the last later write per property, of each
    edge the last add or remove.

    Folding is associative, so folding old state with new ops equals folding the whole log. The last remove of a node stays though the
    node was added again: edges that it took along have no row of their own to say so.
    """
    k = ["project_id", "entity_id"]
    o = owned(ops)
    row = F.struct("seq", *[c for c in o.columns if c not in ("project_id", "owner", "seq")])
    last = o.where("op_type in ('node.add', 'node.remove', 'edge.add', 'edge.remove')").groupBy("project_id", "owner", F.when(
        F.col("op_type").startswith("node."), F.col("op_type")).otherwise("edge").alias("__what")).agg(F.max(row).alias("r"))
    kept = last.select("project_id", "owner", "r.*").select(*o.columns)
    life = o.where("op_type in ('node.add', 'node.remove')").groupBy(*k).agg(F.max(F.struct("seq", "op_type")).alias("l"))
    writes = o.where("op_type = 'node.update'").join(life.select(*k, F.col("l.seq").alias("__born"), F.col("l.op_type").alias("__ty")), k, "left")
    # updates of entities never added so far wait: their add may still come in a later batch with a smaller position
    writes = writes.where(F.col("__born").isNull() | ((F.col("__ty") == "node.add") & (F.col("seq") > F.col("__born"))))
    newest = writes.groupBy("project_id", "owner", "prop").agg(F.max(row).alias("r"))
    return kept.unionByName(newest.select("project_id", "owner", "r.*").select(*o.columns))


def materialise_changes(ops: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep the state of a change-log stream in a store; read it with ``replay_nodes`` and ``replay_edges`` of ``read_store(...)``."""
    def sink(batch, batch_id):
        upsert_batch(batch, batch_id, path, OPS_SCHEMA, ["project_id", "owner"], buckets, lambda old, new: compact_ops(old.unionByName(new)))

    return owned(ops).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SEGMENT_SCHEMA = "stream_id bigint, sequence bigint, partial boolean, url string, start double, duration double, version bigint"


def keep_windows(segments: DataFrame, streams: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep the sliding segment window of every stream: upsert by (sequence, part, url), drop below the first sequence."""
    def sink(batch, batch_id):
        key = ["stream_id", "sequence", "partial", "url"]

        def merge(old, new):
            newest = new.groupBy(*key).agg(F.max_by(F.struct("start", "duration", "version"), "version").alias("x")).select(*key, "x.*")
            return merge_window(old, newest, streams)

        upsert_batch(batch, batch_id, path, SEGMENT_SCHEMA, ["stream_id"], buckets, merge)

    return segments.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_rows(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append a stream to Parquet exactly once; the checkpoint is the record of what was consumed."""
    with keyed_store(stream.sparkSession):
        return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available now into a fresh folder and read it back."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    append_rows(stream, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
