"""Streaming reads of event folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New event files as they appear; ``at`` is the event time used for watermarks."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        s = reader.parquet(path)
    else:  # a single file: watch its folder for that name
        s = reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return s.withColumn("at", F.col("ts").cast("timestamp"))
