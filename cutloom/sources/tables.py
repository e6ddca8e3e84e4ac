"""Parquet tables of a dataset folder and the domain views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds: timelines start at 0


def micros(col: str) -> str:
    return f"unix_micros(cast({col} as timestamp))"


class Tables:
    """Attribute access to the tables and views of one folder; nothing is read until an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name.startswith("v_"):
            from . import views
            return getattr(views, name[2:])(self)
        raise AttributeError(name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)
