"""Access masking before anything is indexed or embedded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

LEVELS = ("full", "metadata", "none")


def mask(rows: DataFrame, access: str, hidden_when_metadata: Sequence[str], always_hidden: Sequence[str] = ()) -> DataFrame:
    """Drop ``none`` rows, null the detail columns of ``metadata`` rows; unknown values count as ``none``.

    A null access value means the row never stated one and is ``full``.
    """
    level = F.coalesce(F.col(access), F.lit("full"))
    level = F.when(level.isin(*LEVELS), level).otherwise("none")
    out = rows.withColumn(access, level).where(F.col(access) != "none").drop(*always_hidden)
    for c in hidden_when_metadata:
        out = out.withColumn(c, F.when(F.col(access) == "metadata", F.lit(None)).otherwise(F.col(c)))
    return out
