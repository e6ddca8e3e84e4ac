"""Range joins as bucketed equi-joins (pure inequalities would plan as a nested loop)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def explode_range(df: DataFrame, first: Column, end: Column, name: str, block: int = 65_536) -> DataFrame:
    """One row per integer of [first, end), in two steps so that no row ever holds more than one block."""
    x = df.withColumn("__xf", first.cast("bigint")).withColumn("__xe", end.cast("bigint")).where("__xe > __xf")
    x = x.withColumn("__xb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__xe") - F.col("__xf") - 1) / block).cast("bigint"))))
    lo = F.col("__xf") + F.col("__xb") * block
    hi = F.least(F.col("__xe"), lo + block) - 1
    return x.withColumn(name, F.explode(F.sequence(lo, hi))).drop("__xf", "__xe", "__xb")


def explode_pages(df: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    """One row per bucket that the closed range [start, end] touches, in blocks: no row holds all buckets of a long range."""
    first = F.floor(start / F.lit(float(width))).cast("bigint")
    return explode_range(df, first, F.greatest(first, F.floor(end / F.lit(float(width))).cast("bigint")) + 1, name)


def point_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], time: str, start: str, end: str,
               width: float, condition: Column | None = None) -> DataFrame:
    """Inner join of points to ranges with ``start <= time < end`` (or ``condition``) and equal keys.

    Ranges are exploded to the buckets they touch, points have one bucket, so each pair meets exactly once. Column
    names of both sides must differ apart from the keys. AQE splits a skewed (key, bucket).
    """
    b = "__bucket"
    left = points.withColumn(b, F.floor(F.col(time) / F.lit(float(width))).cast("bigint"))
    right = explode_pages(ranges, F.col(start), F.col(end), width, b)
    joined = left.join(right, [*keys, b], "inner").drop(b)
    return joined.where(condition if condition is not None
                        else (F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))


def level_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """As ``point_join``, for ranges of very different lengths: a range goes to the level whose buckets are as long as it, at most two of them.

    Levels are eight times as wide as the one before, from ``width`` on, and points are looked up on those that hold a range, so rows grow
    with the logarithm of the longest range, not with its length. The levels, 400 at most, are the only thing broadcast.
    """
    wide = F.greatest(F.lit(1.0), (F.col(end) - F.col(start)) / F.lit(float(width)))
    r = ranges.where(F.col(end) > F.col(start)).withColumn("__level", F.ceil(F.log2(wide) / 3).cast("int"))
    bucket = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(8.0), "__level"))).cast("bigint")
    r = r.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    levels = F.broadcast(r.select("__level").distinct())
    p = points.crossJoin(levels).withColumn("__bucket", bucket(time))
    return p.join(r, [*keys, "__level", "__bucket"]).where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end))).drop("__level", "__bucket")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_start: str, l_end: str, r_start: str,
                 r_end: str, width: float, condition: Column) -> DataFrame:
    """Inner join of overlapping ranges; a pair is kept only in the first bucket both sides touch."""
    b = "__bucket"
    w = F.lit(float(width))
    lf = explode_pages(left.withColumn("__lb", F.floor(F.col(l_start) / w).cast("bigint")), F.col(l_start), F.col(l_end), width, b)
    rf = explode_pages(right.withColumn("__rb", F.floor(F.col(r_start) / w).cast("bigint")), F.col(r_start), F.col(r_end), width, b)
    joined = lf.join(rf, [*keys, b], "inner")
    return joined.where((F.col(b) == F.greatest("__lb", "__rb")) & condition).drop(b, "__lb", "__rb")
