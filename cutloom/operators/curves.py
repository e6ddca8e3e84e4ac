"""Animated values: curves, probes and point edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.curves import ease
from .scan import asof

TOLERANCE = 1e-4  # fixed value: two points closer than this are the same point


def normalize_curve(points: DataFrame, keys: Sequence[str], time: str = "time", ordinal: str = "ordinal") -> DataFrame:
    """Times floored at 0; of points with an equal time the last one stays (folded map-side)."""
    keys = list(keys)
    rest = [c for c in points.columns if c not in (*keys, time)]
    p = points.withColumn(time, F.greatest(F.lit(0.0), F.col(time)))
    last = p.groupBy(*keys, time).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("__p"))
    return last.select(*keys, time, "__p.*").select(*points.columns)


def curve_range(points: DataFrame, keys: Sequence[str], start: float, end: float | None = None) -> DataFrame:
    c = normalize_curve(points, keys).where(F.col("time") >= start)
    return c if end is None else c.where(F.col("time") <= max(start, end))


def values_at(points: DataFrame, probes: DataFrame, keys: Sequence[str], probe_time: str, fallback: float | None = None,
              width: float = 86400.0, out: str = "value_at") -> DataFrame:
    """Probe rows with the eased value at their time; clamped to the first and last point of the series.

    The left neighbour is the last point strictly before the probe, so a probe on a point that follows a ``hold``
    point still reads the held value, except on the very last point.
    """
    keys = list(keys)
    last = points.groupBy(*keys).agg(F.max("time").alias("__last"), F.max_by("value", F.struct("time", "ordinal")).alias("__lastv"))
    p = probes.join(last, keys, "left")
    a = asof(points, p, keys, "time", probe_time, ["value", "easing"], "ordinal", width)
    t, l, r = F.col(probe_time), F.col("left"), F.col("right")
    span = r["time"] - l["time"]
    mix = ease((t - l["time"]) / F.when(span > 0, span), l["easing"])
    inner = F.when(span <= 0, r["value"]).otherwise(l["value"] + (r["value"] - l["value"]) * mix)
    v = (F.when(F.col("__last").isNull(), F.lit(fallback)).when(l.isNull(), r["value"])
         .when(t >= F.col("__last"), F.col("__lastv")).otherwise(inner))
    return a.select(*probes.columns, v.alias(out))


def upsert_points(points: DataFrame, edits: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Replace or add points; an existing point within ``tolerance`` of an edit of its series gives way."""
    return remove_points(points, edits, keys, tolerance).unionByName(
        edits.withColumn("time", F.greatest(F.lit(0.0), F.col("time"))).select(*points.columns))


def remove_points(points: DataFrame, edits: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Points that are not within ``tolerance`` of an edit time of their series (bucketed anti join)."""
    keys = list(keys)
    b = "__bucket"
    near = edits.select(*keys, F.greatest(F.lit(0.0), F.col("time")).alias("__t"))
    at = F.floor(F.col("__t") / (2 * tolerance)).cast("bigint")
    near = near.withColumn(b, F.explode(F.array(at - 1, at, at + 1)))
    p = points.withColumn(b, F.floor(F.col("time") / (2 * tolerance)).cast("bigint"))
    n = near.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(b).alias("__b"), "__t")
    cond = (F.col(b) == F.col("__b")) & (F.abs(F.col("time") - F.col("__t")) <= tolerance)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    return p.join(n, cond, "left_anti").drop(b)


def point_counts(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("points"))
