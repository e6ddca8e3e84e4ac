"""Correlating stage events and judging latency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import exact_quantiles
from .scan import span_scan


def correlate(stages: DataFrame, keys: Sequence[str], at: str, tie: str, span: Column) -> DataFrame:
    """One record per (keys, record): first source time, last submit and decode time, output time.

    An output closes its record; later events of the same key open the next one. Columns: stage, ``at``.
    """
    keys = list(keys)
    x = span_scan(stages, keys, [at, tie], span,
                  record=("sum_before", F.when(F.col("stage") == "output", 1).otherwise(0).cast("bigint")))
    pick = lambda s: F.when(F.col("stage") == s, F.col(at))
    return x.groupBy(*keys, "record").agg(
        F.min(pick("source")).alias("source_at"), F.max(pick("submitted")).alias("submitted_at"),
        F.max(pick("decoded")).alias("decoded_at"), F.max(pick("output")).alias("output_at"))


def stage_durations(records: DataFrame) -> DataFrame:
    """Stage distances of closed records; null when a stage is missing."""
    c = F.col
    return records.where("output_at is not null").withColumn("source_to_submit_ms", c("submitted_at") - c("source_at")).withColumn(
        "submit_to_decode_ms", c("decoded_at") - c("submitted_at")).withColumn(
        "decode_to_output_ms", c("output_at") - c("decoded_at")).withColumn(
        "source_to_output_ms", c("output_at") - c("source_at"))


def distribution(values: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count, min, p50, p95, max with the nearest-rank-up rule (index ``ceil((n-1)p)``)."""
    groups = list(groups)
    v = values.where(F.col(value).isNotNull())
    base = v.groupBy(*groups).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(v, groups, value, {"p50": 0.5, "p95": 0.95}, "ceil")
    return base.join(q, groups) if groups else base.crossJoin(F.broadcast(q))  # one row each


def live_distances(state: DataFrame, playhead: str, edge: str, now: str, position: str, target: str) -> DataFrame:
    """Milliseconds from the playhead to the live edge, presentation time and recommended position."""
    p = F.col(playhead)
    ms = lambda c: (F.col(c) - p) * 1000
    return state.withColumn("edge_ms", ms(edge)).withColumn("presentation_ms", ms(now)).withColumn(
        "position_error_ms", ms(position)).withColumn("target_error_ms", ((F.col(now) - p) - F.col(target)) * 1000)


def judge(rows: DataFrame, budgets: Mapping[str, tuple]) -> DataFrame:
    """Add a boolean per budget ``name -> (column, limit, absolute)`` and ``pass``: null when nothing was decided."""
    names = list(budgets)
    for n, (c, limit, absolute) in budgets.items():
        v = F.abs(F.col(c)) if absolute else F.col(c)
        rows = rows.withColumn(n, (v <= limit) if limit is not None else F.lit(None).cast("boolean"))
    decided = F.array_compact(F.array(*names))
    return rows.withColumn("pass", F.when(F.size(decided) > 0, F.forall(decided, lambda x: x)))
