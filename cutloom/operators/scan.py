"""Ordered scans per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so a key that holds a third of the table
becomes one straggler. Here each key is cut into *spans* (any expression that grows with the order columns, normally
``floor(time / width)``). The scan runs inside (key, span), one summary row per (key, span) is aggregated map-side,
summaries are scanned per key to get what each span inherits from earlier or later ones, and that is joined back on
(key, span) -- the partitioning the local window already has, so the wide side is shuffled once.

Keys must be non-null and the order columns must be a total order inside a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPAN = "__span"


def span_of(col: Column | str, width: float) -> Column:
    """Span number of a numeric order column; pick ``width`` so the busiest key keeps about 1e5..1e6 rows a span."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(float(width))).cast("bigint")


def _with_carry(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return local.join(carry, [*keys, SPAN], "left")


def span_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: Column, **outs: tuple) -> DataFrame:
    """Add one column per ``name=(kind, expr)``.

    Kinds: ``row_number``; ``lag`` / ``lead`` (neighbour row, nulls kept); ``prev`` / ``upto`` (last non-null strictly
    before / up to the row); ``next`` (first non-null strictly after); ``sum_before`` / ``sum`` and ``max_before`` /
    ``max`` (running, exclusive / inclusive; ``sum*`` start at 0); ``head`` / ``tail`` (first / last row of the key).
    """
    keys, order = list(keys), list(order)
    base = df.withColumn(SPAN, span)
    inputs = {}
    for name, (kind, *expr) in outs.items():
        if expr:
            inputs[name] = f"__in_{name}"
            base = base.withColumn(inputs[name], expr[0])
    wl = W.partitionBy(*keys, SPAN).orderBy(*order)
    past, upto = wl.rowsBetween(W.unboundedPreceding, -1), wl.rowsBetween(W.unboundedPreceding, 0)
    # what comes after is read from the other end: a frame with an open end starts anew at every row, quadratic in the span
    future = W.partitionBy(*keys, SPAN).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    pos = F.struct(*order)
    wk = W.partitionBy(*keys).orderBy(SPAN)
    kpast = wk.rowsBetween(W.unboundedPreceding, -1)
    kfuture = W.partitionBy(*keys).orderBy(F.desc(SPAN)).rowsBetween(W.unboundedPreceding, -1)
    local, summary, carried, final = {}, {}, {}, {}
    for name, (kind, *_) in outs.items():
        lo, su, ca = f"__l_{name}", f"__s_{name}", f"__c_{name}"
        x = F.col(inputs[name]) if name in inputs else None
        if kind == "row_number":
            local[lo] = F.row_number().over(wl).cast("bigint")
            summary[su] = F.count(F.lit(1))
            carried[ca] = F.sum(su).over(kpast)
            final[name] = F.col(lo) + F.coalesce(ca, F.lit(0))
        elif kind in ("lag", "lead"):
            # wrap in a struct so that "no neighbour in this span" differs from "the neighbour holds null"
            boxed = F.struct(x.alias("v"))
            ahead = kind == "lead"
            local[lo] = (F.lead if ahead else F.lag)(boxed).over(wl)
            summary[su] = (F.min_by if ahead else F.max_by)(boxed, pos)
            carried[ca] = (F.lead if ahead else F.lag)(F.col(su)).over(wk)
            final[name] = F.coalesce(F.col(lo), F.col(ca))["v"]
        elif kind in ("prev", "upto"):
            local[lo] = F.last(x, True).over(past if kind == "prev" else upto)
            summary[su] = F.max_by(x, F.when(x.isNotNull(), pos))
            carried[ca] = F.last(su, True).over(kpast)
            final[name] = F.coalesce(lo, ca)
        elif kind == "next":
            local[lo] = F.last(x, True).over(future)
            summary[su] = F.min_by(x, F.when(x.isNotNull(), pos))
            carried[ca] = F.last(su, True).over(kfuture)
            final[name] = F.coalesce(lo, ca)
        elif kind in ("sum", "sum_before"):
            local[lo] = F.sum(x).over(upto if kind == "sum" else past)
            summary[su] = F.sum(x)
            carried[ca] = F.sum(su).over(kpast)
            zero = F.lit(0)
            final[name] = F.coalesce(F.col(lo), zero) + F.coalesce(F.col(ca), zero)
        elif kind in ("max", "max_before"):
            local[lo] = F.max(x).over(upto if kind == "max" else past)
            summary[su] = F.max(x)
            carried[ca] = F.max(su).over(kpast)
            final[name] = F.greatest(F.col(lo), F.col(ca))
        elif kind in ("head", "tail"):
            boxed = F.struct(x.alias("v"))
            pick = F.min_by if kind == "head" else F.max_by
            summary[su] = pick(F.struct(x.alias("v")), pos)
            whole = W.partitionBy(*keys).orderBy(SPAN).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            carried[ca] = (F.first if kind == "head" else F.last)(F.col(su)).over(whole)
            final[name] = F.col(ca)["v"]
        else:
            raise ValueError(f"unknown scan kind {kind}")
    per_span = base.groupBy(*keys, SPAN).agg(*[c.alias(n) for n, c in summary.items()])
    carry = per_span.select(*keys, SPAN, *[c.alias(n) for n, c in carried.items()])
    wide = base.select("*", *[c.alias(n) for n, c in local.items()])
    out = _with_carry(wide, carry, keys)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in final.items()])


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, tie: Sequence[str],
            span: Column) -> DataFrame:
    """Add ``island``: rows whose start is within ``gap`` of the furthest earlier end share one number per key."""
    a = span_scan(df, keys, [start, *tie], span, __reach=("max_before", F.col(end)))
    a = a.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap), 1)
                     .otherwise(0).cast("bigint"))
    a = span_scan(a.drop("__reach"), keys, [start, *tie], span, island=("sum", F.col("__new")))
    return a.drop("__new")


def asof(points: DataFrame, probes: DataFrame, keys: Sequence[str], point_time: str, probe_time: str,
         payload: Sequence[str], tie: str, span_width: float, strict: bool = True) -> DataFrame:
    """Two-sided as-of join: every probe row gets ``left_*`` (last point before) and ``right_*`` (first not before).

    ``strict`` puts a point that equals the probe time on the right side; otherwise it goes to the left side. One
    union, one span scan: no inequality join. Equal point times are ordered by ``tie``, in its own type.
    """
    rank_point, rank_probe = (1, 0) if strict else (0, 1)
    box = F.struct(F.col(point_time).alias("time"), *[F.col(c) for c in payload])
    p = points.select(*keys, F.col(point_time).cast("double").alias("__t"), F.lit(rank_point).alias("__r"),
                      F.col(tie).alias("__o"), box.alias("__pt"), F.lit(None).alias("__probe"))
    names = probes.columns
    q = probes.select(*keys, F.col(probe_time).cast("double").alias("__t"), F.lit(rank_probe).alias("__r"),
                      F.lit(None).cast(p.schema["__o"].dataType).alias("__o"), F.lit(None).cast(p.schema["__pt"].dataType).alias("__pt"),
                      F.struct(*names).alias("__probe"))
    p = p.withColumn("__probe", F.lit(None).cast(q.schema["__probe"].dataType))
    both = span_scan(p.unionByName(q), keys, ["__t", "__r", "__o"], span_of("__t", span_width),
                     left=("prev", F.col("__pt")), right=("next", F.col("__pt")))
    return both.where("__probe is not null").select("__probe.*", "left", "right")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
