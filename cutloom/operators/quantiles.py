"""Exact order statistics without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a bounded sketch
(``percentile_approx``) brackets each wanted rank, a second pass counts what lies below the bracket and keeps only the
bracketed values, and the rank is read off inside the bracket. The sketch has a guaranteed rank error, so the bracket
always holds the wanted rank up to one neighbour, and both neighbours are carried along.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, float],
                    rule: str = "linear") -> DataFrame:
    """One row per group with a column per entry of ``wanted`` (name -> p).

    ``linear`` interpolates at ``(n-1)p``; ``ceil`` takes the value at index ``ceil((n-1)p)``. Group columns must be
    non-null; null and non-finite values are ignored.
    """
    groups = list(groups)
    x = df.select(*groups, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") != F.lit(float("inf"))))
    names = list(wanted)
    margin = 2.0 / _ACCURACY
    lows = [max(0.0, wanted[n] - margin) for n in names]
    highs = [min(1.0, wanted[n] + margin) for n in names]
    sketch = x.groupBy(*groups).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", lows + highs, _ACCURACY).alias("__q"))
    k = len(names)
    brackets = sketch.select(*groups, "__n", *[F.col("__q")[i].alias(f"__lo{i}") for i in range(k)],
                             *[F.col("__q")[k + i].alias(f"__hi{i}") for i in range(k)])
    joined = x.join(brackets, groups) if groups else x.crossJoin(F.broadcast(brackets))
    # equal values collapse before the shuffle that ranks them
    marks = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"),
                 F.when(F.col("__v") < F.col(f"__lo{i}"), F.lit(-1)).when(F.col("__v") > F.col(f"__hi{i}"), F.lit(1))
                 .otherwise(F.lit(0)).alias("side")) for i in range(k)]))
    m = joined.select(*groups, "__n", "__v", marks.alias("__m")).select(*groups, "__n", "__v", "__m.i", "__m.side")
    # rows below / above a bracket fold to one count and the value next to the bracket
    slot = F.when(F.col("side") == 0, F.col("__v"))
    cells = m.groupBy(*groups, "__n", "i", "side", slot.alias("__slot")).agg(
        F.count("*").alias("__c"), F.max("__v").alias("__mx"), F.min("__v").alias("__mn"))
    cells = cells.withColumn("__val", F.when(F.col("side") == -1, F.col("__mx")).otherwise(F.col("__mn")))
    w = W.partitionBy(*groups, "i").orderBy("side", "__val")
    ranked = cells.withColumn("__end", F.sum("__c").over(w)).withColumn("__start", F.col("__end") - F.col("__c"))
    ps = F.element_at(F.array(*[F.lit(float(wanted[n])) for n in names]), F.col("i") + 1)
    idx = (F.col("__n") - 1) * ps
    lo_i, hi_i = F.floor(idx), F.ceil(idx)

    def holds(rank):
        inside = (F.col("__start") <= rank) & (rank < F.col("__end"))
        # a neighbour cell stands for its one value next to the bracket
        return F.when(F.col("side") == -1, rank == F.col("__end") - 1).when(
            F.col("side") == 1, rank == F.col("__start")).otherwise(inside)

    aggs = []
    for i, n in enumerate(names):
        at = F.col("i") == i
        lo_v, hi_v = F.max(F.when(at & holds(lo_i), F.col("__val"))), F.max(F.when(at & holds(hi_i), F.col("__val")))
        if rule == "ceil":
            aggs.append(hi_v.alias(n))
        else:
            t = F.max(F.when(at, idx - lo_i))
            aggs.append((lo_v * (1 - t) + hi_v * t).alias(n))
    return ranked.groupBy(*groups).agg(*aggs)
