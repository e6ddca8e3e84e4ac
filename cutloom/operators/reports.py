"""Performance, conformance and history reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quantiles import exact_quantiles
from .scan import union_all

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
REGRESSION_LIMIT, FLAT_BAND, HISTORY_KEEP, TREND_WINDOW = 0.15, 0.02, 50, 5  # fixed values


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def unpivot(runs: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form (keep.., metric, value) of the metric columns, finite values only."""
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return runs.select(*keep, e.alias("m")).select(*keep, "m.*").where(finite(F.col("value")))


def summarize(values: DataFrame, groups: Sequence[str], value: str = "value",
              percentiles: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """count, min, max, mean and interpolated percentiles of a metric per group, ignoring non-finite values."""
    groups = list(groups)
    v = values.where(finite(F.col(value).cast("double")))
    base = v.groupBy(*groups).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
                                  F.avg(value).alias("mean"))
    q = exact_quantiles(v, groups, value, percentiles)
    return base.join(q, groups) if groups else base.crossJoin(F.broadcast(q))  # one row each


def performance_report(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metric summaries over executed runs, overall (kind ``*``) and per kind."""
    executed = runs.where("status <> 'skipped'").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    long = unpivot(executed, ["kind"], metrics)
    overall = summarize(long, ["metric"]).withColumn("kind", F.lit("*"))
    return overall.unionByName(summarize(long, ["metric", "kind"]))


def status_counts(runs: DataFrame) -> DataFrame:
    flag = lambda s: F.count(F.when(F.col("status") == s, 1))
    return runs.agg(F.count("*").alias("total"), F.count(F.when(F.col("status") != "skipped", 1)).alias("executed"),
                    flag("passed").alias("passed"), flag("failed").alias("failed"), flag("skipped").alias("skipped"))


def compare_reports(current: DataFrame, baseline: DataFrame, max_metrics: Sequence[str], min_metrics: Sequence[str],
                    limit: float = REGRESSION_LIMIT) -> DataFrame:
    """Regression checks of two (metric, p50, p95) frames: p95 for "max" metrics, p50 for "min" metrics."""
    j = current.select("metric", F.col("p50").alias("c50"), F.col("p95").alias("c95")).join(
        baseline.select("metric", F.col("p50").alias("b50"), F.col("p95").alias("b95")), "metric")

    def side(metrics, direction, now, before, sign):
        x = j.where(F.col("metric").isin(*metrics)).select(
            "metric", F.lit(direction).alias("direction"), F.col(now).alias("current"), F.col(before).alias("baseline"))
        x = x.where(finite(F.col("current")) & finite(F.col("baseline")) & (F.col("baseline") != 0))
        return x.withColumn("regression", sign * (F.col("current") - F.col("baseline")) / F.abs("baseline"))

    out = side(max_metrics, "max", "c95", "b95", F.lit(1)).unionByName(side(min_metrics, "min", "c50", "b50", F.lit(-1)))
    return out.withColumn("pass", F.col("regression") <= limit)


def environment_key(columns: Sequence[str]) -> Column:
    """Normalised key of an environment: trimmed, lower case, blanks to dashes, joined with bars."""
    parts = [F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("unknown" if i < 3 else "")))), r"\s+", "-")
             for i, c in enumerate(columns)]
    return F.concat_ws("|", *parts)


def retain_history(history: DataFrame, environment: str, order: Sequence[str], keep: int = HISTORY_KEEP) -> DataFrame:
    """Latest ``keep`` snapshots per environment (pruned map-side)."""
    w = W.partitionBy(environment).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(1, keep)).drop("__rn")


def metric_trend(history: DataFrame, groups: Sequence[str], order: Sequence[str], value: str = "value",
                 window: int = TREND_WINDOW) -> DataFrame:
    """Newest value against the mean of up to ``window`` values before it."""
    groups = list(groups)
    v = history.where(finite(F.col(value)))
    w = W.partitionBy(*groups).orderBy(*[F.desc(c) for c in order])
    recent = v.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= window + 1)
    count = v.groupBy(*groups).agg(F.count("*").alias("samples"))
    t = recent.groupBy(*groups).agg(F.max(F.when(F.col("__rn") == 1, F.col(value))).alias("current"),
                                    F.avg(F.when(F.col("__rn") > 1, F.col(value))).alias("__b"))
    t = t.withColumn("baseline", F.coalesce("__b", "current")).drop("__b")
    change = F.when(F.col("baseline") == 0, F.when(F.col("current") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(
        F.try_divide(F.col("current") - F.col("baseline"), F.col("baseline")))
    t = t.withColumn("change", change)
    direction = F.when(F.abs("change") < FLAT_BAND, "flat").when(F.col("change") > 0, "up").otherwise("down")
    return t.withColumn("direction", direction).join(count, groups)


def budget_violations(trends: DataFrame, budgets: DataFrame) -> DataFrame:
    """Trends (metric, current, change, ..) against (metric, max, min, max_regression) rows."""
    j = trends.join(budgets, "metric")

    def breach(kind, actual, limit, broken):
        return F.when(broken, F.struct(F.lit(kind).alias("type"), actual.alias("actual"), limit.alias("limit")))

    c, g = F.col("current"), F.col("change")
    items = F.array_compact(F.array(breach("max", c, F.col("max"), c > F.col("max")),
                                    breach("min", c, F.col("min"), c < F.col("min")),
                                    breach("regression", g, F.col("max_regression"), g > F.col("max_regression"))))
    return j.withColumn("v", F.explode(items)).drop("max", "min", "max_regression").select("*", "v.*").drop("v")


# Default per-run budgets (metric, limit or None, direction).
DEFAULT_BUDGETS = (("read_amplification", 3.0, "max"), ("index_ms", None, "max"), ("decode_ms_per_second", None, "max"),
                   ("stale_frame_ratio", 0.05, "max"), ("frame_cache_hit_ratio", 0.25, "min"),
                   ("dropped_frame_ratio", 0.05, "max"))


def run_budgets(runs: DataFrame, keep: Sequence[str], limits: Mapping[str, float] | None = None) -> DataFrame:
    """One check per run and budgeted metric column that is present; limits override the defaults."""
    limits = limits or {}
    checks = []
    for name, default, direction in DEFAULT_BUDGETS:
        limit = limits.get(name, default)
        if limit is None or name not in runs.columns:
            continue
        v = F.col(name).cast("double")
        ok = v <= limit if direction == "max" else v >= limit
        checks.append(F.when(finite(v), F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(float(limit)).alias("limit"),
                                                 F.lit(direction).alias("direction"), ok.alias("pass"))))
    return runs.select(*keep, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(*keep, "c.*")


def counter_snapshot(counters: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sums of raw counters with guarded ratios."""
    names = ("source_bytes_read encoded_bytes_consumed frame_requests frame_cache_hits stale_frames presented_frames "
             "dropped_frames decode_ms decoded_seconds").split()
    s = counters.groupBy(*groups).agg(*[F.sum(n).alias(n) for n in names])

    def ratio(a, b, empty=0.0):
        return F.when(b > 0, a / b).otherwise(F.lit(empty))

    c = F.col
    amp = F.when(c("encoded_bytes_consumed") > 0, c("source_bytes_read") / c("encoded_bytes_consumed")).when(
        c("source_bytes_read") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return s.withColumn("read_amplification", amp).withColumn(
        "decode_ms_per_second", ratio(c("decode_ms"), c("decoded_seconds"))).withColumn(
        "frame_cache_hit_ratio", ratio(c("frame_cache_hits"), c("frame_requests"))).withColumn(
        "stale_frame_ratio", ratio(c("stale_frames"), c("presented_frames") + c("stale_frames"))).withColumn(
        "dropped_frame_ratio", ratio(c("dropped_frames"), c("presented_frames") + c("dropped_frames")))


def expectation_violations(rows: DataFrame, key: str, equal: Mapping[str, str] = {}, within: Mapping[str, tuple] = {},
                           prefix: Mapping[str, str] = {}) -> DataFrame:
    """(key, type, expected, actual) for rows that miss a stated expectation; an unstated (null) one is not checked.

    ``equal`` and ``prefix`` map expected column -> actual column; ``within`` maps expected -> (actual, tolerance).
    """
    s = lambda c: F.col(c).cast("string")
    rules = []

    def add(kind, e, a, bad):
        rules.append(F.when(F.col(e).isNotNull() & F.coalesce(bad, F.lit(True)),
                            F.struct(F.lit(kind).alias("type"), s(e).alias("expected"), s(a).alias("actual"))))

    for e, a in equal.items():
        add(a, e, a, F.col(e) != F.col(a))
    for e, (a, tol) in within.items():
        add(a, e, a, F.abs(F.col(a) - F.col(e)) > tol)
    for e, a in prefix.items():
        add(a, e, a, ~s(a).startswith(s(e)))
    return rows.select(key, F.explode(F.array_compact(F.array(*rules))).alias("v")).select(key, "v.*")


def manifest_violations(manifest: DataFrame, key: str, kind: str, kinds: Sequence[str], locations: Sequence[str],
                        optional: str | None = None) -> DataFrame:
    """Corpus manifest problems: id missing or repeated, kind unknown, no location, optional flag not boolean."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    nowhere = blank(locations[0])
    for c in locations[1:]:
        nowhere = nowhere & blank(c)
    codes = [F.when(blank(key), F.lit("id-required")),
             F.when(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)), F.lit("kind-unsupported")),
             F.when(nowhere, F.lit("location-required"))]
    if optional:
        codes.append(F.when(F.col(optional).isNotNull() & ~F.lower(optional).isin("true", "false"), F.lit("optional-not-boolean")))
    rows = manifest.select(F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*codes))).alias("code"))
    dup = manifest.where(~blank(key)).groupBy(F.col(key).cast("string").alias("id")).count().where("count > 1").select(
        "id", F.lit("id-duplicate").alias("code"))
    return rows.unionByName(dup)
