"""Frame plans: time grids, effects, transitions, motion samples and scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.curves import clamp, ease
from . import timeline
from .curves import values_at
from .intervals import explode_range
from .scan import span_of, span_scan

# Defaults and limits (low, default, high) of the animated properties.
TRANSFORM = {"x": (None, 0.0, None), "y": (None, 0.0, None), "scale_x": (None, 1.0, None), "scale_y": (None, 1.0, None),
             "rotation": (None, 0.0, None), "opacity": (0.0, 1.0, 1.0), "anchor_x": (0.0, 0.5, 1.0),
             "anchor_y": (0.0, 0.5, 1.0), "crop_top": (0.0, 0.0, 1.0), "crop_right": (0.0, 0.0, 1.0),
             "crop_bottom": (0.0, 0.0, 1.0), "crop_left": (0.0, 0.0, 1.0)}
EFFECT_TYPES = ("brightness", "contrast", "saturation", "blur", "hue", "gain", "pan")


def frame_times(outputs: DataFrame) -> DataFrame:
    """Outputs (.., fps, range_start, range_end) times frames: ``frame`` and ``t``; the end frame is exclusive."""
    fps = F.col("fps")
    x = explode_range(outputs.where((fps > 0) & (F.col("range_end") > F.col("range_start"))),
                      F.ceil(F.col("range_start") * fps - 1e-9), F.ceil(F.col("range_end") * fps - 1e-9), "frame")
    return x.withColumn("t", F.col("frame") / fps)


def resolve_fps(explicit: Column, node: Column, plan: Column, fallback: float = 30.0) -> Column:
    """First positive rate of: explicit, node, plan, default."""
    good = lambda c: F.when((c > 0) & ~F.isnan(c), c)
    return F.coalesce(good(explicit), good(node), good(plan), F.lit(fallback))


def ordered_effects(effects: DataFrame, width: float = 1 << 20) -> DataFrame:
    """Enabled effects of every target in order, long form with ``position`` from 0."""
    e = effects.where(F.coalesce("enabled", F.lit(True)))
    x = span_scan(e, ["target_id"], ["ord", "effect_id"], span_of("effect_id", 1e15), position=("row_number",))
    return x.withColumn("position", F.col("position") - 1)


def transition(t: Column, start: Column, duration: Column, in_duration: Column, in_easing: Column, out_duration: Column,
               out_easing: Column) -> Column:
    """Struct (direction, progress) or null; the way in wins over the way out."""
    end = start + duration
    incoming = (in_duration > 0) & (t < start + in_duration)
    outgoing = (out_duration > 0) & (t > end - out_duration)
    safe = lambda d: F.when(d > 0, d)
    # the transition easings have no hold
    soft = lambda e: F.when(e == "hold", F.lit("linear")).otherwise(e)
    return F.when(incoming, F.struct(F.lit("in").alias("direction"), ease((t - start) / safe(in_duration), soft(in_easing)).alias("progress"))).when(
        outgoing, F.struct(F.lit("out").alias("direction"), ease((end - t) / safe(out_duration), soft(out_easing)).alias("progress")))


def normalize_transform(rows: DataFrame) -> DataFrame:
    """Missing or non-finite properties become their default; bounded ones are clamped."""
    for name, (lo, default, hi) in TRANSFORM.items():
        if name in rows.columns:
            v = F.col(name).cast("double")
            v = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v).otherwise(F.lit(default))
            rows = rows.withColumn(name, v if lo is None else clamp(v, lo, hi))
    return rows


def animated(rows: DataFrame, points: DataFrame, node: str, time: str, row_id: Sequence[str], properties: Sequence[str],
             width: float = 86400.0) -> DataFrame:
    """Add one column per property with its animated value at ``time`` (default when the node has no such curve).

    ``points``: (node, property, time, value, easing, ordinal). All properties go through one as-of scan, then pivot.
    """
    row_id = list(row_id)
    probes = rows.select(*row_id, F.col(node).alias("node"), F.col(time).alias("__at"),
                         F.explode(F.array(*[F.lit(p) for p in properties])).alias("property"))
    p = points.withColumnRenamed(node, "node") if node != "node" else points
    v = values_at(p, probes, ["node", "property"], "__at", None, width)
    wide = v.groupBy(*row_id).agg(*[
        F.max(F.when(F.col("property") == n, F.col("value_at"))).alias(n) for n in properties])
    return normalize_transform(rows.join(wide, row_id))


def frame_plan(clips: DataFrame, tracks: DataFrame, times: DataFrame, points: DataFrame, effects: DataFrame,
               properties: Sequence[str] = ("x", "opacity"), width: float = 600.0) -> DataFrame:
    """Every (t, clip) to draw or hear: kind, order, source time, animated properties, effects, transition.

    ``clips`` may carry node (animation key), in_duration / out_duration / in_easing / out_easing.
    """
    a = timeline.source_times(timeline.active_at(clips, times, tracks, None, width))
    a = a.where(~F.coalesce("muted", F.lit(False)) & F.col("track_kind").isin("visual", "audio"))
    a = a.withColumn("kind", F.when(F.col("track_kind") == "audio", "audio").otherwise("clip"))
    a = animated(a, points, "node", "t", ["t", "clip_id"], properties)
    tr = transition(F.col("t"), F.col("start"), F.col("duration"), F.col("in_duration"), F.col("in_easing"),
                    F.col("out_duration"), F.col("out_easing"))
    a = a.withColumn("__tr", F.when(F.col("kind") == "clip", tr))
    n = effects.where(F.coalesce("enabled", F.lit(True))).groupBy(F.col("target_id").alias("clip_id")).agg(F.count("*").alias("effects"))
    return a.join(n, "clip_id", "left").select(
        "t", "clip_id", "kind", "ord", "asset_id", "source_time", *properties, F.col("__tr.direction").alias("direction"),
        F.col("__tr.progress").alias("progress"), F.coalesce("effects", F.lit(0)).alias("effects"))


# --- scaling and sampling ---------------------------------------------------------------------------------------------

def preview_scale(width: Column, height: Column, max_width: float = 1600, max_height: float = 900,
                  max_pixels: float = 1_500_000, upscale: bool = False) -> Column:
    w, h = (F.when(c > 0, c).otherwise(F.lit(1.0)) for c in (width, height))
    limits = [F.lit(float(max_width)) / w, F.lit(float(max_height)) / h, F.sqrt(F.lit(float(max_pixels)) / (w * h))]
    return F.least(*limits) if upscale else F.least(F.lit(1.0), *limits)


def proxy_size(width: Column, height: Column, long_edge: float = 1280) -> tuple[Column, Column]:
    w, h = (F.when(c > 0, c).otherwise(F.lit(1.0)) for c in (width, height))
    s = F.least(F.lit(1.0), F.lit(float(long_edge)) / F.greatest(w, h))
    px = lambda c: F.greatest(F.lit(1), F.round(c * s).cast("bigint"))
    return px(w), px(h)


def proxy_tier(width: Column, height: Column, viewport: float = 1920, ratio: float = 1) -> Column:
    target = max(320.0, float(viewport) * float(ratio))
    edge = F.greatest(F.coalesce(width, F.lit(0.0)), F.coalesce(height, F.lit(0.0)))
    tiers = ((640, "540p"), (1280, "720p"), (1920, "1080p"))  # fixed values
    out = F.when(edge <= 0, "original")
    for limit, name in tiers:
        if target <= limit:
            out = out.when(edge > limit, name)
    return out.otherwise("original")


def shutter_samples(rows: DataFrame, time: str, fps: str, samples: int = 8, angle: float = 180.0, phase: str = "centered",
                    curve: str = "box") -> DataFrame:
    """``samples`` weighted sub-times per row: sample, alpha, sample_time, weight (weights of a row sum to 1)."""
    n = max(1, min(64, samples))
    alphas = [0.5 if n == 1 else i / (n - 1) for i in range(n)]
    shape = {"triangle": lambda a: 1 - abs(a * 2 - 1), "cosine": lambda a: 0.5 - 0.5 * math.cos(math.pi * 2 * a)}.get(curve, lambda a: 1.0)
    raw = [shape(a) for a in alphas]
    total = sum(raw) or 1.0
    exposure = (max(0.0, min(360.0, angle)) / 360) / F.greatest(F.lit(0.001), F.col(fps))
    offset = {"leading": 0.0, "trailing": -1.0}.get(phase, -0.5)
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("sample"), F.lit(a).alias("alpha"), F.lit(w / total).alias("weight"))
                            for i, (a, w) in enumerate(zip(alphas, raw))]))
    x = rows.withColumn("__e", exposure).withColumn("__s", e)
    return x.select(*rows.columns, "__s.sample", "__s.alpha",
                    (F.col(time) + F.col("__e") * offset + F.col("__e") * F.col("__s.alpha")).alias("sample_time"), "__s.weight")
