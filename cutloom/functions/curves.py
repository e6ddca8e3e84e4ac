"""Column expressions: easing, decibels, panning, envelopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EASINGS = ("linear", "hold", "ease-in", "ease-out", "ease-in-out")  # fixed values
MIN_DB = -96.0


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ease(t: Column, easing: Column) -> Column:
    t = clamp(t, 0.0, 1.0)
    return (F.when(easing == "hold", F.lit(0.0)).when(easing == "ease-in", t * t)
            .when(easing == "ease-out", 1 - (1 - t) * (1 - t))
            .when(easing == "ease-in-out", F.when(t < 0.5, 2 * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(2.0)) / 2))
            .otherwise(t))


def db_to_gain(db: Column, floor: float = MIN_DB) -> Column:
    return F.when(db <= floor, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), db / 20))


def pan_gains(pan: Column) -> tuple[Column, Column]:
    angle = (clamp(pan, -1.0, 1.0) + 1) * (math.pi / 4)
    return F.cos(angle), F.sin(angle)


def fade(position: Column, remaining: Column, fade_in: Column, fade_out: Column) -> Column:
    """Envelope factor of a position with fades at both ends."""
    rise = F.when(fade_in > 0, clamp(position / fade_in, 0.0, 1.0)).otherwise(F.lit(1.0))
    fall = F.when(fade_out > 0, clamp(remaining / fade_out, 0.0, 1.0)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), rise, fall)


def envelope_at(t: Column, start: Column, duration: Column, fade_in: Column, fade_out: Column) -> Column:
    end = start + duration
    return F.when((t < start) | (t >= end), F.lit(0.0)).otherwise(
        fade(t - start, end - t, F.greatest(F.lit(0.0), fade_in), F.greatest(F.lit(0.0), fade_out)))


def source_time(t: Column, start: Column, in_point: Column, rate: Column) -> Column:
    return F.coalesce(in_point, F.lit(0.0)) + F.greatest(F.lit(0.0), t - F.coalesce(start, F.lit(0.0))) * F.coalesce(rate, F.lit(1.0))
