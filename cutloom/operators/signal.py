"""Aggregates over sample tables: (buffer_id, channel, i, v) with i from 0."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.curves import clamp, db_to_gain, envelope_at, fade, pan_gains, source_time
from .curves import normalize_curve, values_at
from .evaluation import explode_range
from .scan import span_of, span_scan

LOUDNESS_OFFSET, ABSOLUTE_GATE, RELATIVE_GATE, AUTOMATION_FLOOR = -0.691, -70.0, 10.0, -120.0  # fixed values
I_WIDTH = 1 << 20


def waveform(samples: DataFrame, bins: int) -> DataFrame:
    """(buffer_id, bin, peak): largest absolute value per slice over all channels, at most 1, three decimals.

    Slice b covers [floor(b/bins*n), max(start+1, floor((b+1)/bins*n))); with fewer samples than bins a sample can serve
    several slices, so the few candidate slices of a sample are tested with the exact edges.
    """
    size = samples.groupBy("buffer_id").agg((F.max("i") + 1).alias("n"))
    x = samples.join(size, "buffer_id")
    n, i = F.col("n"), F.col("i")
    guess_lo = F.greatest(F.lit(0), F.floor(i * bins / n) - 1).cast("bigint")
    guess_hi = F.least(F.lit(bins - 1), F.ceil((i + 1) * bins / n) + 1).cast("bigint")
    x = x.select("buffer_id", "i", F.abs("v").alias("a"), "n", F.explode(F.sequence(guess_lo, guess_hi)).alias("bin"))
    start = F.floor(F.col("bin") / F.lit(bins) * n)
    end = F.greatest(start + 1, F.floor((F.col("bin") + 1) / F.lit(bins) * n))
    peaks = x.where((i >= start) & (i < end)).groupBy("buffer_id", "bin").agg(F.max("a").alias("p"))
    grid = explode_range(size, F.lit(0), F.lit(bins), "bin").select("buffer_id", "bin")
    return grid.join(peaks, ["buffer_id", "bin"], "left").select(
        "buffer_id", "bin", F.round(F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0))), 3).alias("peak"))


def peaks(samples: DataFrame) -> DataFrame:
    return samples.groupBy("buffer_id").agg(F.max(F.abs("v")).alias("peak"))


def normalize_peak(samples: DataFrame, target: float = 0.98) -> DataFrame:
    x = samples.join(peaks(samples), "buffer_id")
    return x.withColumn("v", F.when(F.col("peak") > 0, F.col("v") * max(0.0, target) / F.when(F.col("peak") > 0, F.col("peak"))).otherwise(F.col("v"))).drop("peak")


def block_energy(samples: DataFrame, block: int, step: int, weights: Mapping[int, float] | None = None) -> DataFrame:
    """(buffer_id, block_no, energy): weighted mean square of overlapping blocks; a block may run past the end.

    Blocks start within the first channel (the lowest one a buffer has), whatever the length of the others.
    Squares fold first into cells of gcd(block, step) samples; only cells are copied to the blocks that cover them.
    """
    cell = math.gcd(block, step)
    cells = samples.groupBy("buffer_id", "channel", F.floor(F.col("i") / cell).cast("bigint").alias("cell")).agg(
        F.sum(F.col("v") * F.col("v")).alias("sq"), F.count("*").alias("n"))
    first = F.greatest(F.lit(0), F.floor((F.col("cell") * cell - block) / step) + 1).cast("bigint")
    last = F.floor(F.col("cell") * cell / step).cast("bigint")
    b = cells.withColumn("block_no", F.explode(F.sequence(first, last)))
    e = b.groupBy("buffer_id", "block_no", "channel").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"))
    w = F.lit(1.0)
    for channel, value in (weights or {}).items():
        w = F.when(F.col("channel") == channel, F.lit(float(value))).otherwise(w)
    first_channel = F.max(F.struct((-F.col("channel")).alias("c"), F.col("i").alias("i")))
    limit = samples.groupBy("buffer_id").agg((first_channel["i"] + 1).alias("len"))
    out = e.groupBy("buffer_id", "block_no").agg(F.sum(w * F.col("sq") / F.greatest(F.lit(1), F.col("n"))).alias("energy"))
    return out.join(limit, "buffer_id").where(F.col("block_no") * step < F.col("len")).drop("len")


def loudness_of(energy: Column) -> Column:
    return F.when(energy > 0, LOUDNESS_OFFSET + 10 * F.log10(F.when(energy > 0, energy))).otherwise(F.lit(float("-inf")))


def integrated_loudness(energies: DataFrame) -> DataFrame:
    """(buffer_id, ungated, threshold, integrated): absolute gate, then a gate relative to the first mean."""
    loud = energies.withColumn("l", loudness_of(F.col("energy")))
    absolute = loud.where(F.col("l") >= ABSOLUTE_GATE)
    first = absolute.groupBy("buffer_id").agg(F.avg("energy").alias("m"))
    all_ = energies.select("buffer_id").distinct().join(first, "buffer_id", "left").select(
        "buffer_id", loudness_of(F.coalesce("m", F.lit(0.0))).alias("ungated"))
    all_ = all_.withColumn("threshold", F.col("ungated") - RELATIVE_GATE)
    second = absolute.join(all_, "buffer_id").where(F.col("l") >= F.col("threshold")).groupBy("buffer_id").agg(F.avg("energy").alias("g"))
    return all_.join(second, "buffer_id", "left").select("buffer_id", "ungated", "threshold", loudness_of(F.coalesce("g", F.lit(0.0))).alias("integrated"))


def loudness_gain(rows: DataFrame, target: float = -14.0, max_gain: float = 24.0, min_gain: float = -60.0, max_peak_db: float = -1.0) -> DataFrame:
    """Gain in dB that brings ``integrated`` to the target without the ``peak`` passing its ceiling."""
    finite = F.abs("integrated") != F.lit(float("inf"))
    gain = F.when(finite, clamp(F.lit(target) - F.col("integrated"), min_gain, max_gain)).otherwise(F.lit(0.0))
    after = 20 * F.log10(F.when(F.col("peak") > 0, F.col("peak"))) + gain
    return rows.withColumn("gain_db", F.coalesce(F.when(after > max_peak_db, gain - (after - max_peak_db)), gain))


def resample(samples: DataFrame, rate_from: float, rate_to: float) -> DataFrame:
    """Linear resampling: target frame f reads position f * rate_from / rate_to.

    The grid is regular, so each source sample makes its own target frames: no as-of join and no generated grid.
    """
    ratio = rate_from / rate_to
    size = samples.groupBy("buffer_id", "channel").agg((F.max("i") + 1).alias("n"))
    x = span_scan(samples, ["buffer_id", "channel"], ["i"], span_of("i", I_WIDTH), __next=("lead", F.col("v")))
    x = x.join(size, ["buffer_id", "channel"]).withColumn("__len", F.round(F.col("n") / ratio).cast("bigint"))
    lo = F.greatest(F.lit(0), F.floor(F.col("i") / ratio) - 1).cast("bigint")
    hi = F.ceil((F.col("i") + 1) / ratio).cast("bigint") + 1
    x = x.withColumn("f", F.explode(F.sequence(lo, hi)))
    pos = F.col("f") * ratio
    x = x.where((F.col("f") < F.col("__len")) & (F.floor(pos) == F.col("i")))
    mix = pos - F.col("i")
    v = F.when(pos >= F.col("n") - 1, F.col("v")).otherwise(F.col("v") * (1 - mix) + F.col("__next") * mix)
    return x.select("buffer_id", "channel", F.col("f").alias("i"), v.alias("v"))


def with_next(samples: DataFrame) -> DataFrame:
    return span_scan(samples, ["buffer_id", "channel"], ["i"], span_of("i", I_WIDTH), __next=("lead", F.col("v")))


MIX_FRAMES = 64  # frames of a piece, samples of a block


def _sample_blocks(sources: DataFrame) -> DataFrame:
    """(buffer_id, channel, __block, __samples): samples with the next ones by their place in a block; null where there is none."""
    held = with_next(sources).groupBy("buffer_id", F.col("channel").cast("bigint").alias("channel"), F.floor(F.col("i") / MIX_FRAMES).cast("bigint").alias("__block")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.pmod(F.col("i"), F.lit(MIX_FRAMES)).cast("int").alias("k"), F.struct("v", F.col("__next").alias("next")).alias("s")))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(MIX_FRAMES - 1))
    return held.select("buffer_id", "channel", "__block", F.transform(places, lambda k: F.try_element_at("m", k)).alias("__samples"))


def mix(items: DataFrame, sources: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stereo mix: (output_id, i, left, right).

    Items: item_id, output_id, buffer_id, dest_start, source_start, frames, playback_rate, gain_db, pan, fade_in, fade_out (frames).
    Sources are two-channel sample tables; positions between samples are interpolated; ``lengths`` is (output_id, length).
    """
    size = sources.groupBy("buffer_id").agg(*[(F.max(F.when(F.col("channel") == c, F.col("i"))) + 1).alias(f"n{c}") for c in (0, 1)])
    x = items.join(size, "buffer_id").join(lengths, "output_id")
    available = F.floor((F.greatest("n0", "n1") - F.col("source_start")) / F.col("playback_rate"))
    frames = F.greatest(F.lit(0), F.least(F.col("length") - F.col("dest_start"), F.coalesce(F.col("frames"), available)))
    # pieces of items meet blocks of samples, so what is shuffled grows with items and not with their frames
    x = explode_range(x.withColumn("__frames", frames.cast("bigint")), F.lit(0), F.ceil(F.col("__frames") / MIX_FRAMES).cast("bigint"), "__piece")
    # one row per output side; a mono source plays on both, a short channel holds its last sample
    side = lambda c, n: F.struct(F.lit(c).alias("side"), (F.lit(c) if c == 0 else F.when(F.col("n1").isNull(), 0).otherwise(1)).cast("bigint").alias("channel"), n.alias("n"))
    x = x.withColumn("__s", F.explode(F.array(side(0, F.col("n0")), side(1, F.coalesce("n1", "n0"))))).select("*", "__s.*")
    at = lambda f: F.greatest(F.lit(0.0), F.least(F.col("n") - 1, F.col("source_start") + f * F.col("playback_rate")))
    block = lambda i: F.floor(i / MIX_FRAMES).cast("bigint")
    first, last = F.col("__piece") * MIX_FRAMES, F.least(F.col("__frames"), (F.col("__piece") + 1) * MIX_FRAMES) - 1
    ends = block(at(first)), block(at(last))
    x = x.withColumn("__block", F.explode(F.sequence(F.least(*ends), F.greatest(*ends)))).join(_sample_blocks(sources), ["buffer_id", "channel", "__block"])
    x = x.withColumn("f", F.explode(F.sequence(first, last))).withColumn("__pos", at(F.col("f"))).withColumn("i", F.floor("__pos").cast("bigint"))
    y = x.where(block(F.col("i")) == F.col("__block")).withColumn("__v", F.get("__samples", F.pmod(F.col("i"), F.lit(MIX_FRAMES)).cast("int"))).where("__v is not null").select(
        "*", F.col("__v.v").alias("v"), F.col("__v.next").alias("__next"))
    part = F.col("__pos") - F.col("i")
    value = F.when(part > 0, F.col("v") * (1 - part) + F.coalesce("__next", "v") * part).otherwise(F.col("v"))
    gain = fade(F.col("f").cast("double"), (F.col("__frames") - F.col("f")).cast("double"), F.col("fade_in"), F.col("fade_out")) * db_to_gain(F.col("gain_db"))
    lp, rp = pan_gains(F.col("pan"))
    total = lambda c, pan: F.coalesce(F.sum(F.when(F.col("side") == c, value * gain * pan)), F.lit(0.0))
    return y.groupBy("output_id", (F.col("dest_start") + F.col("f")).alias("i")).agg(total(0, lp).alias("left"), total(1, rp).alias("right"))


def mix_plan(clips: DataFrame, start: float, end: float, rate: int) -> DataFrame:
    """Clips that sound in [start, end) in sample units, clipped to the range."""
    e = F.col("start") + F.col("duration")
    at = lambda c: F.greatest(F.lit(0), F.round(c * rate).cast("bigint"))
    x = clips.where((e > start) & (F.col("start") < end))
    return x.select("clip_id", "asset_id", at(F.greatest(F.lit(start), F.col("start"))).alias("start_sample"),
                    at(F.least(F.lit(end), e)).alias("end_sample"), at(F.col("in_point")).alias("source_in"), "playback_rate")


def mix_at(active: DataFrame) -> DataFrame:
    """Per active clip at ``t``: source time, envelope, gain and side gains (gain_db, pan, fade_in, fade_out columns)."""
    env = envelope_at(F.col("t"), F.col("start"), F.col("duration"), F.col("fade_in"), F.col("fade_out"))
    x = active.withColumn("envelope", env).withColumn("gain", db_to_gain(F.col("gain_db")) * F.col("envelope"))
    lp, rp = pan_gains(F.col("pan"))
    return x.withColumn("left_gain", F.col("gain") * lp).withColumn("right_gain", F.col("gain") * rp).withColumn(
        "source_time", source_time(F.col("t"), F.col("start"), F.col("in_point"), F.col("playback_rate")))


def automate_gain(samples: DataFrame, points: DataFrame, rate: float, start: float = 0.0, width: float = 86400.0) -> DataFrame:
    """Apply a gain curve (buffer_id, time, value in dB, easing, ordinal) to every sample of its buffer."""
    s = samples.withColumn("__t", F.lit(start) + F.col("i") / rate)
    x = values_at(normalize_curve(points, ["buffer_id"]), s, ["buffer_id"], "__t", 0.0, width, "db")
    return x.withColumn("v", F.col("v") * db_to_gain(F.col("db"), AUTOMATION_FLOOR)).drop("__t", "db")


def automate_pan(samples: DataFrame, points: DataFrame, rate: float, start: float = 0.0, width: float = 86400.0) -> DataFrame:
    s = samples.withColumn("__t", F.lit(start) + F.col("i") / rate)
    x = values_at(normalize_curve(points, ["buffer_id"]), s, ["buffer_id"], "__t", 0.0, width, "pan")
    lp, rp = pan_gains(F.col("pan"))
    return x.withColumn("v", F.col("v") * F.when(F.col("channel") == 0, lp).when(F.col("channel") == 1, rp).otherwise(F.lit(1.0))).drop("__t", "pan")


def merge_blocks(blocks: DataFrame, ranges: DataFrame, rate: float) -> DataFrame:
    """One dense range per buffer from sparse blocks; gaps are 0 and the later block wins.

    Block samples: buffer_id, channel, block_no, timestamp, offset, v; ranges: buffer_id, range_start, range_end (seconds).
    """
    r = ranges.withColumn("__a", F.greatest(F.lit(0), F.floor(F.col("range_start") * rate)).cast("bigint")).withColumn(
        "__b", F.greatest(F.col("__a"), F.ceil(F.col("range_end") * rate).cast("bigint")))
    at = F.round(F.col("timestamp") * rate).cast("bigint") + F.col("offset")
    s = blocks.withColumn("i", at).join(r.select("buffer_id", "__a", "__b"), "buffer_id").where((F.col("i") >= F.col("__a")) & (F.col("i") < F.col("__b")))
    won = s.groupBy("buffer_id", "channel", "i").agg(F.max_by("v", "block_no").alias("v"))
    channels = blocks.select("buffer_id", "channel").distinct()
    grid = explode_range(r, F.col("__a"), F.col("__b"), "i").select("buffer_id", "i", "__a").join(channels, "buffer_id")
    return grid.join(won, ["buffer_id", "channel", "i"], "left").select(
        "buffer_id", "channel", (F.col("i") - F.col("__a")).alias("i"), F.coalesce("v", F.lit(0.0)).alias("v"))


def blocks_of(samples: DataFrame, frames: int) -> DataFrame:
    """Fixed-size blocks; a block holds at most ``frames`` values, so the lists are bounded."""
    b = F.floor(F.col("i") / frames).cast("bigint")
    g = samples.groupBy("buffer_id", "channel", b.alias("block_no")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    return g.select("buffer_id", "channel", "block_no", (F.col("block_no") * frames).alias("start"), F.size("x").cast("bigint").alias("length"),
                    F.transform("x", lambda s: s["v"]).alias("values"))
