"""Stateful stream operators. Late-data rule of this package: watermark on event time (10 minutes by default); rows that
arrive behind the state of their key are passed through with ``late = true`` and change nothing.

Every operator here gives the same rows as its batch counterpart when no row is late.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .processors import Machine, duration_ms

WATERMARK = "10 minutes"
IDLE = "30 days"


def suppress_duplicates(stream: DataFrame, keys: Sequence[str], time: str, within: str = "24 hours") -> DataFrame:
    """First delivery per key inside ``within`` (request keys, nonces)."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def ordered_state(stream: DataFrame, keys: Sequence[str], order: Sequence[str], start: tuple, state: str,
                  step: Callable[[tuple, tuple], tuple], columns: Sequence[str], out: str, emit: Sequence[str], time: str | None = None,
                  idle: str = IDLE) -> DataFrame:
    """Run ``step(state, values) -> (state, outputs or None)`` over each key's rows in ``order``.

    Order columns are integers; the last position is part of the state, so rows behind it are late. Output rows are the
    keys, the ``emit`` columns, ``late`` and the outputs. With a ``time`` column the state of a key is forgotten once the watermark is
    ``idle`` past its last row; a key that comes back then starts anew. Without one, states stay.
    """
    return Machine(keys, order, columns, emit, out, start, state, step, time, duration_ms(idle)).run(stream, WATERMARK)


def throughput(downloads: DataFrame, session: str, order: Sequence[str], emit: Sequence[str], fast_half_life: float = 3.0,
               slow_half_life: float = 10.0, initial: float = 5_000_000.0, time: str | None = None, idle: str = IDLE) -> DataFrame:
    """Moving averages of the bit rate per session."""
    a, b = 1 - math.pow(0.5, 1 / fast_half_life), 1 - math.pow(0.5, 1 / slow_half_life)

    def step(state, values):
        size, seconds = values
        bps = max(1.0, size * 8 / max(0.001, seconds))
        fast, slow = state[0] + (bps - state[0]) * a, state[1] + (bps - state[1]) * b
        return (fast, slow), (fast, slow, min(fast, slow))

    return ordered_state(downloads, [session], order, (float(initial), float(initial)), "fast double, slow double", step,
                         ["bytes", "seconds"], "fast_bps double, slow_bps double, estimate double", emit, time, idle)


def quarantine(attempts: DataFrame, order: Sequence[str], emit: Sequence[str], threshold: int = 3, cooldown_ms: int = 30_000,
               time: str | None = None, idle: str = IDLE) -> DataFrame:
    """Consecutive failures, end of quarantine and whether the attempt was allowed, per backend."""
    def step(state, values):
        count, until = state
        result, at = values
        allowed = until <= at
        if result == "success":
            count, until = 0, 0
        elif result == "failure":
            count += 1
            until = int(at) + cooldown_ms if count >= threshold else until
        return (count, until), (count, until, bool(allowed))

    return ordered_state(attempts, ["backend_id"], order, (0, 0), "count bigint, until bigint", step, ["result", "at"],
                         "consecutive bigint, until bigint, allowed boolean", emit, time, idle)


def job_states(events: DataFrame, keys: Sequence[str], order: Sequence[str], emit: Sequence[str], max_attempts: int = 3,
               time: str | None = None, idle: str = IDLE) -> DataFrame:
    """Chunk status after each claim / complete / fail / release event."""
    def step(state, values):
        status, attempts = state
        kind, legal = values[0], True
        if kind == "claim" and (status == "pending" or (status == "failed" and attempts < max_attempts)):
            status, attempts = "running", attempts + 1
        elif kind == "complete" and status == "running":
            status = "complete"
        elif kind == "fail" and status == "running":
            status = "pending" if attempts < max_attempts else "failed"
        elif kind == "release" and status == "running":
            status, attempts = "pending", max(0, attempts - 1)
        else:
            legal = False
        return (status, attempts), (status, attempts, legal)

    return ordered_state(events, keys, order, ("pending", 0), "status string, attempts bigint", step, ["event"],
                         "status string, attempts bigint, legal boolean", emit, time, idle)


def transport(packets: DataFrame, pid: str, order: Sequence[str], emit: Sequence[str], time: str | None = None, idle: str = IDLE) -> DataFrame:
    """Continuity errors and unwrapped clock per pid; a discontinuity row resets both.

    Columns used: counter, raw, has_payload, discontinuity. ``expected`` is null when the counter followed on.
    """
    wrap = 1 << 33

    def step(state, values):
        last, raw_last, epoch = state
        counter, raw, payload, reset = values
        expected = None
        if payload:
            if not reset and last is not None and last >= 0 and counter != (last + 1) % 16:
                expected = (last + 1) % 16
            last = int(counter)
        if reset:
            raw_last, epoch = -1, 0
        if raw_last is not None and raw_last >= 0:
            jump = raw - raw_last
            epoch += 1 if jump < -(wrap // 2) else -1 if jump > wrap // 2 else 0
        return (last, int(raw), epoch), (expected, int(raw) + epoch * wrap)

    return ordered_state(packets, [pid], order, (-1, -1, 0), "last bigint, raw bigint, epoch bigint", step,
                         ["counter", "raw", "has_payload", "discontinuity"], "expected bigint, unwrapped bigint", emit, time, idle)


def correlate(stages: DataFrame, keys: Sequence[str], at: str, tie: str, time: str, watermark: str = WATERMARK,
              keep_ms: int = 600_000) -> DataFrame:
    """Closed stage records per key; open records are evicted (``evicted = true``) once the watermark is ``keep_ms`` past
    their last event, so state does not grow with keys that never finish. The next record of an evicted key has the next number, unless
    the key stays away for ``keep_ms`` more. ``processors.track_stages`` also bounds how many are open.
    """
    keys = list(keys)
    types = dict(stages.dtypes)
    fields = ("source", "submitted", "decoded")
    out = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "record bigint", *[f"{f}_at double" for f in fields], "output_at double", "evicted boolean"])
    names = [*keys, "record", *[f"{f}_at" for f in fields], "output_at", "evicted"]

    def run(key, frames, held):
        record, *seen = held.get if held.exists else (0, None, None, None)
        if held.hasTimedOut:
            if any(s is not None for s in seen):  # the number outlives the record, for as long again
                held.update((record + 1, None, None, None))
                held.setTimeoutTimestamp(held.getCurrentWatermarkMs() + keep_ms)
                yield pd.DataFrame([(*key, record, *seen, None, True)], columns=names)
            else:
                held.remove()
            return
        pdf = pd.concat(list(frames), ignore_index=True).sort_values([at, tie], kind="stable")
        rows, last = [], 0.0
        for stage, moment in zip(pdf["stage"], pdf[at]):
            last = max(last, float(moment))
            if stage == "output":
                rows.append((*key, record, *seen, float(moment), False))
                record, seen = record + 1, [None, None, None]
            elif stage == "source":
                seen[0] = float(moment) if seen[0] is None else seen[0]
            elif stage in fields:
                seen[fields.index(stage)] = float(moment)
        held.update((record, *seen))
        held.setTimeoutTimestamp(max(int(last) + keep_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    state = "record bigint, source_at double, submitted_at double, decoded_at double"
    return stages.withWatermark(time, watermark).groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def latency_cells(samples: DataFrame, time: str, value: str, window: str, watermark: str = WATERMARK, groups: Sequence[str] = ()) -> DataFrame:
    """Counts per (window, groups, whole millisecond): a bounded state from which any percentile can be read."""
    w = F.window(time, window)
    return samples.withWatermark(time, watermark).groupBy(w.alias("w"), *groups, F.round(value).cast("bigint").alias("ms")).agg(
        F.count("*").alias("n")).select(F.unix_micros("w.start").alias("window_us"), *groups, "ms", "n")


def distribution_of_cells(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """count, min, p50, p95, max of counted values (nearest rank, rounding the index up)."""
    from pyspark.sql import Window as W
    groups = list(groups)
    c = cells.groupBy(*groups, "ms").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*groups).orderBy("ms")
    total = W.partitionBy(*groups)
    c = c.withColumn("end", F.sum("n").over(w)).withColumn("total", F.sum("n").over(total))
    at = lambda p: F.min(F.when(F.col("end") > F.ceil((F.col("total") - 1) * p), F.col("ms")))
    return c.groupBy(*groups).agg(F.sum("n").alias("count"), F.min("ms").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("ms").alias("max"))


def sessions(events: DataFrame, key: str, time: str, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """Playback sessions: runs of events of a key with no gap longer than ``gap``."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, watermark).groupBy(s.alias("s"), key).agg(F.count("*").alias("events")).select(
        key, F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "events")
