"""Stream operators whose state has several parts with lifetimes of their own, on one base.

``Ordered`` feeds a key's rows to ``step`` in order, passes rows on that arrive behind the state of their key (``late = true``), and
forgets a key once the watermark is ``idle_ms`` past its last row. Rows older than the watermark never get here. What an operator remembers between rows is its own; state that can
grow is kept in a map and only the entries that a batch touches are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def keyed_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state with several parts needs; the setting is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def duration_ms(text: str) -> int:
    """'10 minutes' and the like in milliseconds."""
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}[unit.rstrip("s")]


class Ordered(StatefulProcessor):
    """Base of the operators below; ``run`` gives a stream of keys, ``emit`` columns, late and the outputs.

    One key's rows of one micro-batch are in memory at a time: bound the batch with maxFilesPerTrigger / maxBytesPerTrigger.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], emit: Sequence[str], out: str, time: str | None,
                 idle_ms: int):
        self.keys, self.order, self.columns, self.emit = list(keys), list(order), list(columns), list(emit)
        self.out, self.time, self.idle_ms = out, time, idle_ms
        self.names = [*self.keys, *self.emit, "late", *[p.split()[0] for p in out.split(", ")]]

    # --- what an operator adds ---
    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declares its state."""

    def load(self, timers) -> None:
        """Before the rows of a key."""

    def step(self, values: tuple, now: int | None) -> list[tuple]:
        """The output rows of one row, each without keys and ``emit`` columns."""
        raise NotImplementedError

    def save(self) -> None:
        """After the rows of a key."""

    def wake_at(self) -> int | None:
        """When the operator wants to be called, in event time."""
        return None

    def wake(self, now: int) -> list[tuple]:
        """Output rows at that time; their ``emit`` columns are null."""
        return []

    def forget(self) -> None:
        """Clears its state."""

    # --- the stream ---
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [*[f"at{i} bigint" for i in range(len(self.order))], "last_ms bigint", "timer bigint"]
        self.place = handle.getValueState("place", ", ".join(fields))
        self.open(handle)

    def _timer(self, last_ms: int | None, old: int | None, now: int) -> int | None:
        """Sets the next timer of the key and gives its time."""
        if self.time is None or last_ms is None:
            return None
        own = self.wake_at()
        at = max(min(last_ms + self.idle_ms, own if own is not None else last_ms + self.idle_ms), now + 1)
        if at != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.place.get() if self.place.exists() else (*[None] * len(self.order), None, None)
        at, last_ms, timer = held[:len(self.order)], held[-2], held[-1]
        frame = pd.concat([r for r in rows], ignore_index=True).sort_values(self.order, kind="stable")
        self.load(timerValues)
        out = []
        wide = [frame[c].tolist() for c in (*self.order, *self.emit, *self.columns)]
        moments = frame[self.time].astype("int64").tolist() if self.time else [None] * len(frame)
        n, m = len(self.order), len(self.order) + len(self.emit)
        blank = (None,) * (len(self.names) - len(self.keys) - len(self.emit) - 1)
        for now, values in zip(moments, zip(*wide)):
            place, passed = values[:n], values[n:m]
            if at[0] is not None and tuple(place) <= tuple(at):
                out.append((*key, *passed, True, *blank))
                continue
            at = place
            if now is not None:
                last_ms = now if last_ms is None else max(last_ms, now)
            out.extend((*key, *passed, False, *made) for made in self.step(values[m:], now))
        self.save()
        timer = self._timer(last_ms, timer, timerValues.getCurrentWatermarkInMs() if self.time else 0)
        self.place.update((*[int(p) for p in at], last_ms, timer))
        yield pd.DataFrame(out, columns=self.names, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        *at, last_ms, timer = self.place.get()
        self.load(timerValues)
        out = [(*key, *[None] * len(self.emit), False, *made) for made in self.wake(now)]
        if last_ms + self.idle_ms <= now:
            self.forget()
            self.place.clear()
        else:
            self.save()
            self.place.update((*at, last_ms, self._timer(last_ms, None, now)))
        yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass

    def run(self, stream: DataFrame, watermark: str | None) -> DataFrame:
        types = dict(stream.dtypes)
        schema = ", ".join([*[f"`{c}` {types[c]}" for c in (*self.keys, *self.emit)], "late boolean", self.out])
        need = dict.fromkeys([*self.keys, *self.order, *self.emit, *self.columns])
        if self.time is None:
            return stream.select(*need).groupBy(*self.keys).transformWithStateInPandas(self, schema, "append", "none")
        event_time, self.time = self.time, "event_time_ms"
        marked = stream.withWatermark(event_time, watermark).select(*need, F.col(event_time).alias("event_time_mark"),
                                                                     F.unix_millis(event_time).alias("event_time_ms"))
        return marked.groupBy(*self.keys).transformWithStateInPandas(self, schema, "append", "eventtime")


class LiveIndex(Ordered):
    """Chunks of a growing source that nobody has consumed yet, per track.

    A chunk is pending from its first delivery until it is acknowledged, by itself or with all chunks that end at or before an offset. An
    acknowledgement also tells how far the source can be thrown away: up to the first pending chunk, or to the end of what was indexed.
    Deliveries of pending chunks, and of chunks that lie before what was thrown away, are repeated ones.

    Pending chunks lie in a map by ranges of ``range_bytes`` of their offset: a delivery reads one range, an acknowledgement those that it
    empties and one more.
    """

    OUT = "is_new boolean, acked bigint, pending bigint, total bigint, acked_total bigint, safe bigint"

    def __init__(self, keys, order, emit, kind: str, offset: str, size: str, time: str | None, idle_ms: int, range_bytes: int):
        super().__init__(keys, order, [kind, offset, size], emit, self.OUT, time, idle_ms)
        self.range_bytes = range_bytes

    def open(self, handle):
        self.head = handle.getValueState("head", "pending bigint, total bigint, acked bigint, cursor bigint, safe bigint, ranges array<bigint>")
        self.map = handle.getMapState("chunks", "range bigint", "offsets array<bigint>, sizes array<bigint>")

    def load(self, timers):
        held = self.head.get() if self.head.exists() else (0, 0, 0, 0, 0, [])
        self.pending, self.total, self.acked, self.cursor, self.safe = held[:5]
        self.ranges = {int(r) for r in held[5]}
        self.seen: dict[int, set[tuple[int, int]]] = {}  # ranges read or written in this batch
        self.changed: set[int] = set()

    def _range(self, number: int) -> set[tuple[int, int]]:
        if number not in self.seen:
            offsets, sizes = self.map.getValue((number,)) if number in self.ranges else ([], [])
            self.seen[number] = {(int(o), int(s)) for o, s in zip(offsets, sizes)}
        return self.seen[number]

    def _drop(self, number: int, gone: set[tuple[int, int]]) -> int:
        if gone:
            held = self._range(number)
            held -= gone
            self.changed.add(number)
            if not held:
                self.ranges.discard(number)
        return len(gone)

    def step(self, values, now):
        kind, offset, size = values[0], int(values[1]), int(values[2] or 0)
        number, chunk = offset // self.range_bytes, (offset, size)
        new, acked = False, 0
        if kind == "chunk":
            new = offset + size > self.safe and chunk not in self._range(number)
            if new:
                self._range(number).add(chunk)
                self.ranges.add(number)
                self.changed.add(number)
                self.cursor = max(self.cursor, offset + size)
        elif kind == "one":
            acked = self._drop(number, self._range(number) & {chunk})
        elif kind == "through":
            for r in sorted(x for x in self.ranges if x * self.range_bytes <= offset):
                acked += self._drop(r, {c for c in self._range(r) if c[0] + c[1] <= offset})
        self.total += new
        self.acked += acked
        self.pending += new - acked
        if kind in ("one", "through"):
            first = min(self._range(min(self.ranges)))[0] if self.ranges else self.cursor
            self.safe = max(self.safe, min(first, self.cursor))
        return [(new, acked, self.pending, self.total, self.acked, self.safe)]

    def save(self):
        for number in self.changed:
            held = sorted(self.seen[number])
            if held:
                self.map.updateValue((number,), ([c[0] for c in held], [c[1] for c in held]))
            elif self.map.containsKey((number,)):
                self.map.removeKey((number,))
        self.head.update((self.pending, self.total, self.acked, self.cursor, self.safe, sorted(self.ranges)))

    def forget(self):
        self.head.clear()
        self.map.clear()


def live_index(stream: DataFrame, keys: Sequence[str], order: Sequence[str], emit: Sequence[str], time: str | None = None, kind: str = "kind",
               offset: str = "offset", size: str = "size", watermark: str = "10 minutes", idle: str = "1 days", range_bytes: int = 1 << 26) -> DataFrame:
    """Per row whether its chunk is new, how many chunks it acknowledges, and the track's counts and safe offset after it.

    ``kind`` is chunk (offset, size), one (acknowledges that chunk) or through (acknowledges all that end at or before offset); other kinds
    change nothing. With a ``time`` column a track is forgotten once it has been idle that long.
    """
    return LiveIndex(keys, order, emit, kind, offset, size, time, duration_ms(idle), range_bytes).run(stream, watermark)


class StageTracker(Ordered):
    """Stages of media records per session: source, submitted, decoded, output.

    A record opens with its first stage and closes with its output. At most ``cap`` records of a session are open: beyond it the one
    opened first is thrown out; so is one without a new stage for ``keep_ms``. The number of a record counts all records ever opened in the
    session, and lives as long as the session does, whatever becomes of the records.
    """

    OUT = ("key string, record bigint, reason string, source_at double, submitted_at double, decoded_at double, output_at double, "
           "evicted bigint, open bigint")
    STAGES = ("source", "submitted", "decoded")

    def __init__(self, keys, order, key: str, stage: str, at: str, time: str | None, idle_ms: int, cap: int, keep_ms: int):
        super().__init__(keys, order, [key, stage, at], [], self.OUT, time, idle_ms)
        self.cap, self.keep_ms = cap, keep_ms

    def open(self, handle):
        self.counters = handle.getValueState("counters", "records bigint, evicted bigint")
        self.map = handle.getMapState("open", "key string", "record bigint, source_at double, submitted_at double, decoded_at double, last_ms bigint")

    def load(self, timers):
        self.records, self.evicted = self.counters.get() if self.counters.exists() else (0, 0)
        held = sorted(((k[0], list(v)) for k, v in self.map.iterator()), key=lambda kv: kv[1][0])  # at most ``cap``
        self.held = OrderedDict(held)
        self.stored, self.changed = set(self.held), set()

    def _told(self, key: str, r: list, reason: str, output: float | None) -> tuple:
        return key, r[0], reason, r[1], r[2], r[3], output, self.evicted, len(self.held)

    def _evict(self, key: str, reason: str) -> tuple:
        r = self.held.pop(key)
        self.changed.add(key)
        self.evicted += 1
        return self._told(key, r, reason, None)

    def step(self, values, now):
        key, stage, at = str(values[0]), values[1], float(values[2])
        if stage not in (*self.STAGES, "output"):
            return []
        r = self.held.get(key)
        if r is None:
            r = [self.records, None, None, None, None]
            self.records += 1
        self.changed.add(key)
        if stage == "output":
            self.held.pop(key, None)
            return [self._told(key, r, "output", at)]
        k = 1 + self.STAGES.index(stage)
        r[k] = at if stage != "source" or r[k] is None else r[k]
        r[4] = now
        self.held[key] = r
        return [self._evict(next(iter(self.held)), "cap")] if len(self.held) > self.cap else []

    def wake_at(self):
        moments = [r[4] for r in self.held.values() if r[4] is not None]
        return min(moments) + self.keep_ms if moments else None

    def wake(self, now):
        old = [k for k, r in self.held.items() if r[4] is not None and r[4] + self.keep_ms <= now]
        return [self._evict(k, "age") for k in old]

    def save(self):
        for key in self.changed:
            if key in self.held:
                self.map.updateValue((key,), tuple(self.held[key]))
            elif key in self.stored:
                self.map.removeKey((key,))
        self.counters.update((self.records, self.evicted))

    def forget(self):
        self.counters.clear()
        self.map.clear()


def track_stages(stream: DataFrame, keys: Sequence[str], order: Sequence[str], key: str = "key", stage: str = "stage", at: str = "at_ms",
                 time: str | None = None, watermark: str = "10 minutes", cap: int = 1024, keep: str = "10 minutes", idle: str = "1 days") -> DataFrame:
    """Records that ended, with why: output, cap or age; ``evicted`` and ``open`` are the session's counts right after.

    The first source time wins, the last time of the other stages. With a ``time`` column records end by age, and sessions are forgotten
    once idle; records open then end by age first, since ``keep`` is below ``idle``.
    """
    keep_ms, idle_ms = duration_ms(keep), duration_ms(idle)
    if keep_ms > idle_ms:
        raise ValueError("records cannot be kept longer than their session")
    return StageTracker(keys, order, key, stage, at, time, idle_ms, max(1, cap), keep_ms).run(stream, watermark)


class Machine(Ordered):
    """A fold ``step(state, values) -> (state, outputs or None)`` with one tuple of state per key."""

    def __init__(self, keys, order, columns, emit, out: str, start: tuple, state: str, step, time: str | None, idle_ms: int):
        super().__init__(keys, order, columns, emit, out, time, idle_ms)
        self.start, self.state_schema, self.fold = start, state, step

    def open(self, handle):
        self.own = handle.getValueState("own", self.state_schema)

    def load(self, timers):
        self.value = tuple(self.own.get()) if self.own.exists() else self.start

    def step(self, values, now):
        self.value, made = self.fold(self.value, values)
        return [] if made is None else [made]

    def save(self):
        self.own.update(self.value)

    def forget(self):
        self.own.clear()
