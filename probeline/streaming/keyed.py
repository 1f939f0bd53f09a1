"""State per key with timers: counter deltas (ST3), health watchdog (ST4) and count stability (ST5).

A micro-batch reads and writes the state of its own keys only. Deadlines are event-time timers, so they also end keys that
have gone silent; an ended key is remembered until it has been silent for ``keep_s`` and is then forgotten. Rows of a key
are taken in order within a micro-batch; a row that is not after the last one taken of its key is late and changes nothing.
A micro-batch that is replayed after a failure starts from the state before it.

What a key sends within one micro-batch is sorted by one task, on disk beyond ``SORT_MB``, so keys are things that are polled
or sampled at a rate (nodes, steps), and a micro-batch is limited by its files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.shuffle import ExternalSorter
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
SORT_MB = 384  # memory of a worker beyond which the rows it sorts go to disk


def places(order: Sequence[str]) -> list[Column]:
    """Order columns as whole numbers: the first is a time in microseconds, the others are whole numbers already."""
    first, *rest = order
    return [F.unix_micros(F.col(first).cast("timestamp")).alias("_o0"), *[F.col(c).cast("bigint").alias(f"_o{i}") for i, c in enumerate(rest, 1)]]


def _place(row: Sequence, n: int) -> tuple:
    """The first ``n`` values, a missing one before all others."""
    return tuple((x is not None, x or 0) for x in row[:n])


def _after(row: Sequence, last: tuple | None, n: int) -> bool:
    return last is None or _place(row, n) > _place(last, n)


def _sorted(rows: Iterator[Row], n: int, columns: Sequence[str]) -> Iterator[tuple]:
    """Order columns and ``columns`` of the rows, in order. Rows that go beyond the memory limit of the worker wait on disk."""
    names = [*(f"_o{i}" for i in range(n)), *columns]
    return iter(ExternalSorter(SORT_MB).sorted((tuple([row[c] for c in names]) for row in rows), key=lambda r: _place(r, n)))


class Deltas(StatefulProcessor):
    """Differences of counters to the row before, 0 in the first row; a missing counter counts as 0. The state is the last
    row's place and counters."""

    def __init__(self, n_order: int, counters: Sequence[str], columns: Sequence[str], ttl_s: float | None):
        self.n, self.counters, self.columns, self.ttl_s = n_order, list(counters), list(columns), ttl_s
        self.names = [*self.columns, *(f"{c}_delta" for c in counters)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = ", ".join([f"o{i} long" for i in range(self.n)] + [f"c{i} long" for i in range(len(self.counters))])
        self.last = handle.getValueState("last", kind, int(self.ttl_s * 1000) if self.ttl_s else None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        place = tuple(held[: self.n]) if held is not None else None
        before = list(held[self.n :]) if held is not None else None
        counted = [self.n + self.columns.index(c) for c in self.counters]
        for row in _sorted(rows, self.n, self.columns):
            now = [row[c] for c in counted]
            if _after(row, place, self.n):
                found = [(x or 0) - (y or 0) for x, y in zip(now, before if before is not None else now, strict=True)]
                place, before = row[: self.n], now
            else:
                found = [None] * len(now)
            yield Row(*self.names)(*row[self.n :], *found)
        if place is not None:
            self.last.update((*place, *before))

    def close(self) -> None:
        pass


class _Ending(StatefulProcessor):
    """A watch per key that ends once: by its rows, or by a timer ``limit`` microseconds after its first row."""

    state_kind = ""
    read = ""
    told: tuple[str, ...] = ()

    def __init__(self, keys: Sequence[str], n_order: int, limit: int, keep_s: float):
        self.n, self.limit, self.keep = n_order, limit, int(keep_s * 1000)
        self.names = [*keys, "_at", *self.told]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = ", ".join(["t0 long", "done boolean", *(f"o{i} long" for i in range(self.n))])
        self.state = handle.getValueState("watch", f"{kind}, {self.state_kind}")

    def timer(self, at_ms: int) -> None:
        """The key's only timer."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else None
        t0, done = held[:2] if held else (None, False)
        place = held[2 : 2 + self.n] if held else None
        own = held[2 + self.n :] if held else self.fresh()
        taken = False
        for row in _sorted(rows, self.n, [self.read]):
            if not _after(row, place, self.n):
                continue
            at, taken = row[0], True
            place = row[: self.n]
            t0 = at if t0 is None else t0
            if not done:
                own, found = self.step(own, row[self.n], at, t0)
                if found is not None:
                    done = True
                    yield Row(*self.names)(*key, *found)
        if taken:
            self.state.update((t0, done, *place, *own))
            if done:
                self.timer(place[0] // 1000 + self.keep)
            elif held is None:
                self.timer(-(-(t0 + self.limit) // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.state.exists():
            return
        held = tuple(self.state.get())
        if held[1]:
            self.state.clear()
            return
        yield Row(*self.names)(*key, *self.over(held[2 + self.n :], held[0] + self.limit))
        self.state.update((held[0], True, *held[2:]))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep)

    def fresh(self) -> tuple:
        raise NotImplementedError

    def step(self, own: tuple, value: Any, at: int, t0: int) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def over(self, own: tuple, deadline: int) -> tuple:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Watchdog(_Ending):
    """Ends at the ``red``-th hard failure or the ``busy``-th timeout in a row, or at the limit."""

    state_kind = "kind string, run long"
    read = "_kind"
    told = ("reason",)

    def __init__(self, keys: Sequence[str], n_order: int, limit: int, keep_s: float, red: int, busy: int):
        super().__init__(keys, n_order, limit, keep_s)
        self.most = {"red": red, "busy": busy}

    def fresh(self) -> tuple:
        return None, 0

    def step(self, own, value, at, t0):
        kind, run = own
        kind, run = value, run + 1 if value == kind else 1
        if at - t0 >= self.limit:
            return (kind, run), (at, "limit")
        return (kind, run), (at, kind) if kind in self.most and run >= self.most[kind] else None

    def over(self, own, deadline):
        return deadline, "limit"


class Stability(_Ending):
    """Ends at a count of ``expected``, at one that has come ``stable_for`` times again, or at the deadline."""

    state_kind = "count long, run long"
    read = "_count"
    told = ("count", "outcome")

    def __init__(self, keys: Sequence[str], n_order: int, limit: int, keep_s: float, expected: int, stable_for: int):
        super().__init__(keys, n_order, limit, keep_s)
        self.expected, self.stable_for = expected, stable_for

    def fresh(self) -> tuple:
        return None, 0

    def step(self, own, value, at, t0):
        count, run = own
        if at >= t0 + self.limit:
            return own, self.over(own, t0 + self.limit)
        if value is None:
            return own, None
        count, run = value, run + 1 if value == count else 1
        if count >= self.expected:
            return (count, run), (at, count, "reached")
        return (count, run), (at, count, "stable") if run > self.stable_for else None

    def over(self, own, deadline):
        return deadline, own[0], "timed out"


def deltas(samples: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str], ttl_s: float | None) -> DataFrame:
    """ST3: the rows with ``<counter>_delta``, null in late rows. Counters are whole numbers; a key that has had no row for
    ``ttl_s`` seconds of processing time is forgotten."""
    columns = samples.columns
    rows = samples.filter(F.col(order[0]).isNotNull()).select(*columns, *places(order))
    kind = T.StructType([*samples.schema, *(T.StructField(f"{c}_delta", T.LongType()) for c in counters)])
    worker = Deltas(len(order), counters, columns, ttl_s)
    return rows.groupBy(*keys).transformWithState(worker, kind, "Append", "ProcessingTime" if ttl_s else "None")


def endings(polls: DataFrame, keys: Sequence[str], order: Sequence[str], extra: Column, worker: _Ending, outcome: str, delay: str) -> DataFrame:
    """One row per key that ends: the keys, ``ts`` and ``outcome`` columns. Event time is ``order[0]``."""
    at = F.col(order[0]).cast("timestamp").alias("_ts")
    rows = polls.filter(F.col(order[0]).isNotNull()).select(*keys, at, *places(order), extra).withWatermark("_ts", delay)
    kind = ", ".join([*(f"`{k}` {polls.schema[k].dataType.simpleString()}" for k in keys), "_at long", outcome])
    found = rows.groupBy(*keys).transformWithState(worker, kind, "Append", "EventTime")
    return found.select(*keys, F.timestamp_micros("_at").alias("ts"), *[c for c in found.columns if c not in (*keys, "_at")])
