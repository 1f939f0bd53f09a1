"""Streaks and stalls in polled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.operators.timeline import Timeline

# Repeats that count as stable and its deadline, the tolerances of the health watchdog and its hard
# limit, the two stall limits, the active count taken before the first poll, and the failed states.
STABLE_FOR = 3
STABLE_DEADLINE_S = 300
RED_LIMIT = 5
BUSY_LIMIT = 60
HARD_LIMIT_S = 28800
RISE_LIMIT_S = 600
FALL_LIMIT_S = 7200
INITIAL_ACTIVE = 9999
FAILED_STATES = ("failed", "error")


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def first_stable(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], expected: int | Column, count: str = "count",
    stable_for: int = STABLE_FOR, deadline_s: float | None = None, slices: int | None = None,
) -> DataFrame:
    """Per key the first poll that reaches ``expected`` or repeats the same count ``stable_for`` times.

    Unknown (null) polls are skipped and any change starts the repeats again. A key that never stops keeps its last
    count with outcome ``open``; with ``deadline_s`` polls after the deadline are not looked at. ``order[0]`` is the
    poll time.
    """
    expected = F.lit(expected) if not isinstance(expected, Column) else expected
    if deadline_s is not None:
        begins = polls.groupBy(*keys).agg(F.min(_micros(order[0])).alias("_t0"))
        polls = polls.join(begins, list(keys)).filter(_micros(order[0]) < F.col("_t0") + int(deadline_s * 1e6)).drop("_t0")
    seen = polls.filter(F.col(count).isNotNull()).withColumn("_want", expected)
    runs = Timeline(seen, keys, order, slices).run_positions(count, "_pos").result()
    reached = F.col(count) >= F.col("_want")
    stable = F.col("_pos") > stable_for
    stop = F.struct(*order, F.col(count).alias("count"), F.when(reached, F.lit("reached")).otherwise(F.lit("stable")).alias("outcome"))
    at = F.struct(*order)
    found = runs.groupBy(*keys).agg(
        F.min_by(F.when(reached | stable, stop), F.when(reached | stable, at)).alias("_stop"),
        F.max_by(F.struct(*order, F.col(count).alias("count")), at).alias("_last"),
    )
    return found.select(
        *keys,
        *[F.coalesce(F.col("_stop")[c], F.col("_last")[c]).alias(c) for c in order],
        F.coalesce(F.col("_stop")["count"], F.col("_last")["count"]).alias("count"),
        F.coalesce(F.col("_stop")["outcome"], F.lit("open")).alias("outcome"),
    )


def poll_kind(state: Column) -> Column:
    """Ready, busy (timed out) or red (any hard failure)."""
    return F.when(state == "ready", "ready").when(state == "timeout", "busy").otherwise("red")


def health_streaks(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], state: str = "state", red: int = RED_LIMIT,
    busy: int = BUSY_LIMIT, slices: int | None = None, initial: DataFrame | None = None,
) -> DataFrame:
    """Consecutive failures per poll. ``state`` is ``ready``, ``timeout`` or anything else for a hard failure.

    Ready resets both counters, a timeout resets the hard failures and the reverse. ``kill`` marks polls at which a
    counter is at its limit. ``initial`` is the open run per key from earlier polls (keys, ``kind``, ``run``).
    """
    line = Timeline(polls.withColumn("kind", poll_kind(F.col(state))), keys, order, slices)
    runs = line.run_positions("kind", "run", initial).result()
    count = lambda k: F.when(F.col("kind") == k, F.col("run")).otherwise(F.lit(0).cast("bigint"))
    return (
        runs.withColumn("red_streak", count("red"))
        .withColumn("busy_streak", count("busy"))
        .withColumn("kill", (F.col("red_streak") >= red) | (F.col("busy_streak") >= busy))
        .drop("kind", "run")
    )


def first_kill(streaks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The poll at which the watchdog of W9 acts: the first ``kill`` per key, with its reason."""
    reason = F.when(F.col("busy_streak") > 0, F.lit("busy")).otherwise(F.lit("red"))
    hit = F.struct(*order, "red_streak", "busy_streak", reason.alias("reason"))
    found = streaks.filter("kill").groupBy(*keys).agg(F.min_by(hit, F.struct(*order)).alias("_h"))
    return found.select(*keys, *[F.col("_h")[c].alias(c) for c in (*order, "red_streak", "busy_streak", "reason")])


def _first_stall(polls, keys, order, value, limit_s, mode, slices) -> DataFrame:
    line = Timeline(polls.withColumn("_at", _micros(order[0])), keys, order, slices)
    if mode == "rise":
        line = line.running({"_high": ("max", F.col(value))}, inclusive=False)
        progress = F.col(value) > F.greatest(F.coalesce(F.col("_high"), F.lit(0)), F.lit(0))
    else:
        line = line.previous({"_pv": value})
        progress = F.col(value) < F.coalesce(F.col("_pv"), F.lit(INITIAL_ACTIVE))
    line = line.running({"_moved": ("max", F.when(progress, F.col("_at"))), "_t0": ("min", F.col("_at"))})
    waited = F.col("_at") - F.coalesce("_moved", "_t0")
    hits = line.result().filter(waited >= int(limit_s * 1e6))
    stop = F.struct(*order, F.col(value).alias("value"))
    return hits.groupBy(*keys).agg(F.min_by(stop, F.struct(*order)).alias("_s"))


def stalled(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, limit_s: float | None = None,
    mode: str = "rise", slices: int | None = None, goal: Column | None = None,
) -> DataFrame:
    """The poll at which a key has made no progress for ``limit_s``; ``order[0]`` is the poll time.

    ``rise``: progress is a new maximum. ``fall``: progress is a value below the previous poll; the first stall is
    answered by one retry that starts clock and comparison anew, and ``gave_up`` tells whether it stalled again.
    Keys that never stall are absent. ``goal`` is true of a poll that meets the goal: watching ends there, so that
    poll and later ones do not count.
    """
    if mode not in ("rise", "fall"):
        raise ValueError("mode is rise or fall")
    limit_s = limit_s if limit_s is not None else (RISE_LIMIT_S if mode == "rise" else FALL_LIMIT_S)
    flat = lambda d: d.select(*keys, *[F.col("_s")[c].alias(c) for c in (*order, "value")])
    if goal is not None:
        met = F.when(F.coalesce(goal, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        line = Timeline(polls, keys, order, slices).running({"_met": ("max", met)})
        polls = line.result().filter("_met = 0").drop("_met")
    first = _first_stall(polls, keys, order, value, limit_s, mode, slices)
    if mode == "rise":
        return flat(first).withColumn("gave_up", F.lit(True))
    retried = first.select(*keys, F.struct(*[F.col("_s")[c].alias(c) for c in order]).alias("_after"))
    later = polls.join(retried, list(keys)).filter(F.struct(*order) > F.col("_after")).drop("_after")
    again = _first_stall(later, keys, order, value, limit_s, mode, slices).withColumnRenamed("_s", "_s2")
    both = first.join(again, list(keys), "left")
    return both.select(
        *keys,
        *[F.coalesce(F.col("_s2")[c], F.col("_s")[c]).alias(c) for c in (*order, "value")],
        F.col("_s2").isNotNull().alias("gave_up"),
    )


def newly_failed(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], status: str = "status", slices: int | None = None,
) -> DataFrame:
    """Status events that turn a step into a failed state it did not already show."""
    line = Timeline(events, keys, order, slices).previous({"_ps": status}).result()
    turned = F.col(status).isin(*FAILED_STATES) & ~F.col(status).eqNullSafe(F.col("_ps"))
    return line.filter(turned).withColumnRenamed("_ps", "previous_status")
