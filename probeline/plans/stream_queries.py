"""Streams replayed from the events table in three time-ordered parts, each as its own restart from the checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.operators.timeline import slice_bounds
from probeline.plans import telemetry_queries, views
from probeline.plans.registry import query, table
from probeline.plans.views import with_views
from probeline.session import scratch_path
from probeline.sources.trees import read_monthly
from probeline.streaming import streams

KEEP = 1e8  # the tables hold users that are silent for long and are not to be watched anew


def _replay(spark, rows, run, parts: int = 3, fmt: str = "parquet"):
    """Write the rows part by part in time order and run the stream over each; ``run(stream, checkpoint)`` starts it."""
    source, checkpoint = scratch_path(spark, "feed"), scratch_path(spark, "checkpoint")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    cuts = [float("-inf"), *slice_bounds(rows, "ts", parts), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        here = (at >= low) & (at < high)
        if low == cuts[0]:
            here = here | at.isNull()  # rows without a time come first
        rows.filter(here).write.mode("append").format(fmt).save(source)
        stream = spark.readStream.schema(rows.schema).format(fmt).load(source)
        run(stream, checkpoint).awaitTermination()


@query(
    "stream_counter_delta",
    with_views("node_counters", body="""
        SELECT event_id, node, gc_young_ms - coalesce(lag(gc_young_ms) OVER w, gc_young_ms) AS gc_young_ms_delta
        FROM node_counters WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)"""),
)
def stream_counter_delta(spark, sf):
    """ST3."""
    folder = scratch_path(spark, "deltas")
    rows = views.node_counters(spark, sf).select("event_id", "ts", "node", "gc_young_ms")
    _replay(spark, rows, lambda s, c: streams.stream_counter_delta(s, ["node"], ["ts", "event_id"], ["gc_young_ms"], folder, c))
    return streams.read_output(spark, folder).select("event_id", "node", "gc_young_ms_delta")


@query(
    "stream_watchdog",
    with_views("polls", body=f"""
        WITH {telemetry_queries._RUNS_SQL.format(value='state', source='polls')},
        hits AS (SELECT node, ts, event_id, state FROM runs
                 WHERE (state = 'down' AND pos >= 5) OR (state = 'timeout' AND pos >= 3))
        SELECT node, epoch_us(min(ts)) AS at_us, CASE arg_min(state, (ts, event_id)) WHEN 'down' THEN 'red' ELSE 'busy' END AS reason
        FROM hits GROUP BY node"""),
)
def stream_watchdog(spark, sf):
    """ST4 with a hard limit beyond the data, so that the streaks decide."""
    folder = scratch_path(spark, "watchdog")
    rows = views.polls(spark, sf).select("event_id", "ts", "node", "state")
    _replay(spark, rows, lambda s, c: streams.stream_watchdog(s, ["node"], ["ts", "event_id"], folder, c, busy=3, limit_s=1e8, keep_s=KEEP))
    found = streams.read_output(spark, folder)
    return found.select("node", F.unix_micros("ts").alias("at_us"), "reason")


@query(
    "stream_watchdog_limit",
    """WITH b AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id),
       h AS (SELECT e.user_id FROM events e JOIN b ON b.user_id = e.user_id
             WHERE epoch_us(e.ts) - epoch_us(t0) >= 28800000000)
       SELECT user_id, 'limit' AS reason FROM b WHERE (SELECT epoch_us(max(ts)) FROM events) - epoch_us(t0) >= 28800000000""",
)
def stream_watchdog_limit(spark, sf):
    """ST4: every poll is ready, so only the eight hours can end a user; silent users end as well."""
    folder = scratch_path(spark, "watchdog")
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id").withColumn("state", F.lit("ready"))
    _replay(spark, rows, lambda s, c: streams.stream_watchdog(s, ["user_id"], ["ts", "event_id"], folder, c, keep_s=KEEP))
    return streams.read_output(spark, folder).select("user_id", "reason")


@query(
    "stream_stability",
    with_views("count_polls", body=f"""
        WITH known AS (SELECT * FROM count_polls WHERE count IS NOT NULL),
        {telemetry_queries._RUNS_SQL.format(value='count', source='known')},
        hits AS (SELECT * FROM runs WHERE count >= 4 OR pos >= 4)
        SELECT node, epoch_us(min(ts)) AS at_us, arg_min(count, (ts, event_id)) AS count,
               CASE WHEN arg_min(count, (ts, event_id)) >= 4 THEN 'reached' ELSE 'stable' END AS outcome
        FROM hits GROUP BY node"""),
)
def stream_stability(spark, sf):
    """ST5 with a deadline beyond the data."""
    folder = scratch_path(spark, "stability")
    rows = views.count_polls(spark, sf)
    _replay(spark, rows, lambda s, c: streams.stream_stability(s, ["node"], ["ts", "event_id"], 4, folder, c, deadline_s=1e8, keep_s=KEEP))
    found = streams.read_output(spark, folder)
    return found.select("node", F.unix_micros("ts").alias("at_us"), "count", "outcome")


@query(
    "stream_stability_deadline",
    """WITH b AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id),
       l AS (SELECT e.user_id, arg_max(e.event_id, (e.ts, e.event_id)) AS count FROM events e JOIN b ON b.user_id = e.user_id
             WHERE epoch_us(e.ts) < epoch_us(t0) + 86400000000 GROUP BY e.user_id)
       SELECT b.user_id, l.count, 'timed out' AS outcome FROM b JOIN l ON l.user_id = b.user_id
       WHERE (SELECT epoch_us(max(ts)) FROM events) >= epoch_us(t0) + 86400000000""",
)
def stream_stability_deadline(spark, sf):
    """ST5: counts that never repeat; after a day the last one is taken."""
    folder = scratch_path(spark, "stability")
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_id").alias("count"))
    run = lambda s, c: streams.stream_stability(s, ["user_id"], ["ts", "event_id"], 10**12, folder, c, deadline_s=86400, keep_s=KEEP)
    _replay(spark, rows, run)
    return streams.read_output(spark, folder).select("user_id", "count", "outcome")


@query(
    "stream_windowed_usage",
    with_views("cores_mib", body="""
        WITH w AS (SELECT node, time_bucket(INTERVAL 600 SECOND, ts) AS start, cores, mib FROM cores_mib)
        SELECT node, epoch_us(start) AS start_us, round(sum(cores), 6) AS cpu_total, round(max(cores), 6) AS cpu_max,
               round(min(cores), 6) AS cpu_min, round(sum(mib), 2) AS memory_total, round(max(mib), 4) AS memory_max,
               round(min(mib), 4) AS memory_min, count(*) AS samples
        FROM w GROUP BY node, start
        HAVING epoch_us(start) + 600000000 <= (SELECT epoch_us(max(ts)) - 60000000 FROM events)"""),
)
def stream_windowed_usage(spark, sf):
    """ST2 in ten-minute windows; the closed ones."""
    sink = scratch_path(spark, "windows")
    rows = views.usage_text(spark, sf).select("ts", "node", "cpu", "memory")

    def run(stream, checkpoint):
        windows = streams.windowed_usage(stream, "10 minutes", "1 minute")
        return streams.start(windows.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)

    _replay(spark, rows, run)
    found = spark.read.parquet(sink)
    return found.select(
        "node", F.unix_micros("start").alias("start_us"), F.round(F.col("cpu_avg") * F.col("samples"), 6).alias("cpu_total"),
        F.round("cpu_max", 6).alias("cpu_max"), F.round("cpu_min", 6).alias("cpu_min"),
        F.round(F.col("memory_avg") * F.col("samples"), 2).alias("memory_total"), F.round("memory_max", 4).alias("memory_max"),
        F.round("memory_min", 4).alias("memory_min"), "samples",
    )


@query(
    "stream_newly_terminal",
    """SELECT DISTINCT user_id AS run_id, event_type AS step FROM events WHERE event_type IN ('error', 'view')""",
)
def stream_newly_terminal(spark, sf):
    """ST6: one row per step, however often its end is reported."""
    sink = scratch_path(spark, "terminal")
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "view", "completed").otherwise("running")
    rows = table(spark, sf, "events").select("ts", F.col("user_id").alias("run_id"), kind.alias("step"), status.alias("status"))

    def run(stream, checkpoint):
        ended = streams.stream_newly_terminal(stream)
        return streams.start(ended.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)

    _replay(spark, rows, run)
    return spark.read.parquet(sink).select("run_id", "step")


@query(
    "stream_ledger",
    """SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, epoch_us(max(ts)) AS heartbeat_us
       FROM events GROUP BY user_id""",
)
def stream_ledger(spark, sf):
    """ST7."""
    folder = scratch_path(spark, "ledger")
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    _replay(spark, rows, lambda s, c: streams.stream_ledger(s, ["user_id"], "event_id", folder, c))
    found = streams.read_ledger(spark, folder, ["user_id"], "event_id", "ts")
    return found.select("user_id", "event_id", "value", F.unix_micros(F.col("last_heartbeat_at").cast("timestamp")).alias("heartbeat_us"))


@query(
    "stream_samples",
    """SELECT strftime(ts, '%Y.%m') AS month, 'id-' || user_id AS node_id, count(*) AS samples,
              max(event_id) AS gc_young_count FROM events GROUP BY ALL""",
)
def stream_samples(spark, sf):
    """ST1: nested documents into the monthly sink."""
    sink = scratch_path(spark, "monthly")
    rows = telemetry_queries._stats_documents(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "nodes")
    _replay(spark, rows, lambda s, c: streams.stream_samples(s, sink, c))
    return read_monthly(spark, sink, "telemetry").groupBy("month", "node_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("gc_young_count").alias("gc_young_count")
    )
