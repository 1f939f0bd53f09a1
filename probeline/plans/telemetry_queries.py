"""Samples, deltas, usage, pools, polls."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions import units
from probeline.operators import streaks, telemetry
from probeline.plans import views
from probeline.plans.registry import query, table
from probeline.plans.views import POOLS_SQL, with_views
from probeline.session import scratch_path
from probeline.sources.trees import metrics_documents, read_monthly, write_monthly
from probeline.sources.trees import read_cat as parse_cat


def _micros(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query(
    "quantity_units",
    with_views("cores_mib", body="""
        SELECT event_id, round(cores, 9) AS cores, millicores, round(mib, 6) AS mib, kib FROM cores_mib"""),
)
def quantity_units(spark, sf):
    """P3–P6."""
    return views.usage_text(spark, sf).select(
        "event_id",
        F.round(units.cpu_cores("cpu"), 9).alias("cores"),
        units.cpu_millicores("cpu").alias("millicores"),
        F.round(units.mem_mib("memory"), 6).alias("mib"),
        units.mem_kib("memory").alias("kib"),
    )


@query(
    "ready_polls",
    """SELECT event_id, event_type IN ('view', 'click') AS ready FROM events""",
)
def ready_polls(spark, sf):
    """P14 on status texts."""
    status = F.when(F.col("event_type") == "view", "green").when(F.col("event_type") == "click", "yellow").otherwise("red")
    return table(spark, sf, "events").select("event_id", units.is_ready(status).alias("ready"))


@query(
    "node_usage_summary",
    with_views("cores_mib", body="""
        SELECT node, round(avg(cores), 6) AS cpu_avg, round(max(cores), 6) AS cpu_max, round(min(cores), 6) AS cpu_min,
               round(avg(mib), 4) AS memory_avg, round(max(mib), 4) AS memory_max, round(min(mib), 4) AS memory_min
        FROM cores_mib GROUP BY node"""),
)
def node_usage_summary(spark, sf):
    """A1."""
    return _rounded(telemetry.node_usage_summary(views.usage_text(spark, sf)))


def _rounded(df):
    for c in df.columns:
        if c.startswith("cpu_"):
            df = df.withColumn(c, F.round(c, 6))
        if c.startswith("memory_"):
            df = df.withColumn(c, F.round(c, 4))
    return df


@query(
    "usage_with_pool",
    with_views("cores_mib", body=f"""
        WITH usage AS (
            SELECT node, avg(cores) AS cpu_avg, max(cores) AS cpu_max, min(cores) AS cpu_min, avg(mib) AS memory_avg,
                   max(mib) AS memory_max, min(mib) AS memory_min FROM cores_mib GROUP BY node)
        SELECT coalesce(u.node, p.node) AS node, coalesce(node_pool, 'unknown') AS node_pool,
               round(coalesce(cpu_avg, 0), 6) AS cpu_avg, round(coalesce(cpu_max, 0), 6) AS cpu_max,
               round(coalesce(cpu_min, 0), 6) AS cpu_min, round(coalesce(memory_avg, 0), 4) AS memory_avg,
               round(coalesce(memory_max, 0), 4) AS memory_max, round(coalesce(memory_min, 0), 4) AS memory_min
        FROM usage u FULL JOIN (SELECT * FROM {POOLS_SQL}) p ON p.node = u.node"""),
)
def usage_with_pool(spark, sf):
    """A node without a pool and a pool node without usage both stay."""
    usage = telemetry.node_usage_summary(views.usage_text(spark, sf))
    return _rounded(telemetry.usage_with_pool(usage, views.node_pools(spark)))


@query(
    "usage_per_pool",
    with_views("cores_mib", body=f"""
        WITH usage AS (SELECT node, avg(cores) AS cpu_avg, avg(mib) AS memory_avg FROM cores_mib GROUP BY node)
        SELECT coalesce(node_pool, 'unknown') AS node_pool, count(*) AS nodes,
               round(sum(coalesce(cpu_avg, 0)), 5) AS cpu, round(sum(coalesce(memory_avg, 0)), 3) AS memory
        FROM usage u FULL JOIN (SELECT * FROM {POOLS_SQL}) p ON p.node = u.node GROUP BY ALL"""),
)
def usage_per_pool(spark, sf):
    """A12."""
    usage = telemetry.node_usage_summary(views.usage_text(spark, sf))
    pooled = telemetry.usage_per_pool(telemetry.usage_with_pool(usage, views.node_pools(spark)))
    return pooled.withColumn("cpu", F.round("cpu", 5)).withColumn("memory", F.round("memory", 3))


def _containers(spark, sf):
    """Containers: a pod is a user, a tick is an hour."""
    return views.usage_text(spark, sf).select(
        F.concat(F.lit("pod-"), "user_id").alias("pod"), F.date_trunc("hour", F.col("ts")).alias("ts"), "cpu", "memory"
    )


_PODS_SQL = """
    usage AS (SELECT 'pod-' || user_id AS pod, date_trunc('hour', ts) AS ts, CAST(sum(millicores) AS BIGINT) || 'm' AS cpu_sample,
                     CAST(trunc(CAST(sum(kib) AS DOUBLE) / 1024.0) AS BIGINT) || 'Mi' AS memory_sample
              FROM cores_mib GROUP BY ALL)"""


@query(
    "pod_usage",
    with_views("cores_mib", body=f"WITH {_PODS_SQL} SELECT pod, epoch_us(ts) AS at_us, cpu_sample, memory_sample FROM usage"),
)
def pod_usage(spark, sf):
    """A2."""
    usage = telemetry.pod_usage(_containers(spark, sf))
    return usage.select("pod", _micros("ts").alias("at_us"), "cpu_sample", "memory_sample")


@query(
    "pod_series",
    with_views("cores_mib", body=f"""
        WITH {_PODS_SQL},
        numbered AS (SELECT *, (row_number() OVER (PARTITION BY pod ORDER BY ts) - 1) // 20 AS chunk FROM usage)
        SELECT pod, chunk, string_agg(cpu_sample, ',' ORDER BY ts) AS cpu_samples,
               string_agg(memory_sample, ',' ORDER BY ts) AS memory_samples
        FROM numbered GROUP BY pod, chunk"""),
)
def pod_series(spark, sf):
    """A3 in chunks of twenty samples."""
    series = telemetry.pod_series(telemetry.pod_usage(_containers(spark, sf)), chunk_rows=20)
    return series.select(
        "pod", "chunk", F.array_join("cpu_samples", ",").alias("cpu_samples"),
        F.array_join("memory_samples", ",").alias("memory_samples"),
    )


@query(
    "counter_delta",
    with_views("node_counters", body="""
        SELECT event_id, node, gc_young_ms,
               gc_young_ms - coalesce(lag(gc_young_ms) OVER w, gc_young_ms) AS gc_young_ms_delta,
               gc_young_count - coalesce(lag(gc_young_count) OVER w, gc_young_count) AS gc_young_count_delta
        FROM node_counters WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)"""),
)
def counter_delta(spark, sf):
    """W1."""
    counters = views.node_counters(spark, sf)
    deltas = telemetry.counter_delta(counters, ["node"], ["ts", "event_id"], ["gc_young_ms", "gc_young_count"])
    return deltas.select("event_id", "node", "gc_young_ms", "gc_young_ms_delta", "gc_young_count_delta")


@query(
    "gauge_delta",
    """SELECT event_id, value, round(value - coalesce(lag(value) OVER w, value), 6) AS value_delta
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def gauge_delta(spark, sf):
    """W1 on a value that also falls: resets stay negative."""
    deltas = telemetry.counter_delta(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["value"])
    return deltas.select("event_id", "value", F.round("value_delta", 6).alias("value_delta"))


@query(
    "diff_snapshots",
    with_views("node_counters", body="""
        WITH before AS (SELECT user_id, min_by(gc_young_ms, event_id) AS b FROM node_counters WHERE user_id % 5 <> 0 GROUP BY user_id),
        after AS (SELECT user_id, max_by(gc_young_ms, event_id) AS a, max_by(round(value, 1), event_id) AS heap
                  FROM node_counters GROUP BY user_id)
        SELECT after.user_id, 'node-' || after.user_id AS node, coalesce(a - b, a) AS gc_young_ms_delta, heap AS heap_used_pct
        FROM after LEFT JOIN before ON before.user_id = after.user_id"""),
)
def diff_snapshots(spark, sf):
    """A user's first sample is the before, the last one the after; a fifth of the users has no before."""
    counters = views.node_counters(spark, sf)
    sample = lambda pick: counters.groupBy("user_id").agg(
        pick("gc_young_ms", "event_id").alias("gc_young_ms"), pick(F.round("value", 1), "event_id").alias("heap_used_pct"),
    )
    after = sample(F.max_by).withColumn("node", F.concat(F.lit("node-"), "user_id"))
    return telemetry.diff_snapshots(sample(F.min_by).filter("user_id % 5 <> 0"), after, ["user_id"], ["gc_young_ms"], ["heap_used_pct"], "node")


@query(
    "payload_header",
    with_views("node_samples", body="""
        SELECT event_type AS scenario, node AS namespace, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
               count(DISTINCT ts) AS total_samples, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS duration_seconds
        FROM node_samples GROUP BY ALL"""),
)
def payload_header(spark, sf):
    """A13."""
    samples = views.node_samples(spark, sf).select(F.col("event_type").alias("scenario"), F.col("node").alias("namespace"), "ts")
    head = telemetry.payload_header(samples)
    return head.select(
        "scenario", "namespace", _micros("start_time").alias("start_us"), _micros("end_time").alias("end_us"),
        "total_samples", F.round("duration_seconds", 3).alias("duration_seconds"),
    )


def _pods(spark, sf):
    samples = views.node_samples(spark, sf)
    return samples.select(
        F.col("event_id").alias("pod"), "node",
        F.when(F.col("event_type") == "signup", "kube-system").otherwise(F.concat(F.lit("ns-"), "event_type")).alias("namespace"),
        F.when(F.col("value") < 100, "Running").otherwise("Pending").alias("status"),
    )


_PLACED_SQL = f"""
    placed AS (SELECT event_id AS pod, s.node, 'ns-' || event_type AS namespace, coalesce(node_pool, 'unknown') AS node_pool
               FROM node_samples s LEFT JOIN (SELECT * FROM {POOLS_SQL}) p ON p.node = s.node WHERE event_type <> 'signup')"""


@query("pods_by_pool", with_views("node_samples", body=f"WITH {_PLACED_SQL} SELECT * FROM placed"))
def pods_by_pool(spark, sf):
    """J8."""
    return telemetry.pods_by_pool(_pods(spark, sf), views.node_pools(spark)).select("pod", "node", "namespace", "node_pool")


@query("pods_per_pool", with_views("node_samples", body=f"WITH {_PLACED_SQL} SELECT node_pool, count(*) AS pods FROM placed GROUP BY 1"))
def pods_per_pool(spark, sf):
    """A12."""
    return telemetry.pods_per_pool(telemetry.pods_by_pool(_pods(spark, sf), views.node_pools(spark)))


@query(
    "pods_per_namespace",
    """SELECT CASE WHEN event_type = 'signup' THEN 'kube-system' ELSE 'ns-' || event_type END AS namespace,
              count(*) FILTER (WHERE value < 100) AS running, count(*) AS total FROM events GROUP BY ALL""",
)
def pods_per_namespace(spark, sf):
    """A12."""
    return telemetry.pods_per_namespace(_pods(spark, sf))


@query(
    "samples_in_sweeps",
    with_views("node_samples", body="""
        WITH sweeps AS (SELECT o_orderkey AS run_id, 'node-' || (o_custkey % 3) AS node,
                               TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 37 % 43200 AS INTEGER)) AS started_at,
                               CASE WHEN o_orderkey % 1000 <> 7 THEN
                               TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 37 % 43200 + o_custkey % 90 AS INTEGER)) END AS completed_at
                        FROM orders)
        SELECT run_id, event_id, value FROM sweeps w JOIN node_samples s
          ON s.node = w.node AND s.ts >= w.started_at + INTERVAL 60 SECOND AND s.ts <= coalesce(w.completed_at, s.ts)"""),
)
def samples_in_sweeps(spark, sf):
    """J17 with a minute of warm-up; some sweeps have not ended yet."""
    o = table(spark, sf, "orders")
    begin = F.lit(1704067200)  # 2024-01-01 00:00 UTC
    minute = F.col("o_orderkey") * 37 % 43200
    sweeps = o.select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("node-"), F.col("o_custkey") % 3).alias("node"),
        F.timestamp_seconds(begin + minute * 60).alias("started_at"),
        F.when(F.col("o_orderkey") % 1000 != 7, F.timestamp_seconds(begin + (minute + F.col("o_custkey") % 90) * 60)).alias("completed_at"),
    )
    samples = views.node_samples(spark, sf).select("event_id", "ts", "node", "value")
    return telemetry.samples_in_sweeps(samples, sweeps, ["node"], warmup_s=60).select("run_id", "event_id", "value")


def _stats_documents(spark, sf):
    """Node statistics documents: one per event, with a nested counter block and some values missing."""
    e = table(spark, sf, "events")
    mem = F.struct(F.col("value").alias("heap_used_percent"), F.floor(F.col("value") * 1048576).cast("bigint").alias("heap_used_in_bytes"))
    young = F.struct(F.col("event_id").alias("collection_count"))
    node = F.struct(
        F.when(F.col("event_type") != "error", F.concat(F.lit("name-"), "user_id")).alias("name"),
        F.struct(mem.alias("mem"), F.struct(F.struct(young.alias("young")).alias("collectors")).alias("gc")).alias("jvm"),
        F.struct(F.struct(F.get_json_object("props", "$.k").cast("double").alias("percent")).alias("cpu")).alias("os"),
    )
    document = F.to_json(F.create_map(F.concat(F.lit("id-"), "user_id"), node))
    return e.select("event_id", "ts", document.alias("nodes"))


@query(
    "flatten_node_stats",
    """SELECT event_id, 'id-' || user_id AS node_id,
              CASE WHEN event_type = 'error' THEN 'id-' || user_id ELSE 'name-' || user_id END AS node,
              round(value, 6) AS heap_used_pct, CAST(round(floor(value * 1048576) / 1048576.0, 0) AS BIGINT) AS heap_used_mb,
              event_id AS gc_young_count, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cpu_pct, true AS no_old_gc
       FROM events""",
)
def flatten_node_stats(spark, sf):
    """P16."""
    flat = telemetry.flatten_node_stats(_stats_documents(spark, sf))
    return flat.select(
        "event_id", "node_id", "node", F.round("heap_used_pct", 6).alias("heap_used_pct"), "heap_used_mb",
        "gc_young_count", "cpu_pct", F.col("gc_old_count").isNull().alias("no_old_gc"),
    )


def _full_stats_documents(spark, sf):
    """Node statistics documents with every block filled from the event's own numbers; some names are missing."""
    e = table(spark, sf, "events")
    i, v = F.col("event_id"), F.col("value")
    pair = lambda a, b: F.struct((i * a).alias("collection_count"), (i * b).alias("collection_time_in_millis"))
    queue = lambda a, b: F.struct((i % a).alias("queue"), (i % b).alias("rejected"))
    node = F.struct(
        F.when(F.col("event_type") != "error", F.concat(F.lit("name-"), "user_id")).alias("name"),
        F.struct(
            F.struct(v.alias("heap_used_percent"), (i * 104857).alias("heap_used_in_bytes"), (i * 1048576).alias("heap_max_in_bytes")).alias("mem"),
            F.struct(F.struct(pair(2, 3).alias("young"), F.when(i % 4 != 0, pair(5, 7)).alias("old")).alias("collectors")).alias("gc"),
        ).alias("jvm"),
        F.struct(
            F.struct((i % 100).cast("double").alias("percent"), F.struct((i % 8).cast("double").alias("1m")).alias("load_average")).alias("cpu"),
            F.struct((i % 90).cast("double").alias("used_percent")).alias("mem"),
        ).alias("os"),
        F.struct(
            F.struct((i * 11).alias("query_total"), (i * 13).alias("query_time_in_millis"), (i * 17).alias("fetch_total")).alias("search"),
            F.struct((i * 19).alias("index_total"), (i * 23).alias("index_time_in_millis")).alias("indexing"),
        ).alias("indices"),
        F.struct(queue(3, 5).alias("search"), queue(7, 9).alias("write")).alias("thread_pool"),
        F.struct(F.struct((i * 1000).alias("total_in_bytes"), (i * 400).alias("free_in_bytes")).alias("total")).alias("fs"),
    )
    document = F.to_json(F.create_map(F.concat(F.lit("id-"), "user_id"), node))
    return e.select("event_id", "ts", document.alias("nodes"))


_FLAT_SQL = """
    flat AS (
        SELECT event_id, ts, 'id-' || user_id AS node_id, CASE WHEN event_type = 'error' THEN 'id-' ELSE 'name-' END || user_id AS node,
               value AS heap_used_pct, CAST(round(event_id * 104857 / 1048576.0, 0) AS BIGINT) AS heap_used_mb, event_id AS heap_max_mb,
               event_id * 2 AS gc_young_count, event_id * 3 AS gc_young_ms,
               CASE WHEN event_id % 4 <> 0 THEN event_id * 5 END AS gc_old_count, CASE WHEN event_id % 4 <> 0 THEN event_id * 7 END AS gc_old_ms,
               (event_id % 100)::DOUBLE AS cpu_pct, (event_id % 8)::DOUBLE AS load_1m, (event_id % 90)::DOUBLE AS mem_used_pct,
               event_id * 11 AS search_query_total, event_id * 13 AS search_query_ms, event_id * 19 AS indexing_total, event_id * 23 AS indexing_ms,
               event_id % 5 AS search_rejected, event_id % 9 AS write_rejected, event_id * 1000 AS fs_total_bytes, event_id * 400 AS fs_free_bytes,
               round_even(event_id * 104857 / 1048576.0, 1) AS heap_mb, event_id * 17 AS search_fetch_total,
               event_id % 3 AS search_queue, event_id % 7 AS write_queue
        FROM events)"""


@query("node_stats_full", f"""WITH {_FLAT_SQL} SELECT * EXCLUDE (ts) REPLACE (round(heap_used_pct, 6) AS heap_used_pct,
       coalesce(gc_old_count, -1) AS gc_old_count, coalesce(gc_old_ms, -1) AS gc_old_ms) FROM flat""")
def node_stats_full(spark, sf):
    """All columns."""
    flat = telemetry.flatten_node_stats(_full_stats_documents(spark, sf), whole=True)
    return flat.na.fill(-1, ["gc_old_count", "gc_old_ms"]).withColumn("heap_used_pct", F.round("heap_used_pct", 6)).drop("ts")


_DIFF_SQL = ", ".join(
    [f"coalesce(a.{c} - b.{c}, a.{c}, -1) AS {n}" for n, c in telemetry.DIFF_COUNTERS.items()]
    + [f"round(a.{c}, 6) AS {n}" if c == "heap_used_pct" else f"a.{c} AS {n}" for n, c in telemetry.DIFF_GAUGES.items()]
)


@query(
    "diff_node_stats",
    f"""WITH {_FLAT_SQL},
        ends AS (SELECT node_id, min(event_id) AS low, max(event_id) AS high FROM flat GROUP BY node_id),
        b AS (SELECT flat.* FROM flat JOIN ends ON event_id = low WHERE low % 3 <> 0),
        a AS (SELECT flat.* FROM flat JOIN ends ON event_id = high)
        SELECT a.node_id, a.node, {_DIFF_SQL} FROM a LEFT JOIN b ON a.node_id = b.node_id""",
)
def diff_node_stats(spark, sf):
    """All 18 fields between a node's first and last sample; a third of the nodes has no first one."""
    flat = telemetry.flatten_node_stats(_full_stats_documents(spark, sf), whole=True)
    ends = flat.groupBy("node_id").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
    both = flat.join(ends, "node_id")
    found = telemetry.diff_node_stats(both.filter("event_id = low AND low % 3 <> 0"), both.filter("event_id = high"))
    return found.na.fill(-1, list(telemetry.DIFF_COUNTERS)).withColumn("heap_used_percent", F.round("heap_used_percent", 6))


@query(
    "gc_samples",
    f"""WITH {_FLAT_SQL}, known AS (
            SELECT event_id, node_id, heap_used_pct, heap_mb, gc_young_count, gc_young_ms,
                   coalesce(gc_old_count, 0) AS old_count, coalesce(gc_old_ms, 0) AS old_ms FROM flat)
        SELECT event_id AS sample, node_id AS node, round(heap_used_pct, 6) AS heap_used_pct, heap_mb AS heap_used_mb,
               coalesce(gc_young_count - lag(gc_young_count) OVER w, 0) AS young_count_delta,
               coalesce(gc_young_ms - lag(gc_young_ms) OVER w, 0) AS young_ms_delta,
               coalesce(old_count - lag(old_count) OVER w, 0) AS old_count_delta, coalesce(old_ms - lag(old_ms) OVER w, 0) AS old_ms_delta
        FROM known WINDOW w AS (PARTITION BY node_id ORDER BY event_id)""",
)
def gc_samples(spark, sf):
    """The collector sample of every document, in order of its number."""
    flat = telemetry.flatten_node_stats(_full_stats_documents(spark, sf), whole=True).withColumn("sample", F.col("event_id"))
    found = telemetry.gc_samples(flat, "sample", "node_id").withColumnRenamed("node_id", "node")
    return found.withColumn("heap_used_pct", F.round("heap_used_pct", 6))


@query(
    "index_overview",
    """SELECT p_partkey AS part, p_partkey * 10 AS docs, CAST(p_size AS BIGINT) * 1000 AS store_bytes,
              CAST(1 + p_partkey % 4 AS INTEGER) AS shards, p_partkey % 2 = 0 AS knn,
              CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'vector:' || (p_size * 16) END AS vector_fields
       FROM part""",
)
def index_overview(spark, sf):
    """P17 on documents derived from parts; a third of them has no vector field."""
    p = table(spark, sf, "part")
    key, name = F.col("p_partkey"), F.concat(F.lit("index-"), "p_partkey")
    total = F.struct(
        F.struct((key * 10).alias("count")).alias("docs"),
        F.struct((F.col("p_size").cast("bigint") * 1000).alias("size_in_bytes")).alias("store"),
    )
    stats = F.to_json(F.struct(F.create_map(name, F.struct(total.alias("total"))).alias("indices")))
    index = F.struct((1 + key % 4).cast("string").alias("number_of_shards"), (key % 2 == 0).cast("string").alias("knn"))
    settings = F.to_json(F.create_map(name, F.struct(F.struct(index.alias("index")).alias("settings"))))
    kind = F.when(key % 3 == 0, "keyword").otherwise("knn_vector")
    field = F.struct(kind.alias("type"), (F.col("p_size") * 16).alias("dimension"))
    mapping = F.to_json(
        F.create_map(name, F.struct(F.struct(F.create_map(F.lit("vector"), field).alias("properties")).alias("mappings")))
    )
    shots = p.select(key.alias("part"), stats.alias("stats"), settings.alias("settings"), mapping.alias("mapping"))
    fields = F.transform("vector_fields", lambda f: F.concat_ws(":", f["field"], f["dimension"].cast("string")))
    return telemetry.index_overview(shots, ["part"]).select(
        "part", "docs", "store_bytes", "shards", "knn", F.array_join(fields, ",").alias("vector_fields")
    )


_RUNS_SQL = """
    changes AS (SELECT *, lag({value}) OVER w IS DISTINCT FROM {value} OR row_number() OVER w = 1 AS changed
                FROM {source} WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)),
    islands AS (SELECT *, sum(changed::INT) OVER (PARTITION BY node ORDER BY ts, event_id) AS island FROM changes),
    runs AS (SELECT *, row_number() OVER (PARTITION BY node, island ORDER BY ts, event_id) AS pos FROM islands)"""


@query(
    "health_streaks",
    with_views("polls", body=f"""
        WITH {_RUNS_SQL.format(value='state', source='polls')},
        counted AS (SELECT event_id, node, CASE WHEN state = 'down' THEN pos ELSE 0 END AS red_streak,
                           CASE WHEN state = 'timeout' THEN pos ELSE 0 END AS busy_streak FROM runs)
        SELECT *, red_streak >= 5 OR busy_streak >= 3 AS kill FROM counted"""),
)
def health_streaks(spark, sf):
    """W9 per poll, busy limit 3."""
    found = streaks.health_streaks(views.polls(spark, sf), ["node"], ["ts", "event_id"], busy=3)
    return found.select("event_id", "node", "red_streak", "busy_streak", "kill")


@query(
    "first_kill",
    with_views("polls", body=f"""
        WITH {_RUNS_SQL.format(value='state', source='polls')},
        hits AS (SELECT node, ts, event_id, state, pos FROM runs
                 WHERE (state = 'down' AND pos >= 5) OR (state = 'timeout' AND pos >= 3))
        SELECT node, arg_min(event_id, (ts, event_id)) AS event_id,
               CASE arg_min(state, (ts, event_id)) WHEN 'down' THEN 'red' ELSE 'busy' END AS reason
        FROM hits GROUP BY node"""),
)
def first_kill(spark, sf):
    """Where the watchdog acts."""
    found = streaks.health_streaks(views.polls(spark, sf), ["node"], ["ts", "event_id"], busy=3)
    return streaks.first_kill(found, ["node"], ["ts", "event_id"]).select("node", "event_id", "reason")


@query(
    "first_stable",
    with_views("count_polls", body=f"""
        WITH known AS (SELECT * FROM count_polls WHERE count IS NOT NULL),
        {_RUNS_SQL.format(value='count', source='known')},
        hits AS (SELECT * FROM runs WHERE count >= 4 OR pos >= 4)
        SELECT node, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(count, (ts, event_id)) AS count,
               CASE WHEN arg_min(count, (ts, event_id)) >= 4 THEN 'reached' ELSE 'stable' END AS outcome
        FROM hits GROUP BY node"""),
)
def first_stable(spark, sf):
    """W8, expecting 4."""
    found = streaks.first_stable(views.count_polls(spark, sf), ["node"], ["ts", "event_id"], 4)
    return found.select("node", "event_id", "count", "outcome")


@query(
    "stalled_rise",
    with_views("count_polls", body="""
        WITH every AS (SELECT event_id, ts, node, coalesce(count, 0) AS count FROM count_polls),
        goals AS (SELECT *, max(CASE WHEN count >= 98 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY ts, event_id) AS met FROM every),
        known AS (SELECT event_id, ts, node, count FROM goals WHERE met = 0),
        marked AS (SELECT *, CASE WHEN count > greatest(coalesce(max(count) OVER (PARTITION BY node ORDER BY ts, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) THEN ts END AS moved FROM known),
        waits AS (SELECT *, coalesce(max(moved) OVER w, min(ts) OVER w) AS since FROM marked
                  WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)),
        hits AS (SELECT * FROM waits WHERE epoch_us(ts) - epoch_us(since) >= 36000000000)
        SELECT node, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(count, (ts, event_id)) AS value FROM hits GROUP BY node"""),
)
def stalled_rise(spark, sf):
    """No new maximum for ten hours; a key that has met its goal is no longer watched."""
    polls = views.count_polls(spark, sf).withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    found = streaks.stalled(polls, ["node"], ["ts", "event_id"], "count", 36000, goal=F.col("count") >= 98)
    return found.select("node", "event_id", "value")


def _fall_sql(source: str, out: str) -> str:
    return f"""
        {out}_m AS (SELECT *, CASE WHEN count < coalesce(lag(count) OVER w, 9999) THEN ts END AS moved FROM {source}
                    WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)),
        {out}_w AS (SELECT *, coalesce(max(moved) OVER w, min(ts) OVER w) AS since FROM {out}_m
                    WINDOW w AS (PARTITION BY node ORDER BY ts, event_id)),
        {out} AS (SELECT node, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(count, (ts, event_id)) AS value
                  FROM {out}_w WHERE epoch_us(ts) - epoch_us(since) >= 1800000000 GROUP BY node)"""


@query(
    "stalled_fall",
    with_views("count_polls", body=f"""
        WITH known AS (SELECT event_id, ts, 'u' || (event_id % 40) AS node, coalesce(count, 0) AS count FROM count_polls),
        {_fall_sql('known', 'first')},
        later AS (SELECT known.* FROM known JOIN first ON first.node = known.node AND known.ts > first.ts),
        {_fall_sql('later', 'again')}
        SELECT f.node, coalesce(a.event_id, f.event_id) AS event_id, coalesce(a.value, f.value) AS value,
               a.node IS NOT NULL AS gave_up
        FROM first f LEFT JOIN again a ON a.node = f.node"""),
)
def stalled_fall(spark, sf):
    """No drop against the previous poll for half an hour, one retry."""
    polls = views.count_polls(spark, sf).withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    polls = polls.withColumn("node", F.concat(F.lit("u"), F.col("event_id") % 40))
    found = streaks.stalled(polls, ["node"], ["ts", "event_id"], "count", 1800, "fall")
    return found.select("node", "event_id", "value", "gave_up")


@query(
    "newly_failed",
    """WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'failed'
                         ELSE 'running' END AS status FROM events),
       p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM e)
       SELECT event_id, user_id, status, previous_status FROM p
       WHERE status IN ('failed', 'error') AND status IS DISTINCT FROM previous_status""",
)
def newly_failed(spark, sf):
    """W14."""
    kind = F.col("event_type")
    events = table(spark, sf, "events").withColumn(
        "status", F.when(kind == "error", "error").when(kind == "purchase", "failed").otherwise("running")
    )
    found = streaks.newly_failed(events, ["user_id"], ["ts", "event_id"])
    return found.select("event_id", "user_id", "status", "previous_status")


@query(
    "monthly_sink",
    """SELECT strftime(o_orderdate, '%Y.%m') AS month, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def monthly_sink(spark, sf):
    """S10, written and read back."""
    root = scratch_path(spark, "monthly")
    write_monthly(table(spark, sf, "orders"), root, "results", "o_orderdate")
    back = read_monthly(spark, root, "results")
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "read_cat",
    """SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS active, props[1:1] = '{' AS has_more FROM events""",
)
def read_cat(spark, sf):
    """S13 on report lines made from events."""
    line = F.concat_ws("   ", F.lit(" ") , F.col("event_type"), F.col("user_id").cast("string"), F.col("props"))
    lines = table(spark, sf, "events").select("event_id", line.alias("value"))
    found = parse_cat(lines, ["name", "active", "more"], "name ")
    return found.select("event_id", "name", "active", F.col("more").startswith("{").alias("has_more"))


@query(
    "metrics_payload",
    with_views("node_samples", body="""
        WITH series AS (SELECT event_type, user_id, count(DISTINCT ts) AS n FROM node_samples GROUP BY ALL),
        timeline AS (SELECT event_type, count(*) AS n FROM node_samples GROUP BY ALL)
        SELECT event_type AS scenario, 'header' AS section, count(*) AS documents, CAST(0 AS BIGINT) AS last_part FROM timeline GROUP BY 1
        UNION ALL SELECT event_type, 'nodes', count(DISTINCT node), 0 FROM node_samples GROUP BY 1
        UNION ALL SELECT event_type, 'pods', CAST(sum((n + 49) // 50) AS BIGINT), max((n + 49) // 50) - 1 FROM series GROUP BY 1
        UNION ALL SELECT event_type, 'gc_timeline', (n + 499) // 500, (n + 499) // 500 - 1 FROM timeline"""),
)
def metrics_payload(spark, sf):
    """The number of documents per section."""
    usage = views.usage_text(spark, sf)
    scenario = F.col("event_type").alias("scenario")
    header = telemetry.payload_header(usage.select(scenario, F.lit("bench").alias("namespace"), "ts"), ["scenario", "namespace"])
    nodes = telemetry.node_usage_summary(usage.select(scenario, "node", "cpu", "memory"), ["scenario", "node"])
    pods = usage.select(scenario, F.concat(F.lit("pod-"), "user_id").alias("pod"), "ts", "cpu", "memory")
    series = telemetry.pod_series(telemetry.pod_usage(pods, ["scenario", "pod", "ts"]), ["scenario", "pod"], chunk_rows=50)
    gc = usage.select(scenario, "ts", "node", F.round("value", 1).alias("heap_used_mb"))
    documents = metrics_documents(header, nodes, series, gc, rows_per_part=500)
    return documents.groupBy("scenario", "section").agg(
        F.count(F.lit(1)).alias("documents"), F.max("part").alias("last_part")
    )
