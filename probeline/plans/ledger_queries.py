"""The run ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions import units
from probeline.operators import ledger
from probeline.plans import views
from probeline.plans.registry import query, table
from probeline.plans.views import with_views


def _micros(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _known(name, column=None):
    """A number, -1 for none."""
    column = F.col(name) if column is None else column
    return F.coalesce(column, F.lit(-1).cast("bigint")).alias(name)


@query(
    "latest_by_key",
    """SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
)
def latest_by_key(spark, sf):
    """W11."""
    return ledger.latest_by_key(table(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_id", "value")


@query(
    "next_queued",
    with_views("jobs", body="""
        SELECT engine, job_id, coalesce(queue_position, -1) AS queue_position FROM (
            SELECT *, row_number() OVER (PARTITION BY engine ORDER BY queue_position NULLS FIRST, created_at, job_id) AS rn
            FROM jobs WHERE status = 'queued') WHERE rn = 1"""),
)
def next_queued(spark, sf):
    """W4."""
    return ledger.next_queued(views.jobs(spark, sf)).select("engine", "job_id", _known("queue_position"))


@query(
    "assign_queue_position",
    with_views("jobs", body="""
        WITH live AS (SELECT engine, max(queue_position) AS last FROM jobs WHERE status IN ('queued', 'running') GROUP BY engine),
        fresh AS (SELECT job_id, engine, row_number() OVER (PARTITION BY engine ORDER BY created_at, job_id) AS n
                  FROM jobs WHERE status NOT IN ('queued', 'running'))
        SELECT job_id, fresh.engine, coalesce(last, 0) + n AS queue_position FROM fresh LEFT JOIN live ON live.engine = fresh.engine"""),
)
def assign_queue_position(spark, sf):
    """All ended jobs submitted again."""
    jobs = views.jobs(spark, sf)
    placed = ledger.assign_queue_position(jobs, jobs.filter("status NOT IN ('queued', 'running')"))
    return placed.select("job_id", "engine", "queue_position")


@query(
    "recent_jobs",
    with_views("jobs", body="""
        SELECT job_id, status, (SELECT count(*) FROM jobs) AS total FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50"""),
)
def recent_jobs(spark, sf):
    """L1."""
    return ledger.recent_jobs(views.jobs(spark, sf)).select("job_id", "status", "total")


@query(
    "union_ledgers",
    with_views("jobs", body="""
        SELECT job_id, engine, (SELECT count(*) FROM jobs) AS total FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 50"""),
)
def union_ledgers(spark, sf):
    """One ledger per engine, and one that cannot be reached."""
    jobs = views.jobs(spark, sf)
    parts = [jobs.filter(F.col("engine") == e) for e in views.ENGINES]
    return ledger.union_ledgers(parts[0], None, parts[1], parts[2]).select("job_id", "engine", "total")


@query(
    "ledger_health",
    with_views("jobs", body="""
        SELECT count(*) FILTER (WHERE status = 'running') AS active_jobs, count(*) AS total_jobs
        FROM (SELECT * FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1000)"""),
)
def ledger_health(spark, sf):
    """A8."""
    return ledger.ledger_health(views.jobs(spark, sf))


_RUN_STATUS_SQL = """
    counts AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f,
                      count(*) FILTER (WHERE status = 'cancelled') AS c, sum(duration_seconds) AS s FROM sweeps GROUP BY run_id),
    run_status AS (
        SELECT o_orderkey AS run_id,
               CASE WHEN coalesce(c, 0) > 0 THEN 'cancelled' WHEN coalesce(f, 0) > 0 AND f < n THEN 'partial_failure'
                    WHEN coalesce(f, 0) > 0 THEN 'failed' ELSE 'completed' END AS status,
               coalesce(n, 0) AS total_sweeps, coalesce(n - f - c, 0) AS successful_sweeps, coalesce(f, 0) AS failed_sweeps,
               coalesce(c, 0) AS cancelled_sweeps, round(coalesce(s, 0), 4) AS total_duration_seconds
        FROM orders LEFT JOIN counts ON counts.run_id = o_orderkey)"""


@query("run_status", with_views("sweeps", body=f"WITH {_RUN_STATUS_SQL} SELECT * FROM run_status"))
def run_status(spark, sf):
    """A4."""
    rolled = ledger.run_status(views.runs(spark, sf), views.sweeps(spark, sf, ordered=False))
    return rolled.withColumn("total_duration_seconds", F.round("total_duration_seconds", 4))


@query(
    "batch_status",
    with_views("sweeps", body=f"""
        WITH {_RUN_STATUS_SQL}
        SELECT c_custkey AS run_id, count(*) FILTER (WHERE r.status = 'completed') AS completed,
               count(*) FILTER (WHERE r.status <> 'completed') AS failed,
               CASE WHEN count(*) FILTER (WHERE r.status <> 'completed') = 0 THEN 'completed'
                    WHEN count(*) FILTER (WHERE r.status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS status
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN run_status r ON r.run_id = o_orderkey GROUP BY c_custkey"""),
)
def batch_status(spark, sf):
    """A5: the orders of a customer are its steps."""
    rolled = ledger.run_status(views.runs(spark, sf), views.sweeps(spark, sf, ordered=False))
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey")
    steps = rolled.join(owner, "run_id").select(F.col("o_custkey").alias("run_id"), "status")
    batches = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return ledger.batch_status(batches, steps)


@query(
    "ingest_outcome",
    with_views("sweeps", body="""
        WITH t AS (SELECT run_id, count(*) AS tries, arg_max(status, ord) AS last,
                          CAST(arg_max(duration_seconds, ord) AS BIGINT) AS final FROM sweeps GROUP BY run_id),
        e AS (SELECT o_orderkey AS run_id, 30 AS expected_docs, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 40 END AS pre_count FROM orders),
        j AS (SELECT e.*, tries, last, final, coalesce(pre_count >= expected_docs, false) AS skipped FROM e LEFT JOIN t ON t.run_id = e.run_id)
        SELECT run_id, CASE WHEN skipped OR coalesce(final >= expected_docs, false) THEN 'completed' WHEN last = 'cancelled' THEN 'cancelled' ELSE 'failed' END AS status,
               CASE WHEN skipped THEN 0 ELSE coalesce(tries, 0) END AS ingest_attempts,
               coalesce(CASE WHEN skipped THEN pre_count ELSE final END, -1) AS actual_docs, skipped FROM j"""),
)
def ingest_outcome(spark, sf):
    """The sweeps of a run as ingest attempts, their durations as counts."""
    sweeps = views.sweeps(spark, sf)
    attempts = sweeps.select("run_id", F.col("ord").alias("attempt"), "status")
    counts = sweeps.select("run_id", F.col("ord").alias("seq"), F.col("duration_seconds").cast("bigint").alias("count"))
    expected = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.lit(30).cast("bigint").alias("expected_docs"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 40).alias("pre_count"),
    )
    out = ledger.ingest_outcome(attempts, counts, expected)
    return out.select("run_id", "status", "ingest_attempts", _known("actual_docs"), "skipped")


@query(
    "progress",
    with_views("jobs", body="""
        WITH per AS (SELECT o_custkey, count(*) FILTER (WHERE status NOT IN ('queued', 'running')) AS done, count(*) AS total,
                            max(CASE WHEN status = 'running' THEN job_id END) AS current FROM jobs GROUP BY o_custkey)
        SELECT c_custkey AS run_id, coalesce(done, 0) AS done, coalesce(total, 0) AS total,
               coalesce(done, 0) + CASE WHEN current IS NULL THEN 0 ELSE 1 END AS display
        FROM customer LEFT JOIN per ON o_custkey = c_custkey"""),
)
def progress(spark, sf):
    """Jobs of a customer as steps."""
    jobs = views.jobs(spark, sf)
    steps = jobs.select(F.col("o_custkey").alias("run_id"), F.col("job_id").alias("step"), "status")
    current = steps.groupBy("run_id").agg(F.max(F.when(F.col("status") == "running", F.col("step").cast("string"))).alias("current_step"))
    batches = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id")).join(current, "run_id", "left")
    return ledger.progress(batches, steps)


@query(
    "dataset_text",
    """WITH d AS (SELECT DISTINCT o_custkey AS run_id, 'ds-' || (o_orderkey * 7 % (1 + o_custkey % 9)) AS dataset FROM orders)
       SELECT run_id, CASE WHEN count(*) <= 3 THEN string_agg(dataset, ', ' ORDER BY dataset) ELSE count(*) || ' datasets' END AS datasets
       FROM d GROUP BY run_id""",
)
def dataset_text(spark, sf):
    """A10."""
    number = F.col("o_orderkey") * 7 % (1 + F.col("o_custkey") % 9)
    steps = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("ds-"), number).alias("dataset"))
    return ledger.dataset_text(steps)


@query(
    "run_time",
    with_views("jobs", body="SELECT job_id, coalesce(epoch_us(try_strptime(left(run_id, 15), '%Y%m%d-%H%M%S')), -1) AS at_us FROM jobs"),
)
def run_time(spark, sf):
    """P8."""
    return views.jobs(spark, sf).select("job_id", _known("at_us", F.unix_micros(units.run_ts("run_id"))))


@query(
    "run_duration",
    with_views("jobs", body="""
        WITH d AS (SELECT job_id, (epoch_us(completed_at) - epoch_us(started_at)) // 1000000 AS s FROM jobs)
        SELECT job_id, CASE WHEN coalesce(s, 0) = 0 THEN 'N/A' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration FROM d"""),
)
def run_duration(spark, sf):
    """P24."""
    return views.jobs(spark, sf).select("job_id", units.run_duration("started_at", "completed_at").alias("duration"))


@query(
    "exit_status",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 5 = 0 OR l_linenumber = 7 THEN 'cancelled'
              WHEN l_linenumber = 1 THEN 'completed' ELSE 'failed' END AS status FROM lineitem""",
)
def exit_status(spark, sf):
    """P26."""
    code = F.when(F.col("l_linenumber") == 7, -9).when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", units.sweep_status(code, F.col("l_suppkey") % 5 == 0).alias("status")
    )


@query(
    "retain",
    with_views("jobs", body="""
        SELECT job_id FROM jobs WHERE try_strptime(left(run_id, 15), '%Y%m%d-%H%M%S') IS NULL
           OR try_strptime(left(run_id, 15), '%Y%m%d-%H%M%S') >= (SELECT max(created_at) FROM jobs) - INTERVAL 21 DAY"""),
)
def retain(spark, sf):
    """M6, seen from the newest job."""
    jobs = views.jobs(spark, sf)
    now = jobs.agg(F.max("created_at").cast("timestamp")).scalar()
    return ledger.retain(jobs, now).select("job_id")


@query("delete_kept", with_views("jobs", body="SELECT job_id FROM jobs WHERE NOT (o_orderpriority = '1-URGENT' AND status <> 'running')"))
def delete_kept(spark, sf):
    """M7: delete the urgent jobs."""
    jobs = views.jobs(spark, sf)
    return ledger.delete_jobs(jobs, jobs.filter("o_orderpriority = '1-URGENT'"))[0].select("job_id")


@query("delete_refused", with_views("jobs", body="SELECT job_id FROM jobs WHERE o_orderpriority = '1-URGENT' AND status = 'running'"))
def delete_refused(spark, sf):
    """M7: running jobs are refused."""
    jobs = views.jobs(spark, sf)
    return ledger.delete_jobs(jobs, jobs.filter("o_orderpriority = '1-URGENT'"))[1].select("job_id")


def _cancelled(spark, sf):
    jobs = views.jobs(spark, sf)
    return ledger.cancel_jobs(jobs, jobs.filter("o_orderpriority = '1-URGENT'"), F.lit("2030-01-01").cast("timestamp_ntz"))


_CANCEL_SQL = """
    cancelled AS (
        SELECT job_id, status AS previous_status, o_orderpriority = '1-URGENT' AND status IN ('queued', 'running') AS hit,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN NULL WHEN status IN ('queued', 'running') THEN 'cancelled'
                    ELSE 'already ' || status END AS cancel_reply, completed_at FROM jobs)"""


@query(
    "cancel_jobs",
    with_views("jobs", body=f"""
        WITH {_CANCEL_SQL}
        SELECT job_id, CASE WHEN hit THEN 'cancelled' ELSE previous_status END AS status, cancel_reply,
               coalesce(epoch_us(CASE WHEN hit THEN TIMESTAMP '2030-01-01' ELSE completed_at END), -1) AS completed_us,
               CASE WHEN hit THEN 'Job cancelled by user' END AS error FROM cancelled"""),
)
def cancel_jobs(spark, sf):
    """M8 on jobs."""
    return _cancelled(spark, sf).select("job_id", "status", "cancel_reply", _known("completed_us", _micros("completed_at")), "error")


@query(
    "cancel_steps",
    with_views("jobs", body=f"""
        WITH {_CANCEL_SQL},
        steps AS (SELECT l_orderkey AS job_id, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'queued' ELSE 'running' END AS status
                  FROM lineitem)
        SELECT s.job_id, s.l_linenumber, s.l_partkey, s.l_suppkey, CASE WHEN hit AND (previous_status = 'queued' OR s.status = 'queued') THEN 'cancelled' ELSE s.status END AS status
        FROM steps s LEFT JOIN cancelled c ON c.job_id = s.job_id"""),
)
def cancel_steps(spark, sf):
    """M8 on steps: lines of an order are its steps."""
    flag = F.col("l_returnflag")
    steps = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.when(flag == "A", "completed").when(flag == "N", "queued").otherwise("running").alias("status"),
    )
    return ledger.cancel_steps(steps, _cancelled(spark, sf))


@query(
    "recover_orphans",
    with_views("jobs", body="""
        SELECT job_id, CASE WHEN status = 'running' THEN 'cancelled' ELSE status END AS status,
               coalesce(epoch_us(CASE WHEN status = 'running' THEN last_heartbeat_at ELSE completed_at END), -1) AS completed_us,
               CASE WHEN status = 'running' THEN 'Job orphaned by pod restart — cancelled on startup recovery' END AS error FROM jobs"""),
)
def recover_orphans(spark, sf):
    """M9."""
    return ledger.recover_orphans(views.jobs(spark, sf)).select("job_id", "status", _known("completed_us", _micros("completed_at")), "error")


@query("remaining_steps", with_views("jobs", body="SELECT o_custkey AS run_id, job_id AS step FROM jobs WHERE status <> 'completed'"))
def remaining_steps(spark, sf):
    """M10."""
    status = views.jobs(spark, sf).select(F.col("o_custkey").alias("run_id"), F.col("job_id").alias("step"), "status")
    return ledger.remaining_steps(status.drop("status"), status)


@query(
    "uncollected_steps",
    with_views("jobs", body="SELECT o_custkey AS run_id, job_id AS step FROM jobs WHERE status NOT IN ('queued', 'running') AND engine <> 'disk'"),
)
def uncollected_steps(spark, sf):
    """U4: the steps of one engine are collected."""
    steps = views.jobs(spark, sf).select(F.col("o_custkey").alias("run_id"), F.col("job_id").alias("step"), "status", "engine")
    return ledger.uncollected(steps, steps.filter("engine = 'disk'")).select("run_id", "step")


@query(
    "unpack_job",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k,
              CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'base-' || user_id END AS results_base,
              CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN event_type END AS first_status,
              CAST(CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS current_scenario_index FROM events""",
)
def unpack_job(spark, sf):
    """Options with and without batch fields, and empty ones."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    meta = F.struct(
        F.concat(F.lit("base-"), "user_id").alias("results_base"),
        F.create_map(F.lit("step"), F.col("event_type")).alias("scenario_status"),
        F.lit(2).alias("current_scenario_index"),
    )
    batch = F.to_json(F.struct(k.alias("k"), F.array(F.struct(F.lit("d").alias("dataset"))).alias("_batch_scenarios"), meta.alias("_batch_metadata")))
    plain = F.to_json(F.struct(k.alias("k")))
    kind = F.col("event_id")
    options = F.when(kind % 3 == 0, F.lit("")).when(kind % 2 == 0, batch).otherwise(plain)
    rows = e.select("event_id", options.alias("options"), F.lit(None).cast("string").alias("result"))
    return ledger.unpack_job(rows).select(
        "event_id", F.col("options")["k"].alias("k"), "results_base", F.col("scenario_status")["step"].alias("first_status"),
        "current_scenario_index",
    )
