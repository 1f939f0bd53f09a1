"""The run ledger: upserts, queues, status roll-ups, cancel, delete, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeline.functions.units import run_ts
from probeline.operators.timeline import numbered

# The terminal and live states, list sizes, retention, error texts and the keys of the options document.
TERMINAL = ("completed", "error", "cancelled", "failed", "partial", "partial_failure")
LIVE = ("queued", "running")
RECENT = 50
HEALTH_WINDOW = 1000
RETENTION_DAYS = 21
CANCELLED_TEXT = "Job cancelled by user"
ORPHANED_TEXT = "Job orphaned by pod restart — cancelled on startup recovery"
STEPS_KEY = "_batch_scenarios"
META_KEY = "_batch_metadata"
META = """
STRUCT<results_base: STRING, scenario_status: MAP<STRING, STRING>, scenario_results: MAP<STRING, STRING>,
       scenario_times: MAP<STRING, STRUCT<started_at: STRING, completed_at: STRING>>, current_scenario: STRING,
       current_scenario_index: INT>
"""


def latest_by_key(events: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last write per key. Each task keeps one row per key before the shuffle, so hot keys stay cheap."""
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return events.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def next_queued(jobs: DataFrame) -> DataFrame:
    """Per engine the queued job with the lowest position (none counts as first), then the oldest."""
    order = Window.partitionBy("engine").orderBy(F.asc_nulls_first("queue_position"), "created_at", "job_id")
    queued = jobs.filter(F.col("status") == "queued")
    return queued.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def assign_queue_position(
    jobs: DataFrame, new: DataFrame, order: Sequence[str] = ("created_at", "job_id"), slices: int | None = None,
) -> DataFrame:
    """New jobs get the positions after the highest live one of their engine, in arrival order."""
    live = jobs.filter(F.col("status").isin(*LIVE))
    last = live.groupBy("engine").agg(F.max("queue_position").alias("_last"))
    ranked = numbered(new.drop("queue_position"), ["engine"], order, "_n", slices)
    placed = ranked.join(last, "engine", "left")
    return placed.withColumn(
        "queue_position", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("bigint")
    ).drop("_last", "_n")


def recent_jobs(jobs: DataFrame, n: int = RECENT) -> DataFrame:
    """L1: the newest ``n`` jobs with the total count alongside (a top-k, not a global sort)."""
    total = jobs.agg(F.count(F.lit(1))).scalar()
    newest = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)
    return newest.withColumn("total", total)


def union_ledgers(*ledgers: DataFrame, n: int = RECENT) -> DataFrame:
    """Several ledgers merged; the newest ``n`` jobs and the summed total. A ``None`` source is skipped."""
    present = [ledger for ledger in ledgers if ledger is not None]
    if not present:
        raise ValueError("no ledger can be reached")
    merged = present[0]
    for other in present[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return recent_jobs(merged, n)


def ledger_health(jobs: DataFrame, n: int = HEALTH_WINDOW) -> DataFrame:
    """Running and total jobs among the newest ``n`` only."""
    newest = jobs.select("job_id", "created_at", "status").orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)
    return newest.agg(
        F.count_if(F.col("status") == "running").alias("active_jobs"), F.count(F.lit(1)).alias("total_jobs")
    )


def run_status(runs: DataFrame, sweeps: DataFrame, run: str = "run_id") -> DataFrame:
    """A4: sweeps rolled up to a run. Any cancelled sweep cancels it; a run without sweeps is completed."""
    counts = sweeps.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_sweeps"),
        F.count_if(F.col("status") == "failed").alias("failed_sweeps"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_sweeps"),
        F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("total_duration_seconds"),
    )
    joined = runs.select(run).join(counts, run, "left")
    zero = F.lit(0).cast("bigint")
    c = {n: F.coalesce(F.col(n), zero) for n in ("total_sweeps", "failed_sweeps", "cancelled_sweeps")}
    status = (
        F.when(c["cancelled_sweeps"] > 0, "cancelled")
        .when((c["failed_sweeps"] > 0) & (c["failed_sweeps"] < c["total_sweeps"]), "partial_failure")
        .when(c["failed_sweeps"] > 0, "failed")
        .otherwise("completed")
    )
    return joined.select(
        run,
        status.alias("status"),
        c["total_sweeps"].alias("total_sweeps"),
        (c["total_sweeps"] - c["failed_sweeps"] - c["cancelled_sweeps"]).alias("successful_sweeps"),
        c["failed_sweeps"].alias("failed_sweeps"),
        c["cancelled_sweeps"].alias("cancelled_sweeps"),
        F.coalesce("total_duration_seconds", F.lit(0.0)).alias("total_duration_seconds"),
    )


def batch_status(runs: DataFrame, steps: DataFrame, run: str = "run_id") -> DataFrame:
    """A5: steps rolled up to a batch. Only ``completed`` is a success."""
    done = F.col("status") == "completed"
    counts = steps.groupBy(run).agg(
        F.count_if(done).alias("completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("failed")
    )
    joined = runs.select(run).join(counts, run, "left").na.fill(0, ["completed", "failed"])
    status = (
        F.when(F.col("failed") == 0, "completed").when(F.col("completed") == 0, "failed").otherwise("partial")
    )
    return joined.withColumn("status", status)


def ingest_outcome(attempts: DataFrame, counts: DataFrame, expected: DataFrame, run: str = "run_id") -> DataFrame:
    """The outcome of an ingest comes from the final count, not from exit codes.

    ``attempts`` is (run, attempt, status), ``counts`` (run, seq, count; the last known one is final), ``expected``
    (run, expected_docs, pre_count). A table that was complete beforehand is skipped with no attempts.
    """
    tries = attempts.groupBy(run).agg(
        F.max_by("status", "attempt").alias("_last"), F.count(F.lit(1)).alias("_tries")
    )
    final = counts.filter(F.col("count").isNotNull()).groupBy(run).agg(F.max_by("count", "seq").alias("_final"))
    joined = expected.join(tries, run, "left").join(final, run, "left")
    skipped = F.coalesce(F.col("pre_count") >= F.col("expected_docs"), F.lit(False))
    actual = F.when(skipped, F.col("pre_count")).otherwise(F.col("_final"))
    status = (
        F.when(F.coalesce(actual >= F.col("expected_docs"), F.lit(False)), "completed")
        .when(F.col("_last") == "cancelled", "cancelled")
        .otherwise("failed")
    )
    return joined.select(
        run,
        status.alias("status"),
        F.when(skipped, F.lit(0)).otherwise(F.coalesce("_tries", F.lit(0))).cast("bigint").alias("ingest_attempts"),
        "expected_docs",
        actual.alias("actual_docs"),
        F.greatest(F.col("expected_docs") - actual, F.lit(0).cast("bigint")).alias("shortfall"),
        skipped.alias("skipped"),
    )


def progress(jobs: DataFrame, steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Finished and total steps per run; while a step runs the display is one ahead of the finished count.

    ``jobs`` is (run, current_step), ``steps`` (run, step, status) in long form.
    """
    counts = steps.groupBy(run).agg(
        F.count_if(F.col("status").isin(*TERMINAL)).alias("done"), F.count(F.lit(1)).alias("total")
    )
    joined = jobs.select(run, "current_step").join(counts, run, "left").na.fill(0, ["done", "total"])
    running = F.coalesce(F.col("current_step"), F.lit("")) != ""
    return joined.select(run, "done", "total", (F.col("done") + F.when(running, 1).otherwise(0)).alias("display"))


def status_rows(jobs: DataFrame, run: str = "run_id", status_map: str = "scenario_status") -> DataFrame:
    """A job's step status map as (run, step, status) rows."""
    return jobs.select(run, F.explode(status_map).alias("step", "status"))


def dataset_text(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """A10: up to three dataset names joined, else ``N datasets``. Names are sorted; at most three are gathered."""
    pairs = steps.select(run, "dataset").distinct()
    counts = pairs.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(run).orderBy("dataset")
    few = pairs.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 3")
    names = few.groupBy(run).agg(F.array_sort(F.collect_list("dataset")).alias("_names"))
    text = F.when(F.col("_n") <= 3, F.array_join("_names", ", ")).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" datasets")))
    return counts.join(names, run).select(run, text.alias("datasets"))


def unpack_job(jobs: DataFrame) -> DataFrame:
    """The JSON columns of a job row as typed columns; an empty document is an empty map.

    Batch fields stored inside ``options`` become columns of their own, with their defaults.
    """
    empty = F.create_map().cast("map<string,string>")
    read = lambda c: F.coalesce(F.from_json(c, "MAP<STRING, STRING>"), empty)
    df = jobs.withColumn("_o", read("options")).withColumn("result", read("result"))
    meta = F.from_json(F.col("_o")[META_KEY], META)
    batch = F.map_contains_key("_o", STEPS_KEY)
    steps = F.from_json(F.col("_o")[STEPS_KEY], "ARRAY<MAP<STRING, STRING>>")
    return (
        df.withColumn("_m", F.when(batch, meta))
        .withColumn("scenarios", steps)
        .withColumn("options", F.map_filter("_o", lambda k, v: ~k.isin(STEPS_KEY, META_KEY)))
        .withColumn("results_base", F.col("_m.results_base"))
        .withColumn("scenario_status", F.coalesce(F.col("_m.scenario_status"), empty))
        .withColumn("scenario_results", F.coalesce(F.col("_m.scenario_results"), empty))
        .withColumn("scenario_times", F.col("_m.scenario_times"))
        .withColumn("current_scenario", F.col("_m.current_scenario"))
        .withColumn("current_scenario_index", F.coalesce(F.col("_m.current_scenario_index"), F.lit(0)))
        .drop("_o", "_m")
    )


def retain(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS, run: str = "run_id") -> DataFrame:
    """M6: drop runs whose id time is older than ``days``; ids that carry no time are kept."""
    at = F.unix_seconds(run_ts(run))
    return jobs.filter(at.isNull() | (at >= F.unix_seconds(now) - days * 86400))


def delete_jobs(jobs: DataFrame, ids: DataFrame, key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """M7: ``(kept, refused)``. Running jobs among ``ids`` are refused and stay."""
    asked = ids.select(key).distinct()
    running = F.coalesce(F.col("status") == "running", F.lit(False))
    marked = jobs.join(asked.withColumn("_asked", F.lit(True)), key, "left")
    kept = marked.filter(F.col("_asked").isNull() | running).drop("_asked")
    refused = marked.filter(F.col("_asked").isNotNull() & running).drop("_asked")
    return kept, refused


def cancel_jobs(jobs: DataFrame, ids: DataFrame, now: Column, key: str = "job_id", status_map: str | None = None) -> DataFrame:
    """M8: cancel queued and running jobs; ``cancel_reply`` says what happened to each asked job.

    In a ``status_map`` column a queued job loses all steps, a running job only those still queued.
    """
    asked = ids.select(key).distinct().withColumn("_asked", F.lit(True))
    df = jobs.join(asked, key, "left").withColumn("previous_status", F.col("status"))
    hit = F.col("_asked") & F.col("previous_status").isin(*LIVE)
    reply = (
        F.when(hit, "cancelled")
        .when(F.col("_asked") & F.col("previous_status").isin(*TERMINAL), F.concat(F.lit("already "), "previous_status"))
        .when(F.col("_asked"), "unknown status")
    )
    df = (
        df.withColumn("cancel_reply", reply)
        .withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))
        .withColumn("completed_at", F.when(hit, now).otherwise(F.col("completed_at")))
        .withColumn("error", F.when(hit, F.lit(CANCELLED_TEXT)).otherwise(F.col("error")))
    )
    if status_map:
        whole = F.transform_values(status_map, lambda k, v: F.lit("cancelled"))
        waiting = F.transform_values(status_map, lambda k, v: F.when(v == "queued", F.lit("cancelled")).otherwise(v))
        df = df.withColumn(
            status_map,
            F.when(hit & (F.col("previous_status") == "queued"), whole)
            .when(hit, waiting)
            .otherwise(F.col(status_map)),
        )
    return df.drop("_asked")


def cancel_steps(steps: DataFrame, cancelled: DataFrame, key: str = "job_id") -> DataFrame:
    """M8 on steps in long form: ``cancelled`` is the result of ``cancel_jobs``."""
    hits = cancelled.filter(F.col("cancel_reply") == "cancelled").select(key, F.col("previous_status").alias("_was"))
    joined = steps.join(hits, key, "left")
    gone = (F.col("_was") == "queued") | ((F.col("_was") == "running") & (F.col("status") == "queued"))
    return joined.withColumn("status", F.when(gone, "cancelled").otherwise(F.col("status"))).drop("_was")


def recover_orphans(jobs: DataFrame) -> DataFrame:
    """M9: jobs left running by a restart are cancelled and end at their last heartbeat, if they had one."""
    running = F.col("status") == "running"
    return (
        jobs.withColumn("completed_at", F.when(running, F.col("last_heartbeat_at")).otherwise(F.col("completed_at")))
        .withColumn("error", F.when(running, F.lit(ORPHANED_TEXT)).otherwise(F.col("error")))
        .withColumn("status", F.when(running, "cancelled").otherwise(F.col("status")))
    )


def remaining_steps(steps: DataFrame, status: DataFrame, keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """Steps to run on resume: all but the completed ones."""
    return steps.join(status.filter(F.col("status") == "completed").select(*keys), list(keys), "left_anti")


def uncollected(terminal: DataFrame, collected: DataFrame, keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """U4: finished steps whose results have not been collected yet."""
    done = terminal.filter(F.col("status").isin(*TERMINAL))
    return done.join(collected.select(*keys), list(keys), "left_anti")
