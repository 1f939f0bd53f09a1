import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from probeline.operators import ledger, reports
from probeline.operators.telemetry import diff_snapshots, flatten_node_stats, index_overview, samples_in_sweeps, usage_with_pool


def sweeps(spark, *statuses):
    data = [(f"r{i}", s, 1.5 if s != "failed" else None) for i, run in enumerate(statuses) for s in run]
    return spark.createDataFrame(data, "run_id string, status string, duration_seconds double")


def test_run_status(spark):
    cases = [["failed", "completed"], ["failed"], ["cancelled", "failed"], []]
    runs = spark.createDataFrame([(f"r{i}",) for i in range(4)], "run_id string")
    got = ledger.run_status(runs, sweeps(spark, *cases)).select("run_id", "status", "total_sweeps", "successful_sweeps", "total_duration_seconds")
    assert rows(got) == [("r0", "partial_failure", 2, 1, 1.5), ("r1", "failed", 1, 0, 0.0), ("r2", "cancelled", 2, 0, 1.5), ("r3", "completed", 0, 0, 0.0)]


def test_batch_status(spark):
    steps = sweeps(spark, ["completed", "partial_failure"], ["failed"], ["completed"])
    runs = spark.createDataFrame([(f"r{i}",) for i in range(4)], "run_id string")
    got = ledger.batch_status(runs, steps).select("run_id", "status")
    assert rows(got) == [("r0", "partial"), ("r1", "failed"), ("r2", "completed"), ("r3", "completed")]


def test_ingest_outcome(spark):
    attempts = spark.createDataFrame([("a", 1, "completed"), ("b", 1, "completed"), ("b", 2, "cancelled"), ("c", 1, "completed")], "run_id string, attempt int, status string")
    counts = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, None), ("b", 1, 4), ("c", 1, 9)], "run_id string, seq int, count bigint")
    expected = spark.createDataFrame([("a", 10, 0), ("b", 10, None), ("c", 10, 3), ("d", 10, 12)], "run_id string, expected_docs bigint, pre_count bigint")
    assert rows(ledger.ingest_outcome(attempts, counts, expected)) == [
        ("a", "completed", 1, 10, 10, 0, False), ("b", "cancelled", 2, 10, 4, 6, False),
        ("c", "failed", 1, 10, 9, 1, False), ("d", "completed", 0, 10, 12, 0, True)]


def jobs(spark):
    data = [("q", "queued", "e", 3), ("q0", "queued", "e", None), ("r", "running", "e", 7), ("c", "completed", "e", 9), ("x", "odd", "f", 1)]
    df = spark.createDataFrame(data, "job_id string, status string, engine string, queue_position bigint")
    df = df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("completed_at", F.lit(None).cast("timestamp"))
    steps = F.create_map(F.lit("a"), F.lit("completed"), F.lit("b"), F.lit("queued"), F.lit("c"), F.lit("running"))
    return df.withColumn("error", F.lit(None).cast("string")).withColumn("last_heartbeat_at", F.lit(None).cast("timestamp")).withColumn("scenario_status", steps)


def test_queue(spark):
    assert rows(ledger.next_queued(jobs(spark)).select("engine", "job_id")) == [("e", "q0")]
    new = spark.createDataFrame([("n1", "e", 1), ("n2", "e", 2), ("n3", "g", 1)], "job_id string, engine string, created_at bigint")
    got = ledger.assign_queue_position(jobs(spark), new, slices=2).select("job_id", "queue_position")
    assert rows(got) == [("n1", 8), ("n2", 9), ("n3", 1)]


def test_cancel(spark):
    ids = spark.createDataFrame([("q",), ("r",), ("c",), ("x",), ("none",)], "job_id string")
    got = ledger.cancel_jobs(jobs(spark), ids, F.lit("2024-02-02").cast("timestamp"), status_map="scenario_status")
    seen = {r["job_id"]: r for r in got.collect()}
    assert {k: r["cancel_reply"] for k, r in seen.items()} == {"q": "cancelled", "r": "cancelled", "c": "already completed", "x": "unknown status", "q0": None}
    assert seen["q"]["scenario_status"] == {"a": "cancelled", "b": "cancelled", "c": "cancelled"}
    assert seen["r"]["scenario_status"] == {"a": "completed", "b": "cancelled", "c": "running"}
    assert seen["c"]["scenario_status"]["b"] == "queued" and seen["c"]["completed_at"] is None
    assert seen["q0"]["status"] == "queued" and seen["r"]["status"] == "cancelled" and seen["r"]["completed_at"] is not None


def test_delete_and_recover(spark):
    kept, refused = ledger.delete_jobs(jobs(spark), spark.createDataFrame([("q",), ("r",)], "job_id string"))
    assert rows(kept.select("job_id")) == [("c",), ("q0",), ("r",), ("x",)] and rows(refused.select("job_id")) == [("r",)]
    back = ledger.recover_orphans(jobs(spark)).filter("job_id = 'r'").first()
    assert back["status"] == "cancelled" and back["completed_at"] is None and back["error"]


def test_retain(spark):
    ids = spark.createDataFrame([("20240101-000000",), ("20240120-000000-x",), ("manual",)], "run_id string")
    got = ledger.retain(ids, F.lit("2024-01-25").cast("timestamp"))
    assert rows(got) == [("20240120-000000-x",), ("manual",)]
    assert rows(ledger.retain(ids, F.lit("2024-01-22").cast("timestamp")))[0] == ("20240101-000000",)


def test_lists(spark):
    many = spark.createDataFrame([(f"{i:04d}", i, "running" if i % 2 else "queued") for i in range(1200)], "job_id string, created_at bigint, status string")
    recent = ledger.recent_jobs(many, 3)
    assert rows(recent.select("job_id", "total")) == [("1197", 1200), ("1198", 1200), ("1199", 1200)]
    assert rows(ledger.ledger_health(many)) == [(500, 1000)]
    both = ledger.union_ledgers(many.filter("created_at < 5"), None, many.filter("created_at >= 1199"), n=2)
    assert rows(both.select("job_id", "total")) == [("0004", 6), ("1199", 6)]


def test_progress_and_text(spark):
    runs = spark.createDataFrame([("r", "s2"), ("e", None)], "run_id string, current_step string")
    steps = spark.createDataFrame([("r", "s1", "completed"), ("r", "s2", "running"), ("r", "s3", "partial")], "run_id string, step string, status string")
    assert rows(ledger.progress(runs, steps)) == [("e", 0, 0, 0), ("r", 2, 3, 3)]
    data = spark.createDataFrame([("r", d) for d in "bab"] + [("s", d) for d in "abcd"], "run_id string, dataset string")
    assert rows(ledger.dataset_text(data)) == [("r", "a, b"), ("s", "4 datasets")]


def test_unpack(spark):
    options = {"no_metrics": True, "_batch_scenarios": [{"dataset": "d", "label": "l"}], "_batch_metadata": {"results_base": "b", "scenario_status": {"d-l": "queued"}}}
    df = spark.createDataFrame([(1, json.dumps(options), '{"status": "ok"}'), (2, "", None)], "id int, options string, result string")
    a, b = ledger.unpack_job(df).orderBy("id").collect()
    assert a["options"] == {"no_metrics": "true"} and a["scenarios"][0]["label"] == "l" and a["scenario_status"] == {"d-l": "queued"}
    assert a["current_scenario_index"] == 0 and a["result"] == {"status": "ok"}
    assert b["options"] == {} and b["result"] == {} and b["scenarios"] is None and b["scenario_status"] == {}


def test_latest(spark):
    events = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, seq int, v string")
    assert rows(ledger.latest_by_key(events, ["k"], "seq").select("k", "v")) == [("a", "z"), ("b", "q")]


def test_order_and_rank(spark):
    named = spark.createDataFrame([("r", "sweep-2"), ("r", "sweep-10"), ("r", "sweep-1")], "run_id string, sweep_name string")
    assert [r[1] for r in reports.order_sweeps(named).collect()] == ["sweep-1", "sweep-10", "sweep-2"]
    assert [r[1] for r in reports.order_sweeps(named, numeric=True).collect()] == ["sweep-1", "sweep-2", "sweep-10"]
    timed = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 5.0), ("d", 9.0)], "run_id string, total_seconds double")
    assert rows(reports.rank_sweeps(timed, slices=3).select("run_id", "rank")) == [("a", 2), ("b", 1), ("c", 2), ("d", 4)]


def test_timings(spark):
    steps = spark.createDataFrame([("r", "d", "l"), ("r", "d", "m")], "run_id string, dataset string, label string")
    data = spark.createDataFrame([("r", "d-l", i, "completed") for i in (2, 1, 3)], "run_id string, step string, sweep_index int, status string")
    got = reports.attach_timings(steps, data, chunk_rows=2).select("label", "chunk", F.transform("sweep_results", lambda s: s["sweep_index"]))
    assert rows(got) == [("l", 0, [1, 2]), ("l", 1, [3]), ("m", 0, [])]


def test_diff_snapshots(spark):
    before = spark.createDataFrame([("n1", 5, 1), ("gone", 1, 1)], "node_id string, c bigint, g int")
    after = spark.createDataFrame([("n1", "a", 9, 2), ("n2", None, 4, 3)], "node_id string, node string, c bigint, g int")
    got = diff_snapshots(before, after, ["node_id"], ["c"], ["g"], "node")
    assert rows(got) == [("n1", "a", 4, 2), ("n2", "n2", 4, 3)]


def test_flatten_missing_values(spark):
    doc = {"id1": {"jvm": {"mem": {"heap_used_in_bytes": 1572864}}}, "id2": {"name": "n", "os": {"cpu": {"load_average": {"1m": 0.5}}}}}
    df = spark.createDataFrame([("t", json.dumps(doc))], "ts string, nodes string")
    got = flatten_node_stats(df).select("node", "heap_used_mb", "load_1m", "gc_old_ms")
    assert rows(got) == [("id1", 2, None, None), ("n", 0, 0.5, None)]


def test_index_overview_error_document(spark):
    df = spark.createDataFrame([("i", '{"error": "HTTP 404"}', '{"error": "HTTP 404"}', None)], "index string, stats string, settings string, mapping string")
    row = index_overview(df).first()
    assert row["docs"] is None and row["shards"] is None


def test_pool_join(spark):
    usage = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "node string, cpu_avg double")
    nodes = spark.createDataFrame([("a", "p"), ("z", "q")], "node string, node_pool string")
    assert rows(usage_with_pool(usage, nodes)) == [("a", "p", 1.0), ("b", "unknown", 2.0), ("z", "q", 0.0)]


@pytest.mark.parametrize("bucket", [10, 3600])
def test_interval_join(spark, bucket):
    samples = spark.createDataFrame([(i, i) for i in range(0, 100, 5)], "id int, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    windows = spark.createDataFrame([("a", 10, 50), ("b", 50, 50), ("c", 90, 20)], "run string, s bigint, e bigint")
    windows = windows.select("run", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("completed_at"))
    got = samples_in_sweeps(samples, windows, bucket_s=bucket).select("run", "id")
    assert rows(got) == sorted([("a", i) for i in range(10, 51, 5)] + [("b", 50)], key=repr)
    trimmed = samples_in_sweeps(samples, windows, warmup_s=15, bucket_s=bucket).select("run", "id")
    assert rows(trimmed) == [("a", i) for i in range(25, 51, 5)]


def test_artifacts(spark):
    steps = spark.createDataFrame([("j", "e", s) for s in ("rec", "eng", "dir", "none")], "run_id string, engine string, step string")
    known = spark.createDataFrame([("j", "rec", "sweep-1"), ("j", "rec", "sweep-2")], "run_id string, step string, sweep_name string")
    dirs = spark.createDataFrame([("j/e/eng",), ("j/e/eng/sweep-1",), ("j/e/eng/sweep-2",), ("j/eng/sweep-9",), ("j/dir",)], "dir string")
    got = reports.resolve_artifacts(steps, known, dirs).select("step", "sweep_name", "dir", "source")
    assert rows(got) == [
        ("dir", None, "j/dir", "direct path"), ("eng", "sweep-1", "j/e/eng/sweep-1", "engine path"), ("eng", "sweep-2", "j/e/eng/sweep-2", "engine path"),
        ("none", None, None, "missing"), ("rec", "sweep-1", "j/rec/sweep-1", "recorded"), ("rec", "sweep-2", "j/rec/sweep-2", "recorded")]
