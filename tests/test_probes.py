"""Small cases in which rows, order or zones were once lost."""

import json

from pyspark.sql import functions as F

from probeline.functions.units import run_ts
from probeline.operators import experiments, search, streaks, telemetry
from probeline.sources import trees


def vectors(spark, *rows, name="vec_id"):
    return spark.createDataFrame(list(rows), f"{name} long, embedding array<double>")


def test_odd_queries_do_not_empty_a_search(spark):
    base = vectors(spark, *[(i, [float(i), 1.0]) for i in range(5)], (9, [1.0]))
    asked = vectors(spark, *[(i, [1.0, float(i)]) for i in range(5)], (7, [1.0, 2.0, 3.0]), (8, None), name="query_id")
    assert search.exact_knn(base, asked, 3).count() == 15
    found = {r["query_id"]: r["reason"] for r in search.rejected_vectors(asked).collect()}
    assert found == {7: "length", 8: "null"}
    assert [r["vec_id"] for r in search.rejected_vectors(base, 2).collect()] == [9]
    assert search.rejected_vectors(vectors(spark, (1, [1.0, None]), (2, [1.0, 1.0]))).collect()[0]["reason"] == "component"


def test_unanswered_queries_score_nothing(spark):
    truth = spark.createDataFrame([(q, v, r) for q in (1, 2) for r, v in enumerate((10, 11), 1)], "query_id long, vec_id long, rank int")
    found = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("b", 2, 10, 1)], "run string, query_id long, vec_id long, rank int")
    plain = search.recall_at_k(found.filter("run = 'a'").drop("run"), truth, 2)
    assert search.mean_recall(plain).collect()[0].asDict() == {"recall": 0.5, "queries": 2}
    by_run = {(r["run"], r["query_id"]): r["recall"] for r in search.recall_at_k(found, truth, 2, ["run"]).collect()}
    assert by_run == {("a", 1): 1.0, ("a", 2): 0.0, ("b", 1): 0.0, ("b", 2): 0.5}


def test_run_order_of_many_steps(spark):
    steps = spark.createDataFrame(
        [(0, 2**20, [{}, {}], None), (0, 0, [{}, {}], None), (0, 2**21 + 1, [{}, {}], None)],
        "suite_id long, step_ord long, suite_sweeps array<map<string,string>>, step_sweeps array<map<string,string>>",
    ).withColumns({"params": F.create_map().cast("map<string,string>"), "suite_params": F.create_map().cast("map<string,string>")})
    found = experiments.expand_sweeps(steps).orderBy("ord").select("suite_sweep", "step_ord", "ord").collect()
    assert [(r["suite_sweep"], r["step_ord"]) for r in found] == [(s, o) for s in (0, 1) for o in (0, 2**20, 2**21 + 1)]
    assert len({r["ord"] for r in found}) == 6


def test_a_running_sweep_has_samples(spark):
    samples = spark.createDataFrame([("2024-01-01 00:00:10",), ("2024-01-01 05:00:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    sweeps = spark.createDataFrame([(1, "2024-01-01 00:00:00", None), (2, "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "run_id int, started_at string, completed_at string")
    sweeps = sweeps.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "completed_at")})
    found = telemetry.samples_in_sweeps(samples, sweeps)
    assert sorted(r["run_id"] for r in found.collect()) == [1, 1, 2]


def test_result_trees_below_odd_names(spark, tmp_path):
    for name in ("plain", "a b+c%41"):
        folder = tmp_path / name / "job 1" / "engine" / "data-x"
        folder.mkdir(parents=True)
        (folder / "test_run.json").write_text(json.dumps({"x": 1}))
        (folder / "other.json").write_text("{}")
        found = trees.scan_results(spark, str(tmp_path / name)).collect()
        assert [(r["job"], r["engine"], r["step"]) for r in found] == [("job 1", "engine", "data-x")]


def test_no_stall_after_the_goal(spark):
    polls = spark.createDataFrame([("done", i * 60, 100) for i in range(20)] + [("stuck", i * 60, 40) for i in range(20)], "key string, s long, count long")
    polls = polls.withColumn("ts", F.timestamp_seconds("s"))
    found = streaks.stalled(polls, ["key"], ["ts"], "count", 600, goal=F.col("count") >= 100)
    assert [r["key"] for r in found.collect()] == ["stuck"]
    assert streaks.stalled(polls, ["key"], ["ts"], "count", 600).count() == 2


def test_times_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("20240101-000000",), ("20241301-000000",), ("x",), (None,), ("20240229-235959-run",)], "id string")
        found = [r[0] for r in rows.select(F.unix_seconds(run_ts("id"))).collect()]
        assert found == [1704067200, None, None, None, 1709251199]
        at = spark.range(1).select(F.timestamp_seconds(F.lit(1704067200)).alias("ts"))
        assert trees.by_month(at).collect()[0]["month"] == "2024.01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
