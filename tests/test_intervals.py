import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeline.operators import telemetry

T0 = dt.datetime(2023, 1, 1)


@pytest.mark.parametrize(("a", "b"), [(0, 1), (5, 6), (5, 5), (7, 9), (0, 1 << 20), (1, (1 << 20) - 1), (28_000_000, 28_525_600), (-9, 12)])
def test_ranges_cover_a_span_once(spark, a, b):
    found = spark.createDataFrame([(a, b)], "_a long, _b long").select(F.explode(F.expr(telemetry._RANGES)).alias("r")).select("r.*").collect()
    spans = sorted((r["pos"] << r["level"], (r["pos"] + 1) << r["level"]) for r in found)
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and len(spans) <= 42
    assert (not spans and a == b) or (spans[0][0], spans[-1][1]) == (a, b)


@pytest.mark.parametrize("listed", [0, 1 << 17])
def test_long_sweeps_and_a_burst(spark, listed):
    rng = np.random.default_rng(2)
    at = lambda s: T0 + dt.timedelta(seconds=float(s))
    seconds = [*rng.integers(0, 400 * 86400, 300).tolist(), *(100 * 86400 + rng.integers(0, 30, 700)).tolist()]  # a burst in one minute
    samples = [(i, f"n{i % 2}", at(s)) for i, s in enumerate(seconds)] + [(2000, None, at(5)), (2001, "n0", None)]
    begins = rng.integers(0, 300 * 86400, 40).tolist()
    sweeps = [(j, f"n{j % 3}", at(b), at(b + 365 * 86400) if j % 4 else None) for j, b in enumerate(begins)]
    sweeps += [(50, "n0", at(100 * 86400 + 5), at(100 * 86400 + 9)), (51, "n1", at(60), at(0)), (52, "n1", at(seconds[1]), at(seconds[1]))]
    wanted = sorted(
        (j, i) for j, n, b, e in sweeps for i, m, t in samples if n == m and t is not None and b <= t and (e is None or t <= e))
    found = telemetry.samples_in_sweeps(
        spark.createDataFrame(samples, "id long, node string, ts timestamp").repartition(3),
        spark.createDataFrame(sweeps, "run long, node string, started_at timestamp, completed_at timestamp"), ["node"], listed=listed, part_rows=50)
    assert sorted((r["run"], r["id"]) for r in found.select("run", "id").collect()) == wanted


def test_no_samples_or_sweeps(spark):
    samples = spark.createDataFrame([], "id long, ts timestamp")
    sweeps = spark.createDataFrame([(1, T0, None)], "run long, started_at timestamp, completed_at timestamp")
    assert telemetry.samples_in_sweeps(samples, sweeps).count() == 0
    assert telemetry.samples_in_sweeps(spark.createDataFrame([(1, T0)], "id long, ts timestamp"), sweeps.limit(0)).count() == 0


def test_many_ranges_are_not_broadcast(spark):
    samples = spark.range(3000).select(F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.lit("n").alias("node"))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600)
    sweeps = spark.range(300).select(F.col("id").alias("run"), F.lit("n").alias("node"), start.alias("started_at"), (start + F.expr("interval 1 hour")).alias("completed_at"))
    found = telemetry.samples_in_sweeps(samples, sweeps, ["node"], listed=0)
    assert found.count() == sum(61 if r * 10 + 60 < 3000 else max(0, 3000 - r * 10) for r in range(300))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" in found._jdf.queryExecution().sparkPlan().toString() and plan.count("strategy=merge") >= 1
