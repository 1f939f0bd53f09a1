import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeline.operators import telemetry

T0 = dt.datetime(2023, 1, 1)
SWEEPS = "run long, node string, started_at timestamp, completed_at timestamp"


def at(s):
    return T0 + dt.timedelta(seconds=float(s))


@pytest.mark.parametrize("part_rows", [1, 1000])
def test_many_sweeps_meet_blocks(spark, monkeypatch, part_rows):
    monkeypatch.setattr(telemetry, "BLOCK", 16)
    rng = np.random.default_rng(3)
    seconds = [*rng.integers(0, 90 * 86400, 300).tolist(), *(40 * 86400 + rng.integers(0, 9, 300)).tolist()]  # a burst in nine seconds
    samples = [(i, f"n{i % 2}", at(s)) for i, s in enumerate(seconds)]
    samples += [samples[0], samples[0], (2000, None, at(5)), (2001, "n0", None), (2002, "other", at(5))]
    sweeps = [(j, f"n{j % 3}", at(b), at(b + rng.integers(0, 20 * 86400)) if j % 9 else None) for j, b in enumerate(rng.integers(0, 80 * 86400, 90))]
    sweeps += [sweeps[1], (100, "n0", at(40 * 86400 + 2), at(40 * 86400 + 2)), (101, "n1", at(60), at(0)), (102, None, at(0), None), (103, "n1", None, at(9))]
    sweeps += [(104, "n0", at(100 * 86400), None), (105, "n0", at(seconds[0]), at(seconds[0])), (106, "n0", at(-50), at(-1))]
    wanted = sorted(
        (j, i) for j, n, b, e in sweeps for i, m, t in samples
        if n == m and n is not None and None not in (t, b) and b <= t and (e is None or t <= e))
    left, right = spark.createDataFrame(samples, "id long, node string, ts timestamp").repartition(3), spark.createDataFrame(sweeps, SWEEPS)
    found = telemetry.samples_in_sweeps(left, right, ["node"], listed=80, part_rows=part_rows)
    assert "_place" in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r["run"], r["id"]) for r in found.select("run", "id").collect()) == wanted
    assert found.columns == telemetry.samples_in_sweeps(left, right, ["node"], listed=0).columns


def test_blocks_without_keys_or_samples(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "BLOCK", 4)
    samples = spark.range(60).select("id", F.timestamp_seconds(F.lit(1_672_531_200) + F.col("id")).alias("ts"))
    sweeps = spark.createDataFrame([(j, None, at(j), at(j + 5)) for j in range(70)], SWEEPS).drop("node")
    found = telemetry.samples_in_sweeps(samples, sweeps, listed=65, warmup_s=1)
    assert sorted((r["run"], r["id"]) for r in found.collect()) == [(j, i) for j in range(70) for i in range(j + 1, min(60, j + 6))]
    for keys in ([], ["run"]):
        assert telemetry.samples_in_sweeps(samples.limit(0).withColumn("run", F.col("id")), sweeps, keys, listed=9).count() == 0


def test_keys_of_too_many_blocks_meet_in_ranges(spark):
    samples = spark.range(200).select("id", F.col("id").cast("string").alias("node"), F.timestamp_seconds(F.lit(1_672_531_200) + F.col("id")).alias("ts"))
    sweeps = spark.createDataFrame([(j, str(j), at(j), None) for j in range(100)], SWEEPS)
    found = telemetry.samples_in_sweeps(samples, sweeps, ["node"], listed=50)
    assert sorted((r["run"], r["id"]) for r in found.collect()) == [(j, j) for j in range(100)]


def test_many_sweeps_are_kept_once(spark, monkeypatch):
    """A sweep is a row until it meets blocks; it was written once for each of its dyadic ranges."""
    written, kept = [], telemetry.kept

    def counted(rows, label):
        written.append((out := kept(rows, label)).count())
        return out

    monkeypatch.setattr(telemetry, "kept", counted)
    samples = spark.range(3000).select("id", F.timestamp_seconds(F.lit(1_672_531_200) + F.col("id") * 60).alias("ts"), F.lit("n").alias("node"))
    sweeps = spark.createDataFrame([(j, "n", at(j * 61 + 7), at(j * 61 + 86407)) for j in range(400)], SWEEPS)
    found = telemetry.samples_in_sweeps(samples, sweeps, ["node"], listed=300)
    assert found.count() == sum(j * 61 + 7 <= i * 60 <= j * 61 + 86407 for j in range(400) for i in range(3000))
    assert sum(written) <= 3000 + 400 + 100
