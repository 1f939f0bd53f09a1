import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from probeline.operators import streaks
from probeline.operators.telemetry import counter_delta
from probeline.operators.timeline import Timeline, chunked_lists, numbered


def hot_rows(seed, n=400):
    """Random rows where one key owns most of them and a burst shares a few times."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}"
        ts = 1000 + (rng.randrange(5) if rng.random() < 0.4 else rng.randrange(5000))
        out.append((key, ts, i, rng.choice([None, 0, 1, 1, 1, 2])))
    return out


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("seed, slices", [(1, 1), (2, 3), (3, 16)])
def test_previous_running_runs(spark, seed, slices):
    data = hot_rows(seed)
    df = spark.createDataFrame(data, "k string, ts bigint, id bigint, v int")
    line = Timeline(df, ["k"], ["ts", "id"], slices).previous({"p": "v"}, number="rn")
    line = line.running({"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).running({"b": ("max", F.col("v"))}, inclusive=False)
    got = {r["id"]: r for r in line.run_positions("v").result().collect()}
    assert len(got) == len(data)
    for group in by_key(data).values():
        total, high, run, prev = None, None, 0, None
        for n, (k, ts, i, v) in enumerate(group, 1):
            r = got[i]
            assert (r["rn"], r["p"], r["b"]) == (n, prev, high)
            if v is not None:
                total, high = (total or 0) + v, v if high is None else max(high, v)
            run = run + 1 if n > 1 and prev == v else 1
            assert (r["s"], r["m"], r["run_pos"]) == (total, high, run)
            prev = v


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([(None, 1)], "k string, ts bigint")
    with pytest.raises(Exception, match="timeline key"):
        Timeline(df, ["k"], ["ts"], 1).result().collect()


def test_numbered_and_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 2 == 0).cast("string").alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    assert numbered(df, ["k"], ["o"], "n", 7).filter(F.col("n") != F.floor(F.col("o") / 2) + 1).count() == 0
    chunks = chunked_lists(df, ["k"], ["o"], ["v"], 64, slices=7)
    found = chunks.orderBy("k", "chunk").collect()
    assert max(len(c["items"]) for c in found) == 64
    assert [x["v"] for c in found if c["k"] == "true" for x in c["items"]] == list(range(0, 1000, 2))


@pytest.mark.parametrize("slices", [1, 5])
def test_counter_delta(spark, slices):
    data = [("a", 1, 10), ("a", 2, 15), ("a", 3, 5), ("b", 1, None), ("b", 2, 7), ("a", 9, 6)]
    df = spark.createDataFrame(data, "node string, ts bigint, c bigint")
    got = counter_delta(df, ["node"], ["ts"], ["c"], slices).select("node", "ts", "c_delta")
    assert rows(got, "node", "ts") == [("a", 1, 0), ("a", 2, 5), ("a", 3, -10), ("a", 9, 1), ("b", 1, 0), ("b", 2, 7)]
    last = spark.createDataFrame([("a", 4)], "node string, c bigint")
    got = counter_delta(df, ["node"], ["ts"], ["c"], slices, last).select("node", "ts", "c_delta").filter("ts = 1")
    assert rows(got, "node") == [("a", 1, 6), ("b", 1, 0)]


def plain_stable(polls, expected, stable_for):
    last, runs = None, 0
    for ts, count in polls:
        if count is None:
            continue
        if count >= expected:
            return ts, count, "reached"
        runs = runs + 1 if count == last else 0
        if runs >= stable_for:
            return ts, count, "stable"
        last = count
    return None


@pytest.mark.parametrize(
    "counts, stop", [([4, 7, 7, 7, 7], (4, 7, "stable")), ([4, 10], (1, 10, "reached")), ([4, None, 4, 5], (3, 5, "open"))]
)
def test_first_stable_cases(spark, counts, stop):
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate(counts)], "k string, ts bigint, count bigint")
    df = df.withColumn("ts", F.timestamp_seconds("ts"))
    got = streaks.first_stable(df, ["k"], ["ts"], 10, slices=2).select(F.unix_seconds("ts"), "count", "outcome")
    assert rows(got) == [stop]


@pytest.mark.parametrize("seed", [5, 6])
def test_first_stable_random(spark, seed):
    rng = random.Random(seed)
    data = [(f"k{k}", i, rng.choice([None, 1, 1, 2, 2, 3] + ([9] if rng.random() < 0.1 else []))) for k in range(6) for i in range(40)]
    df = spark.createDataFrame(data, "k string, t bigint, count bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["k"]: r for r in streaks.first_stable(df, ["k"], ["ts"], 9, slices=4).withColumn("s", F.unix_seconds("ts")).collect()}
    for k in {d[0] for d in data}:
        want = plain_stable([(t, c) for kk, t, c in data if kk == k], 9, 3)
        if want:
            assert (got[k]["s"], got[k]["count"], got[k]["outcome"]) == want
        else:
            assert got[k]["outcome"] == "open"


def test_first_stable_deadline(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", 100, 2), ("k", 400, 10)], "k string, t bigint, count bigint")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    got = streaks.first_stable(df, ["k"], ["ts"], 10, deadline_s=300, slices=1).select("count", "outcome")
    assert rows(got) == [(2, "open")]


D, T, R = "down", "timeout", "ready"


@pytest.mark.parametrize(
    "states, kill",
    [([D] * 5, (4, "red")), ([D] * 4 + [R] + [D] * 4, None), ([D] * 4 + [T] + [D] * 4, None), ([T] * 60, (59, "busy")), ([T] * 59 + [R], None)],
)
def test_health_cases(spark, states, kill):
    df = spark.createDataFrame([("n", i, s) for i, s in enumerate(states)], "n string, ts bigint, state string")
    found = streaks.first_kill(streaks.health_streaks(df, ["n"], ["ts"], slices=3), ["n"], ["ts"])
    assert rows(found.select("ts", "reason")) == ([kill] if kill else [])


@pytest.mark.parametrize("seed", [7, 8])
def test_health_random(spark, seed):
    rng = random.Random(seed)
    data = [(f"n{rng.randrange(2)}", i, rng.choice([D, D, D, T, T, R])) for i in range(300)]
    df = spark.createDataFrame(data, "n string, ts bigint, state string")
    got = {r["ts"]: r for r in streaks.health_streaks(df, ["n"], ["ts"], slices=6).collect()}
    red, busy = {}, {}
    for n, i, s in data:
        red[n], busy[n] = {R: (0, 0), T: (0, busy.get(n, 0) + 1), D: (red.get(n, 0) + 1, 0)}[s]
        assert (got[i]["red_streak"], got[i]["busy_streak"]) == (red[n], busy[n])


def polls_of(spark, values, step=100):
    df = spark.createDataFrame([("n", i * step, v) for i, v in enumerate(values)], "n string, t bigint, v bigint")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def stall_at(found):
    return rows(found.select(F.unix_seconds("ts"), "value", "gave_up"))


def test_stalled_rise(spark):
    assert stall_at(streaks.stalled(polls_of(spark, [0, 1, 1, 2, 2, 2, 2, 2, 2, 2]), ["n"], ["ts"], "v", slices=3)) == [(900, 2, True)]
    assert stall_at(streaks.stalled(polls_of(spark, [1, 0, 2, 1, 3, 3]), ["n"], ["ts"], "v", slices=3)) == []
    assert stall_at(streaks.stalled(polls_of(spark, [0] * 7), ["n"], ["ts"], "v", slices=2)) == [(600, 0, True)]


def plain_fall(polls, limit):
    moved, last, retried = polls[0][0], 9999, None
    for t, v in polls:
        if v < last:
            moved = t
        last = v
        if t - moved >= limit:
            if retried is not None:
                return t, v, True
            retried, moved, last = (t, v), t, 9999
    return (*retried, False) if retried else None


@pytest.mark.parametrize("seed", range(4))
def test_stalled_fall(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([3, 3, 3, 3, 2]) for _ in range(30)]
    want = plain_fall([(i * 100, v) for i, v in enumerate(values)], 400)
    got = stall_at(streaks.stalled(polls_of(spark, values), ["n"], ["ts"], "v", 400, "fall", slices=4))
    assert got == ([want] if want else [])


def test_newly_failed(spark):
    data = [("s", 1, "running"), ("s", 2, "failed"), ("s", 3, "failed"), ("s", 4, "error"), ("r", 1, "failed"), ("r", 2, "queued")]
    df = spark.createDataFrame(data, "step string, ts bigint, status string")
    got = streaks.newly_failed(df, ["step"], ["ts"], slices=2).select("step", "ts", "previous_status")
    assert rows(got, "step", "ts") == [("r", 1, None), ("s", 2, "running"), ("s", 4, "failed")]
