import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from probeline.streaming import keyed, streams

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes a micro-batch of rows and runs a stream over what is new."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, checkpoint, folder = (str(tmp_path / x) for x in ("source", "checkpoint", "found"))

    def push(rows, schema, run):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run(spark.readStream.schema(schema).parquet(source), folder, checkpoint).awaitTermination()
        return streams.read_output(spark, folder)

    push.source = source
    yield push
    spark.conf.set("spark.sql.shuffle.partitions", before)


POLLS = "node string, ts timestamp, seq long, state string"


def watch(stream, folder, checkpoint, **more):
    settings = {"red": 2, "busy": 3, "limit_s": 1000, "keep_s": 500} | more
    return streams.stream_watchdog(stream, ["node"], ["ts", "seq"], folder, checkpoint, **settings)


def ended(found):
    return sorted((r["node"], (r["ts"] - T0).total_seconds(), r["reason"]) for r in found.collect())


def test_watchdog_over_batches_with_late_and_silent_keys(spark, feed):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [("a", at(0), 1, "down"), ("b", at(0), 2, "timeout"), ("c", at(1), 3, "ready"), ("d", at(2), 4, "down"), ("n", None, 5, "down")]
    assert ended(feed(rows, POLLS, lambda s, f, c: watch(s, f, c, delay="100 seconds"))) == []
    # a: second failure. b: a ready poll between timeouts, and a row of an earlier place comes late and changes nothing.
    rows = [("a", at(50), 6, "down"), ("b", at(60), 7, "timeout"), ("b", at(61), 8, "ready"), ("d", at(70), 9, "ready")]
    assert ended(feed(rows, POLLS, lambda s, f, c: watch(s, f, c, delay="100 seconds"))) == [("a", 50, "red")]
    rows = [("b", at(59), 10, "timeout"), ("b", at(62), 11, "timeout"), ("b", at(63), 12, "timeout"), ("a", at(80), 13, "down"), ("a", at(81), 14, "down")]
    assert ended(feed(rows, POLLS, lambda s, f, c: watch(s, f, c, delay="100 seconds"))) == [("a", 50, "red")]
    # c is silent: the polls of others pass its limit. d and b are over as well.
    rows = [("x", at(1200), 15, "ready")]
    found = ended(feed(rows, POLLS, lambda s, f, c: watch(s, f, c, delay="100 seconds")))
    assert found == [("a", 50, "red"), ("b", 1000, "limit"), ("c", 1001, "limit"), ("d", 1002, "limit")]
    # After 500 silent seconds an ended key is forgotten and watched anew; before, it stays ended.
    rows = [("a", at(2000), 16, "down"), ("a", at(2001), 17, "down"), ("c", at(1300), 18, "down"), ("c", at(1301), 19, "down")]
    found = ended(feed(rows, POLLS, lambda s, f, c: watch(s, f, c, delay="100 seconds")))
    assert found[0] == ("a", 50, "red") and ("a", 2001, "red") in found and len([r for r in found if r[0] == "c"]) == 1


def test_failed_batch_runs_again(spark, feed, tmp_path):
    run = lambda s, f, c: watch(s, f, c)
    feed([("a", at(0), 1, "down"), ("b", at(0), 2, "down")], POLLS, run)
    broken = tmp_path / "source" / "part-broken.parquet"
    broken.write_bytes(b"PAR1 not a table PAR1")
    with pytest.raises(Exception):
        feed([("a", at(10), 3, "down"), ("b", at(10), 4, "ready")], POLLS, run)
    spark.createDataFrame([("b", at(11), 5, "down")], POLLS).coalesce(1).write.parquet(str(tmp_path / "good"))
    broken.write_bytes(next((tmp_path / "good").glob("part-*.parquet")).read_bytes())  # what the writer meant to put there
    for crc in (tmp_path / "source").glob(".part-broken*"):
        crc.unlink()
    assert ended(feed([], POLLS, run)) == [("a", 10, "red")]
    assert ended(feed([("b", at(12), 6, "down")], POLLS, run)) == [("a", 10, "red"), ("b", 12, "red")]


def test_stability(spark, feed):
    kind = "node string, ts timestamp, seq long, count long"
    run = lambda s, f, c: streams.stream_stability(s, ["node"], ["ts", "seq"], 100, f, c, stable_for=2, deadline_s=300)
    read = lambda found: sorted((r["node"], (r["ts"] - T0).total_seconds(), r["count"], r["outcome"]) for r in found.collect())
    feed([("a", at(0), 1, 5), ("a", at(1), 2, 5), ("b", at(0), 3, None), ("c", at(0), 4, 100), ("d", at(0), 5, None)], kind, run)
    feed([("a", at(2), 6, None), ("a", at(3), 7, 5), ("b", at(2), 8, 7), ("b", at(4), 9, 8), ("c", at(5), 10, 100)], kind, run)
    found = read(feed([("z", at(301), 11, 1)], kind, run))
    assert found == [("a", 3, 5, "stable"), ("b", 300, 8, "timed out"), ("c", 0, 100, "reached"), ("d", 300, None, "timed out")]


def test_deltas(spark, feed):
    kind = "node string, ts timestamp, seq long, hits long, name string"
    run = lambda s, f, c: streams.stream_counter_delta(s, ["node"], ["ts", "seq"], ["hits"], f, c)
    feed([("a", at(2), 2, 30, "x"), ("a", at(1), 1, 10, "x"), ("b", at(0), 1, (1 << 60) + 1, "y")], kind, run)
    found = feed([("a", at(3), 3, None, "x"), ("a", at(4), 4, 5, "x"), ("a", at(1), 0, 99, "late"), ("b", at(1), 2, (1 << 60) + 4, "y")], kind, run)
    got = sorted((r["node"], (r["ts"] - T0).total_seconds(), r["seq"], r["hits_delta"]) for r in found.collect())
    assert got == [("a", 1, 0, None), ("a", 1, 1, 0), ("a", 2, 2, 20), ("a", 3, 3, -30), ("a", 4, 4, 5), ("b", 0, 1, 0), ("b", 1, 2, 3)]


def test_ledger_reads_the_last_write(spark, feed):
    kind = "run long, seq long, beat timestamp"
    run = lambda s, f, c: streams.stream_ledger(s, ["run"], "seq", f, c)
    def push(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(feed.source)
        folder = str(pathlib.Path(feed.source).parent / "ledger")
        run(spark.readStream.schema(kind).parquet(feed.source), folder, folder + "-checkpoint").awaitTermination()
        return streams.read_ledger(spark, folder, ["run"], "seq", "beat")

    push([(1, 1, at(0)), (2, 5, at(9))])
    found = push([(1, 2, at(3)), (2, 4, at(10))])
    assert sorted((r["run"], r["seq"], (r["last_heartbeat_at"] - T0).total_seconds()) for r in found.select("run", "seq", F.col("last_heartbeat_at")).collect()) == [(1, 2, 3), (2, 5, 10)]


def test_ledger_writes_are_merged_in_tiers(spark, feed, tmp_path):
    kind = "run long, seq long, beat timestamp"
    rows = [(i % 5, i, at(100 - i if i % 2 else i)) for i in range(29)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").parquet(feed.source)
    folder = str(tmp_path / "ledger")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(feed.source)
    streams.stream_ledger(stream, ["run"], "seq", folder, folder + "-checkpoint", heartbeat="beat", fan=3).awaitTermination()
    names = sorted(x.name for x in (tmp_path / "ledger" / "writes").glob("batch=*"))
    assert "batch=0-8" in names and "batch=9-17" in names and "batch=0" not in names and "batch=0-2" not in names and len(names) <= 12
    found = streams.read_ledger(spark, folder, ["run"], "seq", "beat").collect()
    wanted = {k: (max(s for r, s, _ in rows if r == k), max(b for r, _, b in rows if r == k)) for k in range(5)}
    assert {r["run"]: (r["seq"], r["last_heartbeat_at"]) for r in found} == wanted
    streams.compact_writes(spark, folder, ["run"], "seq", 27, "beat", 3)  # again: nothing is lost
    found = streams.read_ledger(spark, folder, ["run"], "seq", "beat").collect()
    assert {r["run"]: (r["seq"], r["last_heartbeat_at"]) for r in found} == wanted


def test_rows_of_a_key_beyond_memory_are_sorted_on_disk():
    from pyspark.sql import Row

    made = Row("node", "_o0", "_o1", "_kind")
    seen = []

    def rows(n):
        for i in range(n):
            if i % 50_000 == 0:
                seen.append(keyed_memory())
            yield made("a", i * 7919 % n, None if i % 3 else i, "ready" if i % 2 else "down")

    from pyspark.shuffle import get_used_memory as keyed_memory

    before, n = keyed_memory(), 600_000
    keyed.SORT_MB, kept = before + 40, keyed.SORT_MB
    try:
        found = keyed._sorted(rows(n), 2, ["_kind"])
        assert [x[0] for x in found] == list(range(n))
    finally:
        keyed.SORT_MB = kept
    assert max(seen) - before < 120
    tied = [made("a", 1, 5, "x"), made("a", 1, None, "y"), made("a", 0, 9, "z")]
    assert [x[2] for x in keyed._sorted(iter(tied), 2, ["_kind"])] == ["z", "y", "x"]
