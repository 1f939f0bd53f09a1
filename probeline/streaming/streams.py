"""Streaming forms of the telemetry and ledger operators (ST1–ST7).

Windows and de-duplication use the built-in streaming operators. Deltas, watchdog and stability keep state per key with
timers (``keyed``). The ledger appends one folder per micro-batch, named by its id, so a replay after a failure overwrites
the same folder with the same rows; folders of committed micro-batches are merged in tiers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from probeline.functions.units import cpu_cores, mem_mib
from probeline.operators.ledger import TERMINAL, latest_by_key
from probeline.operators.streaks import BUSY_LIMIT, HARD_LIMIT_S, RED_LIMIT, STABLE_DEADLINE_S, STABLE_FOR, poll_kind
from probeline.operators.telemetry import flatten_node_stats
from probeline.sources.trees import by_month
from probeline.streaming import keyed

SAMPLE_INTERVAL = "10 seconds"
NO_DELAY = "0 seconds"
FAN = 10  # writes of a tier that become one of the next
KEEP_S = 7 * 86400  # silence after which an ended key is forgotten
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run all available data once, or go on with a micro-batch ``every`` interval."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_snapshots(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Node statistics documents as they arrive: one JSON object per line with ``ts`` and ``nodes``."""
    reader = spark.readStream.schema("ts TIMESTAMP, nodes STRING").option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_samples(snapshots: DataFrame, sink: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """ST1: documents to flat node rows in the monthly telemetry sink."""
    rows = by_month(flatten_node_stats(snapshots))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("month")
    return start(writer.option("path", f"{sink.rstrip('/')}/telemetry"), checkpoint, every)


def windowed_usage(samples: DataFrame, interval: str = SAMPLE_INTERVAL, delay: str = "1 minute", keys: Sequence[str] = ("node",)) -> DataFrame:
    """ST2: the usage summary of A1 per tumbling window; a window is emitted once the watermark has passed its end."""
    read = samples.select(*keys, F.col("ts").cast("timestamp").alias("ts"), cpu_cores("cpu").alias("_c"), mem_mib("memory").alias("_m"))
    grouped = read.withWatermark("ts", delay).groupBy(F.window("ts", interval), *keys)
    summary = grouped.agg(
        *[
            how(source).alias(f"{label}_{suffix}")
            for label, source in (("cpu", "_c"), ("memory", "_m"))
            for suffix, how in (("avg", F.avg), ("max", F.max), ("min", F.min))
        ],
        F.count(F.lit(1)).alias("samples"),
    )
    return summary.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in summary.columns if c != "window"])


def _start_keyed(found: DataFrame, folder: str, checkpoint: str, every: str | None) -> StreamingQuery:
    """Start a stream with keyed state; its rows go below ``folder``. The state store is set for this query alone."""
    conf = found.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKS)
    try:
        return start(found.writeStream.format("parquet").option("path", f"{folder.rstrip('/')}/output").outputMode("append"), checkpoint, every)
    finally:
        conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that a keyed stream has put out so far, each once."""
    return spark.read.parquet(f"{folder.rstrip('/')}/output")


def stream_counter_delta(
    samples: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str], folder: str, checkpoint: str,
    every: str | None = None, ttl_s: float | None = None,
) -> StreamingQuery:
    """ST3: W1 over a stream; the state is the last counters per key, forgotten after ``ttl_s`` without a row."""
    return _start_keyed(keyed.deltas(samples, keys, order, counters, ttl_s), folder, checkpoint, every)


def stream_watchdog(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str, checkpoint: str, red: int = RED_LIMIT,
    busy: int = BUSY_LIMIT, limit_s: float = HARD_LIMIT_S, every: str | None = None, delay: str = NO_DELAY, keep_s: float = KEEP_S,
) -> StreamingQuery:
    """ST4: one row per key when W9 acts or the hard limit since its first poll is over; ``order[0]`` is the poll time.

    The limit is a timer on the poll times of all keys, so a key that has gone silent is ended as well. Polls more than
    ``delay`` behind the latest one of all keys are late.
    """
    worker = keyed.Watchdog(keys, len(order), int(limit_s * keyed.MICROS), keep_s, red, busy)
    found = keyed.endings(polls, keys, order, poll_kind(F.col("state")).alias("_kind"), worker, "reason string", delay)
    return _start_keyed(found, folder, checkpoint, every)


def stream_stability(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], expected: int, folder: str, checkpoint: str,
    stable_for: int = STABLE_FOR, deadline_s: float = STABLE_DEADLINE_S, every: str | None = None, delay: str = NO_DELAY,
    keep_s: float = KEEP_S,
) -> StreamingQuery:
    """ST5: one row per key when W8 stops: ``reached``, ``stable`` or, past the deadline, ``timed out`` with the last count.

    As in ST4 the deadline is a timer on the poll times of all keys.
    """
    worker = keyed.Stability(keys, len(order), int(deadline_s * keyed.MICROS), keep_s, expected, stable_for)
    found = keyed.endings(polls, keys, order, F.col("count").cast("bigint").alias("_count"), worker, "count bigint, outcome string", delay)
    return _start_keyed(found, folder, checkpoint, every)


def stream_newly_terminal(events: DataFrame, keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """ST6: one terminal event per step, however late a repeat comes.

    The keys that were put out stay in the state store; a micro-batch reads and writes those of its own rows only.
    """
    return events.filter(F.col("status").isin(*TERMINAL)).dropDuplicates(list(keys))


def stream_ledger(
    events: DataFrame, keys: Sequence[str], seq: str, folder: str, checkpoint: str, every: str | None = None,
    heartbeat: str | None = None, fan: int = FAN,
) -> StreamingQuery:
    """ST7: ledger writes from events. Each micro-batch is cut to its last write per key and appended.

    ``read_ledger`` gives the current rows. Writes are merged in tiers as the stream goes on: ``fan`` neighbouring ones of a
    size become one, so there are fewer than ``fan`` per tier to read, and a row is rewritten once per tier. ``heartbeat``
    names the column whose latest time per key is kept as well.
    """
    folder = folder.rstrip("/")

    def step(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, keys, seq).write.mode("overwrite").parquet(f"{folder}/writes/batch={batch_id}")
        if batch_id % fan == fan - 1:
            compact_writes(batch.sparkSession, folder, keys, seq, batch_id, heartbeat, fan)

    return start(events.writeStream.foreachBatch(step), checkpoint, every)


def compact_writes(
    spark: SparkSession, folder: str, keys: Sequence[str], seq: str, below: int, heartbeat: str | None = None, fan: int = FAN
) -> None:
    """Merge the writes of micro-batches before ``below`` (all committed) tier by tier, and remove those merged earlier.

    A merged write is complete before it gets its name, and what it stands for goes only at the next call, so a reader that
    has listed either finds its files. Reading both gives the same ledger, because a key's last write counts once.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = files.Path(f"{folder.rstrip('/')}/writes")
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spans = {}
    for found in store.listStatus(base):
        name = found.getPath().getName()
        if name.startswith("batch="):
            low, _, high = name.removeprefix("batch=").partition("-")
            spans[int(low), int(high or low)] = name
    inner = {x for x in spans if any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in spans)}
    for x in inner:
        store.delete(files.Path(base, spans.pop(x)), True)
    size = 1
    while size <= below:
        for low in range(0, below - fan * size + 1, fan * size):
            mine = [spans.get((x, x + size - 1)) for x in range(low, low + fan * size, size)]
            if None in mine:
                continue
            rows = spark.read.parquet(*[f"{base.toString()}/{name}" for name in mine])
            merged = latest_by_key(rows, keys, seq)
            if heartbeat is not None:
                merged = merged.unionByName(latest_by_key(rows.filter(F.col(heartbeat).isNotNull()), keys, heartbeat))
            high = low + fan * size - 1
            merged.write.mode("overwrite").parquet(f"{base.toString()}/_merge-{low}-{high}")
            store.rename(files.Path(base, f"_merge-{low}-{high}"), files.Path(base, f"batch={low}-{high}"))
            spans[low, high] = f"batch={low}-{high}"
        size *= fan


def read_ledger(spark: SparkSession, folder: str, keys: Sequence[str], seq: str, heartbeat: str | None = None) -> DataFrame:
    """The ledger: the last write per key, with the latest ``heartbeat`` time of all writes as ``last_heartbeat_at``."""
    writes = spark.read.parquet(f"{folder.rstrip('/')}/writes").drop("batch")
    current = latest_by_key(writes, keys, seq)
    if heartbeat is None:
        return current
    beats = writes.groupBy(*keys).agg(F.max(heartbeat).alias("last_heartbeat_at"))
    return current.join(beats, list(keys))
