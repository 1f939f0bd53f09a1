"""Node, pod and index statistics: flattening, deltas, summaries, pools, interval join."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeline.functions.units import cpu_cores, cpu_millicores, mem_kib, mem_mib
from probeline.operators.timeline import ROWS_PER_SLICE, Timeline, chunked_lists
from probeline.session import kept, parallelism

# The field names of the node statistics document.
NODE_STATS = """
MAP<STRING, STRUCT<
  name: STRING,
  jvm: STRUCT<
    mem: STRUCT<heap_used_percent: DOUBLE, heap_used_in_bytes: BIGINT, heap_max_in_bytes: BIGINT>,
    gc: STRUCT<collectors: STRUCT<
      young: STRUCT<collection_count: BIGINT, collection_time_in_millis: BIGINT>,
      old: STRUCT<collection_count: BIGINT, collection_time_in_millis: BIGINT>>>>,
  os: STRUCT<cpu: STRUCT<percent: DOUBLE, load_average: STRUCT<`1m`: DOUBLE>>, mem: STRUCT<used_percent: DOUBLE>>,
  indices: STRUCT<
    search: STRUCT<query_total: BIGINT, query_time_in_millis: BIGINT, fetch_total: BIGINT>,
    indexing: STRUCT<index_total: BIGINT, index_time_in_millis: BIGINT>>,
  thread_pool: STRUCT<
    search: STRUCT<queue: BIGINT, rejected: BIGINT>,
    write: STRUCT<queue: BIGINT, rejected: BIGINT>>,
  fs: STRUCT<total: STRUCT<total_in_bytes: BIGINT, free_in_bytes: BIGINT>>>>
"""
UNKNOWN_POOL = "unknown"
SYSTEM_NAMESPACE = "kube-system"

_MB = 1048576.0


def _whole_mb(path: str) -> Column:
    return F.round(F.coalesce(F.col(path), F.lit(0)) / _MB, 0).cast("bigint")


def flatten_node_stats(snapshots: DataFrame, document: str = "nodes", ts: str = "ts", whole: bool = False) -> DataFrame:
    """One flat row per node of a node statistics document; a missing value is null, a missing name the node id.

    ``document`` holds the JSON text of the node map. Other columns of ``snapshots`` are kept. ``whole`` adds what only
    snapshots that are compared need: the heap in MB to one decimal, fetches and both queues.
    """
    kept = [c for c in snapshots.columns if c not in (document, ts)]
    nodes = snapshots.select(
        *kept, ts, F.explode(F.from_json(document, NODE_STATS)).alias("node_id", "n")
    )
    young, old = "n.jvm.gc.collectors.young", "n.jvm.gc.collectors.old"
    return nodes.select(
        *kept,
        ts,
        "node_id",
        F.coalesce("n.name", "node_id").alias("node"),
        F.col("n.jvm.mem.heap_used_percent").alias("heap_used_pct"),
        _whole_mb("n.jvm.mem.heap_used_in_bytes").alias("heap_used_mb"),
        _whole_mb("n.jvm.mem.heap_max_in_bytes").alias("heap_max_mb"),
        F.col(f"{young}.collection_count").alias("gc_young_count"),
        F.col(f"{young}.collection_time_in_millis").alias("gc_young_ms"),
        F.col(f"{old}.collection_count").alias("gc_old_count"),
        F.col(f"{old}.collection_time_in_millis").alias("gc_old_ms"),
        F.col("n.os.cpu.percent").alias("cpu_pct"),
        F.col("n.os.cpu.load_average.1m").alias("load_1m"),
        F.col("n.os.mem.used_percent").alias("mem_used_pct"),
        F.col("n.indices.search.query_total").alias("search_query_total"),
        F.col("n.indices.search.query_time_in_millis").alias("search_query_ms"),
        F.col("n.indices.indexing.index_total").alias("indexing_total"),
        F.col("n.indices.indexing.index_time_in_millis").alias("indexing_ms"),
        F.col("n.thread_pool.search.rejected").alias("search_rejected"),
        F.col("n.thread_pool.write.rejected").alias("write_rejected"),
        F.col("n.fs.total.total_in_bytes").alias("fs_total_bytes"),
        F.col("n.fs.total.free_in_bytes").alias("fs_free_bytes"),
        *(
            [
                heap_mb(F.col("n.jvm.mem.heap_used_in_bytes")).alias("heap_mb"),
                F.col("n.indices.search.fetch_total").alias("search_fetch_total"),
                F.col("n.thread_pool.search.queue").alias("search_queue"),
                F.col("n.thread_pool.write.queue").alias("write_queue"),
            ]
            if whole
            else []
        ),
    )


def heap_mb(used_bytes: Column) -> Column:
    """Heap in MB to one decimal, halves to the even neighbour, missing counts as 0."""
    return F.bround(F.coalesce(used_bytes, F.lit(0)) / _MB, 1)


def counter_delta(
    samples: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str], slices: int | None = None,
    last: DataFrame | None = None,
) -> DataFrame:
    """``<counter>_delta`` against the previous sample of the key.

    The first sample gives 0, a missing counter counts as 0, and a counter reset shows as a negative delta. ``last``
    holds the last known counters of keys from earlier data (keys and counters); for those the first sample is a
    delta as well.
    """
    line = Timeline(samples, keys, order, slices).previous({f"_p_{c}": c for c in counters}, number="_rn")
    df = line.result().withColumn("_first", F.col("_rn") == 1)
    if last is not None:
        known = last.select(*keys, F.struct(*counters).alias("_known"))
        df = df.join(known, list(keys), "left")
        for c in counters:
            df = df.withColumn(f"_p_{c}", F.when(F.col("_first"), F.col("_known")[c]).otherwise(F.col(f"_p_{c}")))
        df = df.withColumn("_first", F.col("_first") & F.col("_known").isNull()).drop("_known")
    for c in counters:
        step = F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_p_{c}"), F.lit(0))
        df = df.withColumn(f"{c}_delta", F.when(F.col("_first"), step - step).otherwise(step))
    return df.drop("_rn", "_first", *[f"_p_{c}" for c in counters])


def diff_snapshots(
    before: DataFrame, after: DataFrame, keys: Sequence[str], counters: Sequence[str], gauges: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """After minus before per counter, gauges from after. Without a before the delta is the after value itself.

    Rows that exist only in ``before`` drop out. ``name`` is a display column of ``after``.
    """
    old = before.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in counters])
    joined = after.join(old, list(keys), "left")
    shown = [F.coalesce(F.col(name), F.col(keys[-1]).cast("string")).alias(name)] if name else []
    return joined.select(
        *keys,
        *shown,
        *[F.coalesce(F.col(c) - F.col(f"_b_{c}"), F.col(c)).alias(f"{c}_delta") for c in counters],
        *gauges,
    )


# The fields of a snapshot comparison and the flat columns they come from; counters, then gauges.
DIFF_COUNTERS = {
    "gc_young_count_delta": "gc_young_count", "gc_young_time_ms_delta": "gc_young_ms",
    "gc_old_count_delta": "gc_old_count", "gc_old_time_ms_delta": "gc_old_ms",
    "search_query_count_delta": "search_query_total", "search_query_time_ms_delta": "search_query_ms",
    "search_fetch_count_delta": "search_fetch_total", "indexing_count_delta": "indexing_total",
    "indexing_time_ms_delta": "indexing_ms", "search_rejected": "search_rejected", "write_rejected": "write_rejected",
}
DIFF_GAUGES = {
    "heap_used_percent": "heap_used_pct", "heap_used_mb": "heap_mb", "cpu_percent": "cpu_pct", "load_1m": "load_1m",
    "mem_used_percent": "mem_used_pct", "search_queue": "search_queue", "write_queue": "write_queue",
}


def diff_node_stats(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """J6 in full: ``keys``, ``node`` and the 18 fields, of two tables that ``flatten_node_stats`` made whole."""
    found = diff_snapshots(before, after, keys, list(DIFF_COUNTERS.values()), list(DIFF_GAUGES.values()), "node")
    return found.select(
        *keys, "node", *[F.col(f"{source}_delta").alias(name) for name, source in DIFF_COUNTERS.items()],
        *[F.col(source).alias(name) for name, source in DIFF_GAUGES.items()],
    )


def gc_samples(flat: DataFrame, ts: str = "ts", node: str = "node", slices: int | None = None) -> DataFrame:
    """W1 on collector counters: one sample per row of a whole flat table, with deltas to the node's sample before.

    The first sample of a node gives 0, a missing counter counts as 0.
    """
    counters = {"young_count": "gc_young_count", "young_ms": "gc_young_ms", "old_count": "gc_old_count", "old_ms": "gc_old_ms"}
    rows = counter_delta(flat, [node], [ts], list(counters.values()), slices)
    return rows.select(
        ts, node, "heap_used_pct", F.col("heap_mb").alias("heap_used_mb"),
        *[F.col(f"{source}_delta").alias(f"{name}_delta") for name, source in counters.items()],
    )


def node_usage_summary(samples: DataFrame, keys: Sequence[str] = ("node",), cpu: str = "cpu", memory: str = "memory") -> DataFrame:
    """A1: average, maximum and minimum of cores and MiB per node, from quantity text."""
    read = samples.select(*keys, cpu_cores(cpu).alias("_c"), mem_mib(memory).alias("_m"))
    return read.groupBy(*keys).agg(
        *[
            F.coalesce(how(source), F.lit(0.0)).alias(f"{label}_{suffix}")
            for label, source in (("cpu", "_c"), ("memory", "_m"))
            for suffix, how in (("avg", F.avg), ("max", F.max), ("min", F.min))
        ]
    )


def usage_with_pool(usage: DataFrame, nodes: DataFrame) -> DataFrame:
    """Usage of all measured and all known nodes; no pool shows as unknown, no usage as 0."""
    joined = usage.join(nodes.select("node", "node_pool"), "node", "full_outer")
    measures = [c for c in usage.columns if c != "node"]
    return joined.select(
        "node",
        F.coalesce("node_pool", F.lit(UNKNOWN_POOL)).alias("node_pool"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in measures],
    )


def pod_usage(containers: DataFrame, keys: Sequence[str] = ("pod", "ts"), cpu: str = "cpu", memory: str = "memory") -> DataFrame:
    """A2: containers of a pod summed per sample, shown as ``<n>m`` and ``<n>Mi``."""
    summed = containers.groupBy(*keys).agg(
        F.coalesce(F.sum(cpu_millicores(F.col(cpu))), F.lit(0)).alias("_c"),
        F.coalesce(F.sum(mem_kib(F.col(memory))), F.lit(0)).alias("_k"),
    )
    return summed.select(
        *keys,
        F.concat(F.col("_c").cast("string"), F.lit("m")).alias("cpu_sample"),
        F.concat((F.col("_k") / 1024.0).cast("bigint").cast("string"), F.lit("Mi")).alias("memory_sample"),
    )


def pod_series(usage: DataFrame, keys: Sequence[str] = ("pod",), ts: str = "ts", chunk_rows: int = 1000) -> DataFrame:
    """A3: ordered sample lists per pod in numbered chunks (a pod's whole history never meets in one task)."""
    packed = chunked_lists(usage, keys, [ts], ["cpu_sample", "memory_sample"], chunk_rows)
    return packed.select(
        *keys,
        "chunk",
        F.transform("items", lambda x: x["cpu_sample"]).alias("cpu_samples"),
        F.transform("items", lambda x: x["memory_sample"]).alias("memory_samples"),
    )


def payload_header(samples: DataFrame, by: Sequence[str] = ("scenario", "namespace"), ts: str = "ts") -> DataFrame:
    """Start, end, duration and number of sampling ticks per scenario."""
    head = samples.groupBy(*by).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.countDistinct(ts).alias("total_samples")
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("end_time") - micros("start_time")) / 1_000_000.0
    return head.withColumn("duration_seconds", seconds)


def pods_by_pool(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """User pods with the pool of their node; system pods are left out."""
    user = pods.filter(F.col("namespace") != SYSTEM_NAMESPACE)
    joined = user.join(nodes.select("node", "node_pool"), "node", "left")
    return joined.withColumn("node_pool", F.coalesce("node_pool", F.lit(UNKNOWN_POOL)))


def pods_per_pool(placed: DataFrame) -> DataFrame:
    """Number of pods per pool."""
    return placed.groupBy("node_pool").agg(F.count(F.lit(1)).alias("pods"))


def usage_per_pool(usage: DataFrame) -> DataFrame:
    """Node count and summed average usage per pool."""
    return usage.groupBy("node_pool").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("cpu_avg").alias("cpu"), F.sum("memory_avg").alias("memory")
    )


def pods_per_namespace(pods: DataFrame) -> DataFrame:
    """Running and total pods per namespace."""
    return pods.groupBy("namespace").agg(
        F.count_if(F.col("status") == "Running").alias("running"), F.count(F.lit(1)).alias("total")
    )


LISTED = 1 << 17  # rows of a table that are broadcast at most
PAIRS = 100  # pairs per sample that a part of a range makes about at most
#: A span of whole units ``_a`` up to ``_b`` (exclusive) as disjoint ranges of ``2 ** level`` units, numbered by position:
#: the borders of each level are the span's, rounded inwards, and an odd border leaves one range behind.
_RANGES = """
filter(flatten(transform(sequence(0, 40), h -> array(
  if(-shiftright(-_a, h) < shiftright(_b, h) and -shiftright(-_a, h) % 2 <> 0, struct(h as level, -shiftright(-_a, h) as pos), null),
  if(-shiftright(-_a, h) < shiftright(_b, h) and shiftright(_b, h) % 2 <> 0, struct(h as level, shiftright(_b, h) - 1 as pos), null)
))), x -> x is not null)"""

BLOCK = 1 << 10  # samples of a block at least
TASKS = 1 << 13  # tasks of a join at most


def _first_from(values: np.ndarray, begin: np.ndarray, stop: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row the first position from ``begin`` up to ``stop`` (exclusive) whose value is ``wanted`` at least, else ``stop``."""
    low, high = begin.copy(), stop.copy()
    while (going := low < high).any():
        middle = (low + high) >> 1
        less = going & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(going & ~less, middle, high)
    return low


def _touched(lows: np.ndarray, highs: np.ndarray):
    """From the blocks of a key and a span to the blocks ``a`` up to ``b`` (exclusive) that hold samples of the span, if any do."""

    @F.arrow_udf("a bigint, b bigint")
    def touched(begin: pa.Array, stop: pa.Array, since: pa.Array, until: pa.Array) -> pa.Array:
        begin, stop, since, until = (x.to_numpy(zero_copy_only=False) for x in (begin, stop, since, until))
        found = _first_from(highs, begin, stop, since), _first_from(lows, begin, stop, until + 1)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return touched


def _by_blocks(left: DataFrame, right: DataFrame, held: int, keys: Sequence[str], listed: int, part_rows: int) -> DataFrame | None:
    """Candidate pairs by blocks of the ``held`` samples; None if there are more than ``listed`` blocks."""
    size = max(BLOCK, 1 << (2 * held // max(listed, 1)).bit_length())
    values, others = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    order = [*keys, "_at", "_tie"]
    rows = left.dropna(subset=["_at", *keys]).withColumn("_tie", F.xxhash64(*[c for c in left.columns if c != "_at"]))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    rows = kept(rows.withColumn("_block", F.floor(F.monotonically_increasing_id() / size)), "samples")
    blocks = rows.groupBy(*keys, "_block").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    if blocks.count() > listed:
        return None
    place = F.row_number().over(Window.orderBy(*keys, "_first", "_last", "_block")).cast("bigint") - 1
    blocks = kept(blocks.withColumn("_place", place), "blocks")
    borders = blocks.orderBy("_place").select("_first", "_last").toArrow()
    touched = _touched(*(borders.column(c).to_numpy() for c in ("_first", "_last")))
    of_key = F.broadcast(blocks.groupBy(*keys).agg(F.min("_place").alias("_begin"), (F.max("_place") + 1).alias("_stop")).dropna())
    spans = right.join(of_key, [*keys]) if keys else right.crossJoin(of_key)
    spans = spans.withColumn("_touched", touched("_begin", "_stop", "_from", "_to"))
    spans = kept(spans.select(*others, F.col("_touched.a").alias("_a"), F.col("_touched.b").alias("_b")).filter("_a < _b"), "spans")
    spans = spans.withColumn("_row", F.monotonically_increasing_id()).withColumn("_place", F.explode(F.expr("sequence(_a, _b - 1)")))
    asked = spans.groupBy("_place").agg(F.count(F.lit(1)).alias("_m")).join(F.broadcast(blocks.select("_place", "_n")), "_place")
    asked = kept(asked.select("_place", F.ceil(F.col("_n") * F.col("_m") / (part_rows * PAIRS)).alias("_parts"), (F.col("_n") * F.col("_m")).alias("_pairs")), "asked")
    tasks = math.ceil((asked.agg(F.sum("_pairs")).first()[0] or 0) / (part_rows * PAIRS))
    tasks = min(max(tasks, parallelism(left.sparkSession)), TASKS)
    full = F.broadcast(asked.filter("_parts > 1").select("_place", "_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    dealt = lambda rows, part: rows.withColumn("_place", F.shiftleft("_place", 32) + part).repartition(tasks, "_place")
    spans = dealt(spans.join(full, "_place", "left"), F.pmod("_row", parts)).select(*others, "_place")
    rows = rows.join(F.broadcast(blocks.select(*keys, "_block", "_place")), [*keys, "_block"]).join(full, "_place", "left")
    rows = dealt(rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))), F.col("_part")).select(*keys, *values, "_place")
    return spans.join(rows.hint("merge"), "_place").select(*keys, *[rows[c] for c in values], *[spans[c] for c in others])


def _by_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_s: int, listed: int, part_rows: int) -> DataFrame:
    """Candidate pairs by dyadic ranges of ``bucket_s``."""
    width = F.lit(bucket_s * 1_000_000)
    unit = lambda c: F.floor(F.col(c) / width).cast("bigint")
    left, whole = left.withColumn("_unit", unit("_at")), left.columns
    right = right.withColumn("_a", unit("_from")).withColumn("_b", unit("_to") + 1)
    right = right.withColumn("_range", F.explode(F.expr(_RANGES))).drop("_a", "_b")
    right = kept(right.select("*", F.col("_range.level").alias("_level"), F.col("_range.pos").alias("_pos")).drop("_range"), "ranges")
    levels = sorted(r[0] for r in right.select("_level").distinct().collect())  # 41 at most
    above = F.array(*[F.struct(F.lit(h).alias("level"), F.shiftright("_unit", h).alias("pos")) for h in levels]) if levels else F.expr(
        "cast(array() as array<struct<level:int,pos:bigint>>)")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_range", F.explode(above))
        return rows.select("*", F.col("_range.level").alias("_level"), F.col("_range.pos").alias("_pos")).drop("_range", "_unit")

    place = [*keys, "_level", "_pos"]
    if right.count() <= listed:
        joined = placed(left).join(F.broadcast(right), place)
    else:
        # Joins that stay are merge joins: ranges are counted above, while a size that is guessed from files may broadcast millions.
        counts = placed(left.groupBy(*keys, "_unit").agg(F.count(F.lit(1)).alias("_n"))).groupBy(*place).agg(F.sum("_n").alias("_n"))
        asked = right.groupBy(*place).agg(F.count(F.lit(1)).alias("_m"))
        needed = F.greatest(F.ceil(F.col("_n") / part_rows), F.ceil(F.col("_n") * F.col("_m") / (part_rows * PAIRS)))
        full = counts.join(asked.hint("merge"), place).select(*place, F.least(needed, F.col("_n")).alias("_parts")).filter("_parts > 1")
        full = kept(full, "full")
        full = F.broadcast(full) if full.count() <= listed else full.hint("merge")
        parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
        dealt = placed(left).join(full, place, "left").withColumn("_part", F.pmod(F.xxhash64(*whole), parts)).drop("_parts")
        each = right.join(full, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
        joined = dealt.join(each.hint("merge"), [*place, "_part"]).drop("_part")
    return joined.drop("_level", "_pos")


def samples_in_sweeps(
    samples: DataFrame, sweeps: DataFrame, keys: Sequence[str] = (), warmup_s: float = 0.0, bucket_s: int = 60,
    ts: str = "ts", start: str = "started_at", end: str = "completed_at", listed: int = LISTED, part_rows: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Samples with ``start + warm-up ≤ ts ≤ end``, both ends included. A sweep without an end is still running.

    Few sweeps are cut into dyadic ranges of ``bucket_s``: one of an hour into a few, one of a year into a few dozen. A sample
    lies in one range per level, so both sides meet in an equi join on (level, position), each pair once. As many as
    ``listed`` ranges are broadcast, and samples stay where they are.

    For more than ``listed`` sweeps, samples are sorted by key and time and cut into blocks of equal numbers. A sweep has a row
    for each block from its first sample to its last, so its rows grow with its pairs and not with levels, and a sample has
    one row. The borders of the blocks are searched by halving. Keys of so many blocks that these can't be listed have few
    samples each and meet in dyadic ranges. Either way a block or range is dealt to as many parts as its own samples and
    pairs need, so neither a burst nor a long range lands in one task.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = samples.withColumn("_at", micros(ts))
    latest, held = left.agg(F.max("_at"), F.count("_at")).first()
    right = sweeps.withColumn("_from", micros(start) + int(warmup_s * 1_000_000)).withColumn(
        "_to", F.least(F.coalesce(micros(end), F.lit(latest)), F.lit(latest))  # no sample is later
    )
    right = right.filter(F.col("_from") <= F.col("_to"))
    joined = _by_blocks(left, right, held, keys, listed, part_rows) if listed and right.count() > listed else None
    if joined is None:
        joined = _by_ranges(left, right, keys, bucket_s, listed, part_rows)
    return joined.filter((F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))).drop("_at", "_from", "_to")


# The field names of the index documents.
INDEX_STATS = """
STRUCT<indices: MAP<STRING, STRUCT<total: STRUCT<
  docs: STRUCT<count: BIGINT, deleted: BIGINT>, store: STRUCT<size_in_bytes: BIGINT>, segments: STRUCT<count: BIGINT>,
  search: STRUCT<query_total: BIGINT, query_time_in_millis: BIGINT>,
  indexing: STRUCT<index_total: BIGINT, index_time_in_millis: BIGINT>,
  merges: STRUCT<total: BIGINT, total_time_in_millis: BIGINT>>>>>
"""
INDEX_SETTINGS = """
MAP<STRING, STRUCT<settings: STRUCT<index: STRUCT<
  number_of_shards: STRING, number_of_replicas: STRING, refresh_interval: STRING, knn: STRING>>>>
"""
INDEX_MAPPING = "MAP<STRING, STRUCT<mappings: STRUCT<properties: MAP<STRING, STRUCT<type: STRING, dimension: INT>>>>>"
VECTOR_FIELD_TYPE = "knn_vector"


def index_overview(snapshots: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Typed view of the stats, settings and mapping documents of an index; an error document gives nulls."""
    first = lambda m: F.element_at(F.map_values(m), 1)
    read = snapshots.select(
        *keys,
        F.when(F.size(F.from_json("stats", INDEX_STATS)["indices"]) > 0,
               first(F.from_json("stats", INDEX_STATS)["indices"])["total"]).alias("t"),
        F.when(F.size(F.from_json("settings", INDEX_SETTINGS)) > 0,
               first(F.from_json("settings", INDEX_SETTINGS))["settings"]["index"]).alias("s"),
        F.when(F.size(F.from_json("mapping", INDEX_MAPPING)) > 0,
               first(F.from_json("mapping", INDEX_MAPPING))["mappings"]["properties"]).alias("m"),
    )
    vector_fields = F.transform(
        F.filter(F.map_entries("m"), lambda e: e["value"]["type"] == VECTOR_FIELD_TYPE),
        lambda e: F.struct(e["key"].alias("field"), e["value"]["dimension"].alias("dimension")),
    )
    return read.select(
        *keys,
        F.col("t.docs.count").alias("docs"),
        F.col("t.store.size_in_bytes").alias("store_bytes"),
        F.col("t.segments.count").alias("segments"),
        F.col("t.search.query_total").alias("search_total"),
        F.col("t.indexing.index_total").alias("indexing_total"),
        F.col("t.merges.total").alias("merges_total"),
        F.col("s.number_of_shards").cast("int").alias("shards"),
        F.col("s.number_of_replicas").cast("int").alias("replicas"),
        F.col("s.refresh_interval").alias("refresh_interval"),
        (F.col("s.knn") == "true").alias("knn"),
        vector_fields.alias("vector_fields"),
    )


