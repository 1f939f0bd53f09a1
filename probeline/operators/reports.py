"""Result reports over runs and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeline.operators.timeline import Timeline, chunked_lists

# The fields of a sweep that a step report shows.
TIMING_FIELDS = ("sweep_index", "status", "started_at", "completed_at", "duration_seconds", "sweep_params")


def results_summary(sweeps: DataFrame, run: str = "run_id", order: str = "ord") -> DataFrame:
    """Per run and label the dataset of the first sweep and the sweep count, with the run's total."""
    labels = sweeps.groupBy(run, "label").agg(
        F.min_by("dataset", order).alias("dataset"), F.count(F.lit(1)).alias("sweep_count")
    )
    return labels.withColumn("total_sweeps", F.sum("sweep_count").over(Window.partitionBy(run)))


def compare_engines(
    results: DataFrame, metric: str, engines: Sequence[str], by: Sequence[str] = ("dataset", "label"),
    order: str | None = None,
) -> DataFrame:
    """One row per dataset and label, one column per engine (the first value by ``order``)."""
    pick = F.min_by(metric, order) if order else F.first(metric, ignorenulls=True)
    return results.groupBy(*by).pivot("engine", list(engines)).agg(pick)


def sweep_completeness(sweeps: DataFrame, expected: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Expected and found sweep counts (``expected`` is keys, expected_sweeps)."""
    found = sweeps.groupBy(*keys).agg(F.count(F.lit(1)).alias("found_sweeps"))
    joined = expected.join(found, list(keys), "left").na.fill(0, ["found_sweeps"])
    return joined.withColumn("complete", F.col("found_sweeps") == F.col("expected_sweeps"))


def artifact_presence(sweeps: DataFrame) -> DataFrame:
    """Whether each sweep has its test run and its parameters."""
    return sweeps.withColumn("has_test_run", F.col("test_run").isNotNull()).withColumn(
        "has_workload_params", F.col("workload_params").isNotNull()
    )


def tail(lines: DataFrame, n: int, keys: Sequence[str] = ("path",), order: Sequence[str] = ("line_no",)) -> DataFrame:
    """The last ``n`` lines per file, numbered from the end. Tasks drop older lines before the shuffle."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return lines.withColumn("from_end", F.row_number().over(back)).filter(F.col("from_end") <= n)


def tail_text(lines: DataFrame, n: int, keys: Sequence[str] = ("path",), order: Sequence[str] = ("line_no",), text: str = "value") -> DataFrame:
    """W7 as one text per file, lines in their order; a list is never longer than ``n``."""
    last = tail(lines, n, keys, order)
    packed = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("from_end")).alias("o"), F.col(text).alias("t")))).alias("_l"))
    return packed.select(*keys, F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("tail"))


def rank_sweeps(sweeps: DataFrame, seconds: str = "total_seconds", by: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """``rank`` by elapsed time, equal times share a rank.

    The rank comes from the histogram of times (rows before a value plus one), so no task sorts all sweeps.
    """
    keyed = sweeps.withColumn("_all", F.lit(0))
    keys = ["_all", *by]
    steps = keyed.filter(F.col(seconds).isNotNull()).groupBy(*keys, seconds).agg(F.count(F.lit(1)).alias("_n"))
    before = Timeline(steps, keys, [seconds], slices).running({"_before": ("sum", F.col("_n"))}, inclusive=False).result()
    ranks = before.select(*by, seconds, (F.coalesce("_before", F.lit(0)) + 1).cast("bigint").alias("rank"))
    return sweeps.join(ranks, [*by, seconds])


def order_sweeps(sweeps: DataFrame, by: Sequence[str] = ("run_id",), name: str = "sweep_name", numeric: bool = False) -> DataFrame:
    """L3: sweeps in name order, where ``sweep-10`` precedes ``sweep-2``; ``numeric`` sorts by the number instead."""
    number = F.regexp_extract(name, r"^sweep-(\d+)$", 1).try_cast("bigint")
    keys = [number, F.col(name)] if numeric else [F.col(name)]
    return sweeps.orderBy(*by, *keys)


def attach_timings(
    steps: DataFrame, sweeps: DataFrame, run: str = "run_id", fields: Sequence[str] = TIMING_FIELDS, chunk_rows: int = 1000,
) -> DataFrame:
    """Steps with the timings of their sweeps (matched on ``dataset-label``), by sweep index.

    A step with more than ``chunk_rows`` sweeps has several rows, numbered by ``chunk``; one without has an empty list.
    """
    keyed = steps.withColumn("step", F.concat_ws("-", "dataset", "label"))
    present = [f for f in fields if f in sweeps.columns]
    lists = chunked_lists(sweeps.select(run, "step", *present), [run, "step"], ["sweep_index"], present, chunk_rows, "sweep_results")
    joined = keyed.join(lists, [run, "step"], "left")
    none = F.array().cast(lists.schema["sweep_results"].dataType)
    return joined.withColumn("sweep_results", F.coalesce("sweep_results", none)).withColumn(
        "chunk", F.coalesce("chunk", F.lit(0).cast("bigint"))
    )


def resolve_artifacts(steps: DataFrame, result_map: DataFrame, inventory: DataFrame, run: str = "run_id") -> DataFrame:
    """The folder of each step's results.

    ``steps`` is (run, engine, step), ``result_map`` (run, step, sweep_name) as recorded, ``inventory`` (dir), the
    folders that exist, relative to the result root. Recorded steps are taken as they are. The others are looked up
    under ``run/engine/step`` first and ``run/step`` second, with one row per sweep folder in either.
    """
    recorded = steps.join(result_map, [run, "step"]).select(
        run, "engine", "step", "sweep_name",
        F.concat_ws("/", F.col(run).cast("string"), "step", "sweep_name").alias("dir"), F.lit("recorded").alias("source"),
    )
    open_steps = steps.join(result_map.select(run, "step").distinct(), [run, "step"], "left_anti")
    places = F.array(
        F.struct(F.lit(1).alias("p"), F.concat_ws("/", F.col(run).cast("string"), "engine", "step").alias("base")),
        F.struct(F.lit(2).alias("p"), F.concat_ws("/", F.col(run).cast("string"), "step").alias("base")),
    )
    wanted = open_steps.select(run, "engine", "step", F.explode(places).alias("_w")).select(
        run, "engine", "step", F.col("_w.p").alias("_p"), F.col("_w.base").alias("_base")
    )
    sweep = F.nullif(F.regexp_extract("dir", r"/(sweep-[^/]*)$", 1), F.lit(""))
    dirs = inventory.select("dir").distinct().select(
        "dir", sweep.alias("sweep_name"), F.regexp_replace("dir", r"/sweep-[^/]*$", "").alias("_base")
    )
    seen = wanted.join(dirs, "_base")
    best = seen.groupBy(run, "step").agg(F.min("_p").alias("_p"), F.min_by(F.col("sweep_name").isNotNull(), F.struct("_p", F.col("sweep_name").isNull())).alias("_has"))
    chosen = seen.join(best, [run, "step", "_p"]).filter(~F.col("_has") | F.col("sweep_name").isNotNull())
    found = chosen.select(run, "engine", "step", "sweep_name", "dir", F.when(F.col("_p") == 1, "engine path").otherwise("direct path").alias("source"))
    missing = open_steps.join(found.select(run, "step").distinct(), [run, "step"], "left_anti").select(
        run, "engine", "step", F.lit(None).cast("string").alias("sweep_name"), F.lit(None).cast("string").alias("dir"),
        F.lit("missing").alias("source"),
    )
    return recorded.unionByName(found).unionByName(missing)
