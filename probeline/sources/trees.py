"""Result trees, logs, samples, reports and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.operators.reports import tail_text
from probeline.operators.timeline import chunked_lists
from probeline.session import kept, parallelism
from probeline.sources.vecfiles import located

# The artifact names, the sample columns and the sink families.
ARTIFACTS = {
    "test_run.json": "test_run",
    "workload-params.json": "workload_params",
    "k8s_metrics.json": "k8s_metrics",
}
LOG_NAME = "benchmark.log"
RESULT_TAIL = 100
LIVE_TAIL = 200
READ_BYTES = 8 << 20  # of files that are handed on at once, the last one whole
NODE_SAMPLE = """
ts TIMESTAMP, node STRING, heap_used_pct DOUBLE, heap_used_mb BIGINT, heap_max_mb BIGINT, gc_young_count BIGINT,
gc_young_ms BIGINT, gc_old_count BIGINT, gc_old_ms BIGINT, cpu_pct DOUBLE, load_1m DOUBLE, mem_used_pct DOUBLE,
search_query_total BIGINT, search_query_ms BIGINT, indexing_total BIGINT, indexing_ms BIGINT, search_rejected BIGINT,
write_rejected BIGINT, fs_total_bytes BIGINT, fs_free_bytes BIGINT
"""
FAMILIES = ("results", "telemetry", "metrics")

# <job>/<engine>/<dataset>-<label>[/sweep-N]/<artifact>
_PLACE = r"([^/]+)/([^/]+)/([^/]+?)(?:/(sweep-[^/]+))?/([^/]+)$"


def scan_results(spark: SparkSession, root: str, tail_lines: int = RESULT_TAIL) -> DataFrame:
    """One row per result folder with its three JSON artifacts and the end of its log.

    A missing or empty file is null; a file that is not JSON is null and named in ``bad_artifacts``. Tasks list the folders
    and read the files, so the driver sees none of them. The root is one folder, of a store that Arrow opens.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    below = spark.createDataFrame([("",)], "path string")
    for _ in range(3):  # jobs, engines, steps
        below = _spread(_listed(below, root).filter("folder"))
    inside = kept(_listed(below, root).filter(F.col("folder") | F.col("name").isin(*ARTIFACTS, LOG_NAME)), "tree")
    deeper = _listed(_spread(inside.filter(F.col("folder") & F.col("name").startswith("sweep-"))), root)
    files = inside.unionByName(deeper).filter(~F.col("folder") & F.col("name").isin(*ARTIFACTS, LOG_NAME) & (F.col("bytes") > 0))
    texts = _read(_spread(files), root, tail_lines)
    part = lambda i: F.nullif(F.regexp_extract("path", "^/" + _PLACE, i), F.lit(""))
    place = ("job", "engine", "step", "sweep_name")
    texts = texts.select("value", *[part(i).alias(n) for i, n in enumerate((*place, "artifact"), 1)]).filter(F.col("job").isNotNull())
    is_log = F.col("artifact") == LOG_NAME
    texts = texts.withColumn("_ok", is_log | F.try_parse_json("value").isNotNull())
    log = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    return texts.groupBy(*place).agg(
        *[F.max(F.when((F.col("artifact") == name) & F.col("_ok"), F.col("value"))).alias(column) for name, column in ARTIFACTS.items()],
        F.array_sort(F.collect_set(F.when(~F.col("_ok"), F.col("artifact")))).alias("bad_artifacts"),
        F.max(F.when(is_log, log)).alias("benchmark_log"),
    )


def _spread(paths: DataFrame) -> DataFrame:
    return paths.repartition(parallelism(paths.sparkSession), "path")


def _listed(folders: DataFrame, root: str) -> DataFrame:
    """What is in the folders (``path`` below ``root``), hidden names left out as Spark does."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = located(root)
        kind = pa.schema([("path", pa.string()), ("name", pa.string()), ("folder", pa.bool_()), ("bytes", pa.int64())])
        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                found = [x for x in store.get_file_info(fs.FileSelector(top + path)) if not _hidden(x.base_name)]
                rows = [(f"{path}/{x.base_name}", x.base_name, x.type == fs.FileType.Directory, x.size or 0) for x in found]
                for begin in range(0, len(rows), 10_000):
                    columns = zip(*rows[begin : begin + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind.types, strict=True)], schema=kind)

    return folders.select("path").mapInArrow(work, "path string, name string, folder boolean, bytes long")


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _read(files: DataFrame, root: str, tail_lines: int) -> DataFrame:
    """``(path, value)``: whole files, of logs the last ``tail_lines`` lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = located(root)
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                with store.open_input_file(top + path) as file:
                    body = last_lines(file, tail_lines) if path.endswith(f"/{LOG_NAME}") else file.read()
                if body is not None:
                    rows.append((path, body))
                    size += len(body)
                if size > READ_BYTES:
                    yield _pairs(rows)
                    rows, size = [], 0
            yield _pairs(rows)

    read = files.select("path").mapInArrow(work, "path string, body binary")
    return read.select("path", F.col("body").cast("string").alias("value"))


def _pairs(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["path", "body"])


def last_lines(file: pa.NativeFile, n: int, block: int = 1 << 16) -> bytes | None:
    """The last ``n`` lines of a file, read from its end; lines end as Spark's text reader has it. None if there is no line."""
    at = size = file.size()
    lines: list[bytes] = []
    while at > 0 and len(lines) < n + 2:  # the first may be a part
        at = max(0, at - block)
        file.seek(at)
        lines = file.read(size - at).splitlines()
        block *= 4
    if at == 0 and lines:
        lines[0] = lines[0].removeprefix(b"\xef\xbb\xbf")
    lines = lines[max(0, len(lines) - n) :]
    return b"\n".join(lines) if lines else None


def read_log_lines(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """Log lines with their order: ``(path, block, line_no, value)``.

    A file may be split over tasks. Within a split rows are read in order, so (block start, running id) orders the
    lines of a file of any size without reading it as a whole. Bytes that are not UTF-8 are dropped.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("value"),
    )


def log_tail(spark: SparkSession, root: str, n: int = LIVE_TAIL, glob: str = "*.log") -> DataFrame:
    """The last ``n`` lines of every log below ``root`` as one text per file."""
    return tail_text(read_log_lines(spark, root, glob), n, ["path"], ["block", "line_no"])


def read_node_samples(spark: SparkSession, path: str) -> DataFrame:
    """Node samples, one JSON object per line."""
    return spark.read.schema(NODE_SAMPLE).json(path)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Name, path, type, size and time of every file; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        name.alias("name"),
        "path",
        F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit("")).alias("type"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def read_cat(lines: DataFrame, columns: Sequence[str], header: str, text: str = "value") -> DataFrame:
    """Whitespace-separated report lines as named string columns. Blank lines and the header are skipped."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    body = lines.filter((F.trim(F.col(text)) != "") & ~F.col(text).startswith(header))
    kept = [c for c in lines.columns if c != text]
    return body.select(*kept, *[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def write_monthly(df: DataFrame, root: str, family: str, ts: str = "ts") -> None:
    """Append to the family's folder, one partition per ``yyyy.MM`` month."""
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    rows = by_month(df, ts).hint("rebalance", "month")  # even files: small months together, large ones split
    rows.write.mode("append").partitionBy("month").parquet(f"{root.rstrip('/')}/{family}")


def read_monthly(spark: SparkSession, root: str, family: str) -> DataFrame:
    """A family written by ``write_monthly``. The month stays text (``2024.10`` is not a number), so it prunes folders."""
    path = f"{root.rstrip('/')}/{family}"
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == "month" else f.dataType) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def by_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the month in UTC, whatever the session's zone; a date or a time without a zone keeps its own."""
    when = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        when = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(when) / F.lit(86_400_000_000)).cast("int"))
    return df.withColumn("month", F.date_format(when.cast("date"), "yyyy.MM"))


def results_documents(jobs: DataFrame, sweeps: DataFrame, job: str = "job", order: str = "ord", sweeps_per_part: int = 1000) -> DataFrame:
    """JSON documents per run. A run with many sweeps has several parts, and part 0 alone carries the job row."""
    fields = [c for c in sweeps.columns if c not in (job, order)]
    lists = chunked_lists(sweeps, [job], [order], fields, sweeps_per_part, "sweeps")
    joined = jobs.withColumn("_job", F.struct(*jobs.columns)).select(job, "_job").join(lists, job, "left")
    part = F.coalesce("chunk", F.lit(0).cast("bigint"))
    none = F.array().cast(lists.schema["sweeps"].dataType)
    return joined.select(
        job,
        part.alias("part"),
        F.to_json(
            F.struct(
                F.col(job).alias("job_id"), part.alias("part"), F.when(part == 0, F.col("_job")).alias("job"),
                F.coalesce("sweeps", none).alias("sweeps"),
            )
        ).alias("value"),
    )


def export_results(documents: DataFrame, path: str, job: str = "job") -> None:
    """Write the documents as text, one folder per run."""
    documents.select(job, "value").write.mode("errorifexists").partitionBy(job).text(path)


def metrics_documents(
    header: DataFrame, nodes: DataFrame, pods: DataFrame, gc: DataFrame, by: Sequence[str] = ("scenario",),
    rows_per_part: int = 1000,
) -> DataFrame:
    """The nested metrics payload per scenario as JSON documents ``(by, section, part, value)``.

    ``header`` has one row per scenario, ``nodes`` one per node, ``pods`` the sample lists of A3 with their chunk
    numbers, ``gc`` the timeline rows with ``ts`` and ``node``. Documents of a section merge into the full payload; no
    document is larger than a chunk, so a long run is never gathered in one place.
    """
    by = list(by)

    def document(section: str, part, body):
        whole = F.struct(*by, F.lit(section).alias("section"), part.alias("part"), body.alias(section))
        return [*by, F.lit(section).alias("section"), part.alias("part"), F.to_json(whole).alias("value")]

    def under_key(df: DataFrame, key: str, skip: Sequence[str]):
        return F.create_map(F.col(key), F.struct(*[c for c in df.columns if c not in (*by, key, *skip)]))

    zero = F.lit(0).cast("bigint")
    heads = header.select(*document("header", zero, F.struct(*[c for c in header.columns if c not in by])))
    per_node = nodes.select(*document("nodes", zero, under_key(nodes, "node", ())))
    per_pod = pods.select(*document("pods", F.col("chunk"), under_key(pods, "pod", ("chunk",))))
    fields = [c for c in gc.columns if c not in by]
    timeline = chunked_lists(gc, by, ["ts", "node"], fields, rows_per_part, "_items")
    timeline = timeline.select(*document("gc_timeline", F.col("chunk"), F.col("_items")))
    return heads.unionByName(per_node).unionByName(per_pod).unionByName(timeline)


def write_metrics_payload(documents: DataFrame, path: str, by: Sequence[str] = ("scenario",)) -> None:
    """Write the payload documents as text, one folder per scenario."""
    documents.select(*by, "value").write.mode("append").partitionBy(*by).text(path)
