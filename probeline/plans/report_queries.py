"""Reports over results, logs and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions import text
from probeline.operators import reports
from probeline.plans import views
from probeline.plans.registry import query, table
from probeline.plans.views import with_views
from probeline.session import scratch_path
from probeline.sources import trees
from probeline.sources.vecfiles import located


@query(
    "results_summary",
    with_views("sweeps", body="""
        SELECT run_id, label, arg_min(dataset, ord) AS dataset, count(*) AS sweep_count,
               CAST(sum(count(*)) OVER (PARTITION BY run_id) AS BIGINT) AS total_sweeps FROM sweeps GROUP BY run_id, label"""),
)
def results_summary(spark, sf):
    """A7."""
    return reports.results_summary(views.sweeps(spark, sf))


@query(
    "compare_engines",
    with_views("sweeps", body="""
        SELECT dataset, label, min(latency) FILTER (WHERE engine = 'graph') AS graph,
               min(latency) FILTER (WHERE engine = 'disk') AS disk, min(latency) FILTER (WHERE engine = 'flat') AS flat
        FROM sweeps GROUP BY dataset, label"""),
)
def compare_engines(spark, sf):
    """The lowest latency per engine."""
    rows = views.sweeps(spark, sf, ordered=False).withColumn("by", F.col("latency"))
    return reports.compare_engines(rows, "latency", views.ENGINES, order="by")


@query(
    "sweep_completeness",
    """WITH f AS (SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT o_orderkey AS run_id, o_custkey % 6 AS expected_sweeps, coalesce(n, 0) AS found_sweeps, coalesce(n, 0) = o_custkey % 6 AS complete
       FROM orders LEFT JOIN f ON f.run_id = o_orderkey""",
)
def sweep_completeness(spark, sf):
    """A16."""
    expected = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 6).alias("expected_sweeps"))
    return reports.sweep_completeness(views.sweeps(spark, sf, ordered=False), expected)


@query(
    "artifact_presence",
    """SELECT event_id, event_type <> 'error' AS has_test_run, value >= 50 AS has_workload_params FROM events""",
)
def artifact_presence(spark, sf):
    """A17."""
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("props")).alias("test_run"),
        F.when(F.col("value") >= 50, F.col("props")).alias("workload_params"),
    )
    return reports.artifact_presence(e).select("event_id", "has_test_run", "has_workload_params")


@query(
    "tail_lines",
    with_views("doc_lines", body="""
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(value) AS digest FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS rn FROM doc_lines) WHERE rn <= 5"""),
)
def tail_lines(spark, sf):
    """W7 on the lines of whole documents."""
    last = reports.tail(views.doc_lines(spark, sf), 5, ["doc_id"])
    return last.select("doc_id", "line_no", F.md5("value").alias("digest"))


@query("text_tail", "SELECT doc_id, md5(right(coalesce(text, ''), 5000)) AS digest FROM documents")
def text_tail(spark, sf):
    """P10."""
    return table(spark, sf, "documents").select("doc_id", F.md5(text.text_tail("text")).alias("digest"))


@query(
    "extract_uuid",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE left(md5(text), 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4)
              || '-' || substr(md5(text), 17, 4) || '-' || right(md5(text), 12) END AS uuid FROM documents""",
)
def extract_uuid(spark, sf):
    """A run id made from the digest stands inside the text of two thirds of the documents."""
    h = F.md5("text")
    part = lambda a, n: F.substring(h, a, n)
    made = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    console = F.when(F.col("doc_id") % 3 == 0, F.lit("run without id")).otherwise(F.concat(F.lit("run "), made, F.lit(" done "), F.col("doc_id")))
    return table(spark, sf, "documents").select("doc_id", text.extract_uuid(console).alias("uuid"))


@query(
    "sweep_name",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sweep-' || user_id END AS sweep_name FROM events""",
)
def sweep_name(spark, sf):
    """P18."""
    e = table(spark, sf, "events")
    place = F.concat(F.lit("/results/job/"), F.col("event_type"))
    sweep = F.concat(F.lit("sweep-"), "user_id")
    kind = F.col("event_id") % 3
    path = F.when(kind == 0, F.concat_ws("/", place, sweep)).when(kind == 1, F.concat_ws("/", place, sweep, F.lit("logs"))).otherwise(place)
    return e.select("event_id", text.sweep_name(path).alias("sweep_name"))


@query(
    "rank_sweeps",
    """WITH t AS (SELECT l_orderkey AS run_id, CAST(sum(l_quantity) AS DOUBLE) AS total_seconds FROM lineitem GROUP BY 1)
       SELECT run_id, total_seconds, rank() OVER (ORDER BY total_seconds) AS rank FROM t""",
)
def rank_sweeps(spark, sf):
    """W15."""
    totals = views.sweeps(spark, sf, ordered=False).groupBy("run_id").agg(F.sum("duration_seconds").alias("total_seconds"))
    return reports.rank_sweeps(totals).select("run_id", "total_seconds", "rank")


@query(
    "order_sweeps",
    with_views("sweeps", body="SELECT run_id, 'sweep-' || ord AS sweep_name, status FROM sweeps ORDER BY run_id, sweep_name"),
)
def order_sweeps(spark, sf):
    """L3."""
    named = views.sweeps(spark, sf).select("run_id", F.concat(F.lit("sweep-"), "ord").alias("sweep_name"), "status")
    return reports.order_sweeps(named)


@query(
    "attach_timings",
    with_views("sweeps", body="""
        SELECT o_orderkey AS run_id, coalesce(string_agg(s.ord || ':' || s.status, ',' ORDER BY s.ord), '') AS timings
        FROM orders o LEFT JOIN sweeps s ON s.run_id = o.o_orderkey AND s.label = 'k' || (o.o_orderkey % 4)
        GROUP BY o_orderkey"""),
)
def attach_timings(spark, sf):
    """The sweeps of one label per run as its step."""
    key = F.col("o_orderkey")
    steps = table(spark, sf, "orders").select(key.alias("run_id"), F.lit("ds").alias("dataset"), F.concat(F.lit("k"), key % 4).alias("label"))
    timings = views.sweeps(spark, sf).withColumn("step", F.concat(F.lit("ds-"), "label")).withColumnRenamed("ord", "sweep_index")
    joined = reports.attach_timings(steps, timings, fields=["sweep_index", "status"])
    shown = F.transform("sweep_results", lambda s: F.concat_ws(":", s["sweep_index"].cast("string"), s["status"]))
    return joined.select("run_id", F.array_join(shown, ",").alias("timings"))


@query(
    "resolve_artifacts",
    """SELECT o_orderkey AS step_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'recorded' WHEN '2-HIGH' THEN 'engine path'
                   WHEN '3-MEDIUM' THEN 'direct path' ELSE 'missing' END AS source,
              CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey || '/step-' || o_orderkey || '/sweep-1'
                   WHEN '2-HIGH' THEN o_custkey || '/graph/step-' || o_orderkey
                   WHEN '3-MEDIUM' THEN o_custkey || '/step-' || o_orderkey || '/sweep-2' END AS dir FROM orders""",
)
def resolve_artifacts(spark, sf):
    """Recorded, under the engine path (also under the direct path), under the direct path only, or missing."""
    o = table(spark, sf, "orders")
    key, run, kind = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    step = F.concat(F.lit("step-"), key)
    steps = o.select(run.alias("run_id"), F.lit("graph").alias("engine"), step.alias("step"))
    recorded = o.filter(kind == "1-URGENT").select(run.alias("run_id"), step.alias("step"), F.lit("sweep-1").alias("sweep_name"))
    path = lambda *p: F.concat_ws("/", run.cast("string"), *p).alias("dir")
    high, medium = o.filter(kind == "2-HIGH"), o.filter(kind == "3-MEDIUM")
    dirs = (
        high.select(path(F.lit("graph"), step))
        .unionByName(high.select(path(step)))
        .unionByName(medium.select(path(step)))
        .unionByName(medium.select(path(step, F.lit("sweep-2"))))
    )
    found = reports.resolve_artifacts(steps, recorded, dirs)
    return found.select(F.replace("step", F.lit("step-"), F.lit("")).cast("bigint").alias("step_id"), "source", "dir")


@query(
    "results_documents",
    with_views("sweeps", body="""
        WITH n AS (SELECT run_id, (ord - 1) // 3 AS part FROM sweeps)
        SELECT o_orderkey AS job, coalesce(part, 0) AS part, count(part) AS sweeps, coalesce(part, 0) = 0 AS has_job
        FROM orders LEFT JOIN n ON n.run_id = o_orderkey GROUP BY ALL"""),
)
def results_documents(spark, sf):
    """Documents of at most three sweeps, read back from their JSON."""
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), "o_orderpriority")
    sweeps = views.sweeps(spark, sf).select(F.col("run_id").alias("job"), "ord", "status", "duration_seconds")
    documents = trees.results_documents(jobs, sweeps, sweeps_per_part=3)
    back = F.from_json("value", "STRUCT<job: STRUCT<o_orderpriority: STRING>, sweeps: ARRAY<STRUCT<status: STRING>>>")
    return documents.select(
        "job", "part", F.size(back["sweeps"]).cast("bigint").alias("sweeps"), back["job"].isNotNull().alias("has_job")
    )


@query(
    "log_tail",
    with_views("doc_lines", body="""
        WITH l AS (SELECT doc_id // 250 AS bucket, doc_id, line_no, doc_id || '|' || line_no || '|' || md5(value) AS line FROM doc_lines),
        n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id DESC, line_no DESC) AS rn FROM l)
        SELECT bucket, string_agg(line, chr(10) ORDER BY doc_id, line_no) AS tail FROM n WHERE rn <= 20 GROUP BY bucket"""),
)
def log_tail(spark, sf):
    """S7 on log files written from the document lines, 250 documents per file."""
    root = scratch_path(spark, "logs")
    bucket = F.floor(F.col("doc_id") / 250).cast("bigint")
    line = F.concat_ws("|", "doc_id", "line_no", F.md5("value"))
    lines = views.doc_lines(spark, sf).select(bucket.alias("bucket"), "doc_id", "line_no", line.alias("line"))
    ordered = lines.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "line_no")
    ordered.select("bucket", F.col("line").alias("value")).write.partitionBy("bucket").text(root)
    tails = trees.log_tail(spark, root, 20, "*.txt")
    return tails.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint").alias("bucket"), "tail")


@query(
    "read_node_samples",
    """SELECT event_id AS gc_young_count, 'n' || user_id AS node, epoch_us(date_trunc('second', ts)) AS at_us, round(value, 6) AS heap_used_pct,
              CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS has_load FROM events""",
)
def read_node_samples(spark, sf):
    """Samples written as one JSON object per line; columns that are not in a line are null."""
    path = scratch_path(spark, "samples")
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select(
        second.alias("ts"), F.concat(F.lit("n"), "user_id").alias("node"), F.col("value").alias("heap_used_pct"),
        F.col("event_id").alias("gc_young_count"), F.when(F.col("event_type") != "error", F.col("value")).alias("load_1m"),
    )
    e.write.json(path)
    found = trees.read_node_samples(spark, path)
    return found.select(
        "gc_young_count", "node", F.unix_micros("ts").alias("at_us"), F.round("heap_used_pct", 6).alias("heap_used_pct"),
        F.col("load_1m").isNotNull().cast("int").alias("has_load"),
    )


def _write_files(rows, root: str) -> None:
    """Write each row (``path`` below ``root``, ``body``) as a file of its own; a task that runs again writes the same."""
    def work(batches):
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, top = located(root)
                store.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}") as stream:
                    stream.write(body.encode())
        yield from ()

    rows.select("path", "body").mapInArrow(work, "path string").write.format("noop").mode("overwrite").save()


@query(
    "scan_results",
    """SELECT 'job ' || s_nationkey AS job, 'eng-' || (s_suppkey % 3) AS engine, 'data-' || s_suppkey AS step,
              CASE WHEN s_suppkey % 4 <> 0 THEN 'sweep-' || (s_suppkey % 4) END AS sweep_name,
              CASE WHEN s_suppkey % 7 <> 0 THEN '{"supplier": ' || s_suppkey || '}' END AS test_run,
              CASE WHEN s_suppkey % 5 <> 0 THEN '{"name": "' || s_name || '"}' END AS workload_params,
              CASE WHEN s_suppkey % 7 = 0 THEN 'test_run.json' ELSE '' END AS bad,
              'line ' || (s_suppkey % 9) || ' of ' || s_name AS last_line FROM supplier""",
)
def scan_results(spark, sf):
    """A result tree below a root with odd characters, some of its files missing or broken, read back by folder."""
    root = scratch_path(spark, "results") + "/all results+100%25 (1)"
    key = F.col("s_suppkey")
    sweep = F.when(key % 4 != 0, F.concat(F.lit("/sweep-"), key % 4)).otherwise("")
    folder = F.concat(F.lit("job "), "s_nationkey", F.lit("/eng-"), key % 3, F.lit("/data-"), key, sweep)
    lines = F.array_join(F.transform(F.sequence(F.lit(0), (key % 9).cast("int")), lambda i: F.concat(F.lit("line "), i, F.lit(" of "), "s_name")), "\n")
    files = {
        "test_run.json": F.when(key % 7 != 0, F.concat(F.lit('{"supplier": '), key, F.lit("}"))).otherwise("{broken"),
        "workload-params.json": F.when(key % 5 != 0, F.concat(F.lit('{"name": "'), "s_name", F.lit('"}'))),
        "benchmark.log": lines, "notes.txt": F.lit("not an artifact"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), body.alias("body")) for n, body in files.items()])).alias("file")
    rows = table(spark, sf, "supplier").select(folder.alias("folder"), each).filter("file.body is not null")
    _write_files(rows.select(F.concat("folder", F.lit("/"), "file.name").alias("path"), F.col("file.body").alias("body")), root)
    found = trees.scan_results(spark, root)
    return found.select(
        "job", "engine", "step", "sweep_name", "test_run", "workload_params", F.array_join("bad_artifacts", ",").alias("bad"),
        F.element_at(F.split("benchmark_log", "\n"), -1).alias("last_line"),
    )
