"""Views over the given tables that stand for samples, polls, jobs, sweeps and requests, in Spark and in SQL.

Every view covers its whole table. ``with_views`` puts the SQL forms in front of a statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.operators.timeline import Timeline, numbered
from probeline.plans.registry import table
from probeline.session import parallelism

ENGINES = ("graph", "disk", "flat")
JOB_STATES = ("queued", "running", "completed", "error", "cancelled", "failed", "partial", "partial_failure")
PROCEDURES = ("create-index", "bulk-ingest-data", "vector-search")

_VIEWS = {
    "node_samples": "SELECT *, 'node-' || (user_id % 3) AS node FROM events",
    "node_counters": """
        SELECT *, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY node ORDER BY ts, event_id) AS BIGINT)
                    AS gc_young_ms,
               CAST(count(*) OVER (PARTITION BY node ORDER BY ts, event_id) * 3 AS BIGINT) AS gc_young_count
        FROM node_samples""",
    "usage_text": """
        SELECT *,
               CASE event_id % 3 WHEN 0 THEN CAST(floor(value) AS BIGINT) || 'm'
                                 WHEN 1 THEN CAST(floor(value * 1000000) AS BIGINT) || 'n'
                                 ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS cpu,
               CAST(floor(value) AS BIGINT) || CASE event_id % 4 WHEN 0 THEN 'Ki' WHEN 1 THEN 'Mi' WHEN 2 THEN 'Gi'
                                                    ELSE '' END AS memory
        FROM node_samples""",
    "cores_mib": """
        SELECT *,
               CASE WHEN cpu LIKE '%m' THEN CAST(left(cpu, -1) AS DOUBLE) / 1000.0
                    WHEN cpu LIKE '%n' THEN CAST(left(cpu, -1) AS DOUBLE) / 1000000000.0
                    ELSE CAST(cpu AS DOUBLE) END AS cores,
               CASE WHEN cpu LIKE '%m' THEN CAST(left(cpu, -1) AS BIGINT)
                    WHEN cpu LIKE '%n' THEN CAST(left(cpu, -1) AS BIGINT) // 1000000
                    ELSE CAST(trunc(CAST(cpu AS DOUBLE) * 1000.0) AS BIGINT) END AS millicores,
               CASE WHEN memory LIKE '%Ki' THEN CAST(left(memory, -2) AS DOUBLE) / 1024.0
                    WHEN memory LIKE '%Mi' THEN CAST(left(memory, -2) AS DOUBLE)
                    WHEN memory LIKE '%Gi' THEN CAST(left(memory, -2) AS DOUBLE) * 1024.0
                    ELSE CAST(memory AS DOUBLE) END AS mib,
               CASE WHEN memory LIKE '%Ki' THEN CAST(left(memory, -2) AS BIGINT)
                    WHEN memory LIKE '%Mi' THEN CAST(left(memory, -2) AS BIGINT) * 1024
                    WHEN memory LIKE '%Gi' THEN CAST(left(memory, -2) AS BIGINT) * 1048576
                    ELSE 0 END AS kib
        FROM usage_text""",
    "polls": """
        SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'ready' WHEN event_type = 'error' THEN 'timeout'
                       ELSE 'down' END AS state
        FROM node_samples""",
    "count_polls": """
        SELECT event_id, ts, node,
               CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value / 100) AS BIGINT) END AS count
        FROM node_samples""",
    "jobs": """
        SELECT o_orderkey AS job_id,
               CASE WHEN o_orderkey % 10 = 9 THEN 'manual-' || o_orderkey
                    ELSE strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || o_orderkey END AS run_id,
               ['graph', 'disk', 'flat'][1 + o_custkey % 3] AS engine,
               ['queued', 'running', 'completed', 'error', 'cancelled', 'failed', 'partial', 'partial_failure']
                 [1 + o_orderkey % 8] AS status,
               nullif(o_custkey % 50, 0) AS queue_position,
               o_orderdate AS created_at,
               o_orderdate + to_seconds(o_custkey % 900) AS started_at,
               CASE WHEN o_orderkey % 8 < 2 THEN NULL
                    ELSE o_orderdate + to_seconds(o_custkey % 900 + o_orderkey % 400) END AS completed_at,
               CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderdate + to_seconds(o_custkey % 900 + 10) END
                 AS last_heartbeat_at,
               CAST(NULL AS VARCHAR) AS error,
               o_custkey, o_orderpriority
        FROM orders""",
    "sweeps": """
        SELECT l_orderkey AS run_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate,
                                  l_quantity, l_extendedprice) AS ord,
               CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'failed' ELSE 'cancelled' END AS status,
               l_quantity AS duration_seconds,
               'ds-' || (l_partkey % 5) AS dataset,
               'k' || (l_suppkey % 4) AS label,
               ['graph', 'disk', 'flat'][1 + l_suppkey % 3] AS engine,
               l_extendedprice AS latency, l_shipdate AS started_at
        FROM lineitem""",
    "steps": """
        SELECT o_custkey AS suite_id, o_orderkey AS step_id,
               'cohere-ds-' || (o_orderkey % 4) AS dataset,
               ['create-index', 'bulk-ingest-data', 'vector-search'][1 + o_orderkey % 3] AS procedure,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (1 + o_orderkey % 6) || 'm' END AS corpus_size,
               CASE WHEN o_orderkey % 3 = 2 THEN CAST(10 * (1 + o_orderkey % 4) AS VARCHAR) END AS query_k
        FROM orders""",
    "size_requests": """
        SELECT p_partkey, 'ds-' || (p_partkey % 3) AS dataset, p_partkey * 10000 AS num_vectors,
               CAST(p_size * 5 AS BIGINT) AS query_k
        FROM part""",
    "param_layers": """
        SELECT c_custkey AS run_id, CAST(layer AS INTEGER) AS layer, key,
               key || '-' || layer || '-{{corpus_size}}-' || c_nationkey AS value
        FROM customer, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS layer),
             (SELECT unnest(['engine', 'query_k', 'corpus_name', 'password', 'num_vectors']) AS key)
        WHERE c_nationkey >= 4 * (layer - 1) AND (key <> 'num_vectors' OR c_acctbal > 0)""",
    "doc_lines": """
        SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents""",
}
_NEEDS = {
    "node_counters": ["node_samples"], "usage_text": ["node_samples"], "cores_mib": ["usage_text"],
    "polls": ["node_samples"], "count_polls": ["node_samples"],
}


def with_views(*names: str, body: str) -> str:
    """SQL text: the named views and what they need as common table expressions, then the statement."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{n} AS ({_VIEWS[n].strip()})" for n in wanted)
    tail = body.strip()
    return f"WITH {views}, {tail[5:]}" if tail[:5].upper() == "WITH " else f"WITH {views}\n{tail}"


def _nth(names, number):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number + 1).cast("int"))


def node_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("node", F.concat(F.lit("node-"), F.col("user_id") % 3))


def node_counters(spark: SparkSession, sf: str) -> DataFrame:
    line = Timeline(node_samples(spark, sf), ["node"], ["ts", "event_id"])
    whole = F.floor("value").cast("bigint")
    return line.running(
        {"gc_young_ms": ("sum", whole), "gc_young_count": ("sum", F.lit(3).cast("bigint"))}
    ).result()


def usage_text(spark: SparkSession, sf: str) -> DataFrame:
    df = node_samples(spark, sf)
    whole = F.floor("value").cast("bigint").cast("string")
    kind, unit = F.col("event_id") % 3, F.col("event_id") % 4
    nanos = F.floor(F.col("value") * 1000000).cast("bigint").cast("string")
    cpu = F.when(kind == 0, F.concat(whole, F.lit("m"))).when(kind == 1, F.concat(nanos, F.lit("n"))).otherwise(whole)
    suffix = F.when(unit == 0, "Ki").when(unit == 1, "Mi").when(unit == 2, "Gi").otherwise("")
    return df.withColumn("cpu", cpu).withColumn("memory", F.concat(whole, suffix))


def node_pools(spark: SparkSession) -> DataFrame:
    """A dimension table with a node that has no usage and without one that has."""
    rows = [("node-0", "server-pool"), ("node-1", "server-pool"), ("node-9", "client-pool")]
    return spark.createDataFrame(rows, "node string, node_pool string")


POOLS_SQL = "(VALUES ('node-0', 'server-pool'), ('node-1', 'server-pool'), ('node-9', 'client-pool')) AS node_pools(node, node_pool)"


def polls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind.isin("view", "click"), "ready").when(kind == "error", "timeout").otherwise("down")
    return node_samples(spark, sf).withColumn("state", state)


def count_polls(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("event_type") != "signup", F.floor(F.col("value") / 100).cast("bigint"))
    return node_samples(spark, sf).select("event_id", "ts", "node", known.alias("count"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    at = F.col("o_orderdate").cast("timestamp")
    plus = lambda s: F.timestamp_seconds(F.unix_seconds(at) + s).cast("timestamp_ntz")
    return o.select(
        key.alias("job_id"),
        F.when(key % 10 == 9, F.concat(F.lit("manual-"), key))
        .otherwise(F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), key)).alias("run_id"),
        _nth(ENGINES, cust % 3).alias("engine"),
        _nth(JOB_STATES, key % 8).alias("status"),
        F.nullif(cust % 50, F.lit(0).cast("bigint")).alias("queue_position"),
        F.col("o_orderdate").alias("created_at"),
        plus(cust % 900).alias("started_at"),
        F.when(key % 8 >= 2, plus(cust % 900 + key % 400)).alias("completed_at"),
        F.when(cust % 7 != 0, plus(cust % 900 + 10)).alias("last_heartbeat_at"),
        F.lit(None).cast("string").alias("error"),
        "o_custkey",
        "o_orderpriority",
    )


def sweeps(spark: SparkSession, sf: str, ordered: bool = True) -> DataFrame:
    line = table(spark, sf, "lineitem")
    if ordered:
        sort = ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"]
        line = numbered(line, ["l_orderkey"], sort, "ord")
    flag = F.col("l_returnflag")
    return line.select(
        F.col("l_orderkey").alias("run_id"),
        *(["ord"] if ordered else []),
        F.when(flag == "A", "completed").when(flag == "N", "failed").otherwise("cancelled").alias("status"),
        F.col("l_quantity").alias("duration_seconds"),
        F.concat(F.lit("ds-"), F.col("l_partkey") % 5).alias("dataset"),
        F.concat(F.lit("k"), F.col("l_suppkey") % 4).alias("label"),
        _nth(ENGINES, F.col("l_suppkey") % 3).alias("engine"),
        F.col("l_extendedprice").alias("latency"),
        F.col("l_shipdate").alias("started_at"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("suite_id"),
        key.alias("step_id"),
        F.concat(F.lit("cohere-ds-"), key % 4).alias("dataset"),
        _nth(PROCEDURES, key % 3).alias("procedure"),
        F.when(key % 5 != 0, F.concat(1 + key % 6, F.lit("m"))).alias("corpus_size"),
        F.when(key % 3 == 2, (10 * (1 + key % 4)).cast("string")).alias("query_k"),
    )


def size_requests(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.concat(F.lit("ds-"), F.col("p_partkey") % 3).alias("dataset"),
        (F.col("p_partkey") * 10000).alias("num_vectors"),
        (F.col("p_size") * 5).cast("bigint").alias("query_k"),
    )


def param_layers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    keys = F.array(*[F.lit(k) for k in ("engine", "query_k", "corpus_name", "password", "num_vectors")])
    c = c.select("c_custkey", "c_nationkey", "c_acctbal").repartition(parallelism(spark), "c_custkey")  # one file, many rows of each
    rows = c.select(
        F.col("c_custkey").alias("run_id"), "c_nationkey", "c_acctbal", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("layer")
    ).select("*", F.explode(keys).alias("key"))
    rows = rows.filter(
        (F.col("c_nationkey") >= 4 * (F.col("layer") - 1)) & ((F.col("key") != "num_vectors") | (F.col("c_acctbal") > 0))
    )
    value = F.concat(F.col("key"), F.lit("-"), F.col("layer"), F.lit("-{{corpus_size}}-"), F.col("c_nationkey"))
    return rows.select("run_id", "layer", "key", value.alias("value"))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
