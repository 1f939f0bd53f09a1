"""Suites, sweeps, labels, layered parameters, catalog checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions import text, units
from probeline.operators import experiments as ex
from probeline.plans import views
from probeline.plans.registry import query, table
from probeline.plans.views import with_views

_SIZES = {"ds-0": ("1m", "5m", "10m"), "ds-1": ("50k", "500k", "1m", "2.5m")}
_SIZES_SQL = """(VALUES ('ds-0', '1m', 1000000), ('ds-0', '5m', 5000000), ('ds-0', '10m', 10000000), ('ds-1', '50k', 50000),
                ('ds-1', '500k', 500000), ('ds-1', '1m', 1000000), ('ds-1', '2.5m', 2500000)) AS sizes(dataset, size, n)"""


def _supported(spark):
    return spark.createDataFrame([(d, s) for d, sizes in _SIZES.items() for s in sizes], "dataset string, corpus_size string")


@query(
    "size_text",
    """SELECT o_orderkey, CASE WHEN x IS NULL THEN 1000000 ELSE x END AS count, coalesce(y, -1) AS strict_count FROM (
         SELECT o_orderkey,
           CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 1000000 WHEN 1 THEN CAST(trunc((o_custkey + 0.5::DOUBLE) * 1000.0) AS BIGINT)
                WHEN 2 THEN o_custkey WHEN 3 THEN o_custkey * 1000000000 WHEN 4 THEN NULL ELSE o_custkey * 1000 END AS x,
           CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 1000000 WHEN 5 THEN o_custkey * 1000 END AS y
         FROM orders)""",
)
def size_text(spark, sf):
    """P1 and P1b."""
    o = table(spark, sf, "orders")
    n, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    size = (
        F.when(kind == 0, F.concat(n, F.lit("m"))).when(kind == 1, F.concat(n, F.lit(".5K"))).when(kind == 2, n)
        .when(kind == 3, F.concat(F.lit(" "), n, F.lit("B "))).when(kind == 4, F.concat(F.lit("x"), n))
        .otherwise(F.concat(n, F.lit("k")))
    )
    return o.select(
        "o_orderkey", units.corpus_to_count(size).alias("count"), F.coalesce(units.corpus_to_count(size, strict=True), F.lit(-1).cast("bigint")).alias("strict_count")
    )


@query(
    "count_text",
    """SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN CAST(round_even(n / 1e9, 0) AS BIGINT) || 'b'
                WHEN n >= 1000000 THEN CAST(round_even(n / 1e6, 0) AS BIGINT) || 'm'
                WHEN n >= 1000 THEN CAST(round_even(n / 1e3, 0) AS BIGINT) || 'k' ELSE CAST(n AS VARCHAR) END AS size
       FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 500
                                     WHEN 2 THEN o_custkey * 500000 ELSE o_custkey * 50000000 END AS n FROM orders)""",
)
def count_text(spark, sf):
    """P2, with many halves."""
    kind, cust = F.col("o_orderkey") % 4, F.col("o_custkey")
    n = F.when(kind == 0, cust).when(kind == 1, cust * 500).when(kind == 2, cust * 500000).otherwise(cust * 50000000)
    return table(spark, sf, "orders").select("o_orderkey", units.count_to_corpus(n).alias("size"))


@query(
    "file_sizes",
    """SELECT p_partkey, p_partkey * 10000 * (4 + 4 * CAST(p_size AS BIGINT)) AS bytes,
              '0-' || (p_partkey * 10000 * (4 + 4 * CAST(p_size AS BIGINT)) - 1) AS byte_range,
              CASE WHEN p_partkey = 0 THEN -1 ELSE p_partkey * 10000 * (4 + 4 * CAST(p_size AS BIGINT)) END AS range_bytes FROM part""",
)
def file_sizes(spark, sf):
    """P19; the range of an empty file cannot be read back."""
    n, d = F.col("p_partkey") * 10000, F.col("p_size")
    out = table(spark, sf, "part").select(
        "p_partkey", units.expected_bytes(n, d).alias("bytes"), units.byte_range(n, d).alias("byte_range")
    )
    return out.withColumn("range_bytes", F.coalesce(units.range_bytes("byte_range"), F.lit(-1).cast("bigint")))


@query(
    "pick_corpus_size",
    with_views("size_requests", body=f"""
        SELECT r.p_partkey, r.num_vectors,
               coalesce((SELECT arg_min(size, n) FROM {_SIZES_SQL} WHERE sizes.dataset = r.dataset AND n >= r.num_vectors),
                        (SELECT arg_max(size, n) FROM {_SIZES_SQL} WHERE sizes.dataset = r.dataset),
                        CASE WHEN num_vectors >= 1000000 THEN CAST(round_even(num_vectors / 1e6, 0) AS BIGINT) || 'm'
                             WHEN num_vectors >= 1000 THEN CAST(round_even(num_vectors / 1e3, 0) AS BIGINT) || 'k'
                             ELSE CAST(num_vectors AS VARCHAR) END) AS corpus_size
        FROM size_requests r"""),
)
def pick_corpus_size(spark, sf):
    """J3; the third dataset has no size list."""
    picked = ex.pick_corpus_size(views.size_requests(spark, sf), _supported(spark))
    return picked.select("p_partkey", "num_vectors", "corpus_size")


@query(
    "pick_truth_k",
    with_views("size_requests", body="""
        SELECT p_partkey, query_k,
               CASE WHEN dataset = 'ds-0' THEN CASE WHEN query_k <= 10 THEN 10 WHEN query_k <= 100 THEN 100 ELSE query_k END
                    ELSE CASE WHEN query_k <= 100 THEN 100 ELSE query_k END END AS truth_k
        FROM size_requests"""),
)
def pick_truth_k(spark, sf):
    """J4; two datasets fall back to the default list."""
    supported = spark.createDataFrame([("ds-0", 10), ("ds-0", 100)], "dataset string, k bigint")
    return ex.pick_truth_k(views.size_requests(spark, sf), supported).select("p_partkey", "query_k", "truth_k")


@query(
    "pick_source_file",
    with_views("size_requests", body="""
        SELECT p_partkey, CASE WHEN num_vectors <= 1000 THEN 'documents-1k.hdf5.bz2' WHEN num_vectors <= 100000 THEN 'documents-100k.hdf5.bz2'
                               WHEN num_vectors <= 1000000 THEN 'documents-1m.hdf5.bz2' ELSE 'documents-10m.hdf5.bz2' END AS source_file
        FROM size_requests"""),
)
def pick_source_file(spark, sf):
    """J5."""
    return ex.pick_source_file(views.size_requests(spark, sf)).select("p_partkey", "source_file")


def _map(**values):
    """A parameter map without its null entries."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


def _knob(name, count):
    """``count`` sweep entries ``{name: 1 … count}``; an empty list for 0."""
    numbers = F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda i: F.create_map(F.lit(name), i.cast("string")))


def _suite_steps(spark, sf):
    """A suite is a customer, its steps are the orders. Suite sweeps: absent, empty, one or two by customer."""
    s = views.steps(spark, sf)
    kind, key = F.col("suite_id") % 4, F.col("step_id")
    return s.select(
        "suite_id", "step_id", F.col("step_id").alias("step_ord"), "dataset", "procedure",
        _map(corpus_size=F.col("corpus_size"), query_k=F.col("query_k")).alias("params"),
        _map(bulk=F.lit("500"), query_k=F.lit("7")).alias("suite_params"),
        F.when(kind == 1, _knob("m", F.lit(0).cast("bigint"))).when(kind >= 2, _knob("m", kind - 1)).alias("suite_sweeps"),
        F.when(key % 7 != 0, _knob("bulk", key % 3)).alias("step_sweeps"),
        F.when(key % 6 != 0, _knob("ef", key % 4)).alias("nested_sweeps"),
    )


_EXPANDED_SQL = """
    passes AS (
        SELECT s.*, p.m, CASE WHEN p.m IS NULL THEN 0 ELSE p.m - 1 END AS suite_sweep
        FROM steps s JOIN (VALUES (0, NULL), (2, 1), (3, 1), (3, 2)) AS p(kind, m) ON p.kind = s.suite_id % 4),
    expanded AS (
        SELECT p.*, b.bulk, CASE WHEN b.bulk IS NULL THEN 0 ELSE b.bulk - 1 END AS step_sweep,
               coalesce(query_k, '7') AS k
        FROM passes p JOIN (VALUES (0, NULL), (1, 1), (2, 1), (2, 2)) AS b(kind, bulk)
          ON b.kind = CASE WHEN step_id % 7 = 0 THEN 0 ELSE step_id % 3 END)"""


@query(
    "expand_sweeps",
    with_views("steps", body=f"""
        WITH {_EXPANDED_SQL}
        SELECT suite_id, step_id, CAST(suite_sweep AS BIGINT) AS suite_sweep, CAST(step_sweep AS BIGINT) AS step_sweep,
               row_number() OVER (PARTITION BY suite_id ORDER BY suite_sweep, step_id, step_sweep) AS position,
               CAST(coalesce(bulk, 500) AS VARCHAR) AS bulk, k AS query_k, CAST(m AS VARCHAR) AS m FROM expanded"""),
)
def expand_sweeps(spark, sf):
    """An empty suite list runs nothing, an empty step list one pass."""
    from probeline.operators.timeline import numbered

    p = F.col("params")
    return numbered(ex.expand_sweeps(_suite_steps(spark, sf)), ["suite_id"], ["ord"], "position").select(
        "suite_id", "step_id", "position", F.col("suite_sweep").cast("bigint").alias("suite_sweep"),
        F.col("step_sweep").cast("bigint").alias("step_sweep"),
        p["bulk"].alias("bulk"), p["query_k"].alias("query_k"), p["m"].alias("m"),
    )


@query(
    "expand_nested",
    with_views("steps", body="""
        SELECT suite_id, step_id, CAST(coalesce(e.ef, 1) AS BIGINT) AS sweep_index, 'sweep-' || e.ef AS sweep_name,
               CAST(e.ef AS VARCHAR) AS ef
        FROM steps s JOIN (VALUES (0, NULL), (1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)) AS e(kind, ef)
          ON e.kind = CASE WHEN step_id % 6 = 0 THEN 0 ELSE step_id % 4 END"""),
)
def expand_nested(spark, sf):
    """J14, third level."""
    out = ex.expand_nested(_suite_steps(spark, sf).withColumn("ord", F.col("step_ord")))
    return out.select(
        "suite_id", "step_id", F.col("sweep_index").cast("bigint").alias("sweep_index"), "sweep_name",
        F.col("params")["ef"].alias("ef"),
    )


@query(
    "derive_params",
    with_views("steps", body="""
        SELECT step_id, CASE WHEN corpus_size IS NULL THEN NULL WHEN step_id % 11 = 0 THEN 'given'
                             ELSE dataset || '-' || corpus_size END AS target_index_name,
               CASE WHEN corpus_size IS NULL OR procedure = 'create-index' THEN NULL
                    ELSE CAST(CAST(left(corpus_size, -1) AS BIGINT) * 1000000 AS VARCHAR) END AS num_vectors
        FROM steps"""),
)
def derive_params(spark, sf):
    """P13; every eleventh step names its table itself."""
    s = views.steps(spark, sf)
    given = F.when((F.col("step_id") % 11 == 0) & F.col("corpus_size").isNotNull(), F.lit("given"))
    s = s.withColumn("params", _map(corpus_size=F.col("corpus_size"), target_index_name=given))
    p = F.col("params")
    return ex.derive_params(s).select("step_id", p["target_index_name"].alias("target_index_name"), p["num_vectors"].alias("num_vectors"))


_LABEL_SQL = """regexp_replace(dataset, '^cohere-', '') || '-' || coalesce(corpus_size, '') || '-' || procedure
                || CASE WHEN query_k IS NULL THEN '' ELSE '-k' || query_k END"""


@query("step_label", with_views("steps", body=f"SELECT step_id, {_LABEL_SQL} AS label FROM steps"))
def step_label(spark, sf):
    """P12."""
    s = views.steps(spark, sf)
    label = text.step_label(F.col("dataset"), F.col("corpus_size"), F.col("procedure"), F.col("query_k"))
    return s.select("step_id", label.alias("label"))


@query(
    "dedupe_labels",
    with_views("steps", body=f"""
        WITH l AS (SELECT suite_id % 3 AS suite_id, step_id, {_LABEL_SQL} AS label FROM steps),
        n AS (SELECT *, row_number() OVER (PARTITION BY suite_id, label ORDER BY step_id) AS n FROM l)
        SELECT suite_id, step_id, CASE WHEN n > 1 THEN label || '-' || n ELSE label END AS label FROM n"""),
)
def dedupe_labels(spark, sf):
    """W2 in three large suites."""
    s = views.steps(spark, sf)
    label = text.step_label(F.col("dataset"), F.col("corpus_size"), F.col("procedure"), F.col("query_k"))
    s = s.select((F.col("suite_id") % 3).alias("suite_id"), "step_id", label.alias("label"))
    return ex.dedupe_labels(s, order=["step_id"])


@query(
    "label_versions",
    """WITH v AS (SELECT o_custkey AS suite_id, o_orderkey AS version_ord, '3.' || (o_orderkey % 5) || '.0' AS version FROM orders)
       SELECT suite_id, version_ord, CASE WHEN count(*) OVER (PARTITION BY suite_id, version) > 1
                THEN version || '_run' || row_number() OVER (PARTITION BY suite_id, version ORDER BY version_ord)
                ELSE version END AS version_label FROM v""",
)
def label_versions(spark, sf):
    """W3."""
    key = F.col("o_orderkey")
    v = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("suite_id"), key.alias("version_ord"), F.concat(F.lit("3."), key % 5, F.lit(".0")).alias("version")
    )
    return ex.label_versions(v).select("suite_id", "version_ord", "version_label")


@query(
    "run_matrix",
    """WITH v AS (
         SELECT c_custkey AS suite_id, v.ord AS version_ord, v.version FROM customer JOIN
           (VALUES (0, 0, '3.9.0'), (1, 0, '3.7.0'), (2, 0, '3.7.0'), (2, 1, '3.7.0'), (3, 0, '3.6.0'), (3, 1, '3.7.0')) AS v(kind, ord, version)
           ON v.kind = c_custkey % 4),
       l AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY suite_id, version) > 1
                            THEN version || '_run' || row_number() OVER (PARTITION BY suite_id, version ORDER BY version_ord)
                            ELSE version END AS version_label FROM v),
       s AS (SELECT * FROM (VALUES (0, 0, 'small'), (1, 0, 'medium'), (1, 1, 'large')) AS s(kind, size_ord, node_size))
       SELECT suite_id, CAST(version_ord AS BIGINT) AS version_ord, version_label, CAST(size_ord AS BIGINT) AS size_ord, node_size, engine
       FROM l JOIN s ON s.kind = suite_id % 2, (VALUES ('graph'), ('disk')) AS e(engine)""",
)
def run_matrix(spark, sf):
    """Absent versions and sizes take the defaults."""
    key = F.col("c_custkey")
    kind = key % 4
    lists = lambda *v: F.array(*[F.lit(x) for x in v])
    suites = table(spark, sf, "customer").select(
        key.alias("suite_id"),
        F.when(kind == 1, lists("3.7.0")).when(kind == 2, lists("3.7.0", "3.7.0")).when(kind == 3, lists("3.6.0", "3.7.0")).alias("versions"),
        F.when(key % 2 == 1, lists("medium", "large")).otherwise(F.array().cast("array<string>")).alias("node_sizes"),
    )
    return ex.run_matrix(suites, ["graph", "disk"], "3.9.0").select(
        "suite_id", F.col("version_ord").cast("bigint").alias("version_ord"), "version_label",
        F.col("size_ord").cast("bigint").alias("size_ord"), "node_size", "engine",
    )


@query(
    "concat_steps",
    """SELECT suite_id, row_number() OVER (PARTITION BY suite_id ORDER BY part, step_ord) AS position, step_id FROM (
         SELECT o_custkey AS suite_id, 0 AS part, o_orderkey AS step_ord, o_orderkey AS step_id FROM orders WHERE o_orderstatus = 'F'
         UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F')""",
)
def concat_steps(spark, sf):
    """Finished orders as first-run steps."""
    from probeline.operators.timeline import numbered

    key = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("suite_id"), key.alias("step_ord"), key.alias("step_id"), "o_orderstatus"
    )
    both = ex.concat_steps(s.filter("o_orderstatus = 'F'"), s.filter("o_orderstatus <> 'F'"))
    # part and step in one sortable number
    place = F.shiftleft(F.col("part").cast("bigint"), 50) + F.col("step_ord")
    return numbered(both.withColumn("place", place), ["suite_id"], ["place"], "position").select("suite_id", "position", "step_id")


_RESOLVED = "resolved AS (SELECT run_id, key, arg_max(value, layer) AS value FROM param_layers GROUP BY run_id, key)"


@query("resolve_layers", with_views("param_layers", body=f"WITH {_RESOLVED} SELECT * FROM resolved"))
def resolve_layers(spark, sf):
    """W13."""
    return ex.resolve_layers(views.param_layers(spark, sf))


@query(
    "resolve_layers_legacy",
    with_views("param_layers", body="""
        SELECT run_id, key, arg_max(value, CASE layer WHEN 3 THEN 5.5 ELSE layer END) AS value FROM param_layers GROUP BY run_id, key"""),
)
def resolve_layers_legacy(spark, sf):
    """W13 with procedure parameters copied above the sweeps."""
    return ex.resolve_layers(views.param_layers(spark, sf), legacy=True)


@query(
    "resolve_templates",
    with_views("param_layers", body="""
        SELECT run_id, layer, key, replace(value, '{{corpus_size}}', (1 + run_id % 9) || 'm') AS value FROM param_layers"""),
)
def resolve_templates(spark, sf):
    """P7."""
    size = F.concat(1 + F.col("run_id") % 9, F.lit("m"))
    value = ex.resolve_templates(F.col("value"), {"corpus_size": size, "query_k": F.lit(10)})
    return views.param_layers(spark, sf).select("run_id", "layer", "key", value.alias("value"))


@query("drop_credentials", with_views("param_layers", body="SELECT * FROM param_layers WHERE key NOT IN ('username', 'password')"))
def drop_credentials(spark, sf):
    """P21."""
    return ex.drop_credentials(views.param_layers(spark, sf))


@query(
    "finalize_params",
    with_views("param_layers", body=f"""
        WITH {_RESOLVED}
        SELECT * FROM resolved WHERE key NOT IN ('corpus_name', 'corpus_size')
        UNION ALL SELECT c_custkey, 'num_vectors', CAST(c_custkey * 1000 AS VARCHAR) FROM customer
        WHERE c_custkey NOT IN (SELECT run_id FROM resolved WHERE key = 'num_vectors')"""),
)
def finalize_params(spark, sf):
    """P22."""
    counts = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") * 1000).alias("num_vectors"))
    return ex.finalize_params(ex.resolve_layers(views.param_layers(spark, sf)), counts)


_CATALOG = [("cohere-ds-0", "vector-search"), ("cohere-ds-0", "create-index"), ("cohere-ds-1", "vector-search"), ("cohere-ds-2", "bulk-ingest-data")]
_CATALOG_SQL = "(VALUES ('cohere-ds-0', 'vector-search'), ('cohere-ds-0', 'create-index'), ('cohere-ds-1', 'vector-search'), ('cohere-ds-2', 'bulk-ingest-data')) AS c(dataset, procedure)"


def _catalog(spark):
    return spark.createDataFrame(_CATALOG, "dataset string, procedure string")


@query("accepted_requests", with_views("steps", body=f"SELECT step_id FROM steps WHERE (dataset, procedure) IN (SELECT (dataset, procedure) FROM {_CATALOG_SQL})"))
def accepted_requests(spark, sf):
    """J9, the semi join."""
    return ex.split_valid(views.steps(spark, sf), _catalog(spark), ["dataset", "procedure"])[0].select("step_id")


@query("rejected_requests", with_views("steps", body=f"SELECT step_id FROM steps WHERE (dataset, procedure) NOT IN (SELECT (dataset, procedure) FROM {_CATALOG_SQL})"))
def rejected_requests(spark, sf):
    """J9, the anti join."""
    return ex.split_valid(views.steps(spark, sf), _catalog(spark), ["dataset", "procedure"])[1].select("step_id")


@query(
    "validate_requests",
    with_views("steps", body=f"""
        SELECT step_id, CASE WHEN step_id % 13 = 0 THEN 'dataset or procedure missing' WHEN step_id % 7 = 0 THEN 'params is not an object'
               WHEN (dataset, procedure) NOT IN (SELECT (dataset, procedure) FROM {_CATALOG_SQL}) THEN 'unknown procedure for dataset'
               WHEN suite_id % 3 = 2 THEN 'engine not supported for dataset' END AS reason FROM steps"""),
)
def validate_requests(spark, sf):
    """P20."""
    s = views.steps(spark, sf)
    key = F.col("step_id")
    requests = s.select(
        "step_id", F.when(key % 13 != 0, F.col("dataset")).alias("dataset"), "procedure",
        F.element_at(F.array(*[F.lit(e) for e in views.ENGINES]), (1 + F.col("suite_id") % 3).cast("int")).alias("engine"),
        F.when(key % 7 == 0, F.lit("[1, 2]")).when(key % 2 == 0, F.lit('{"a": 1}')).alias("params"),
    )
    engines = spark.createDataFrame([(d, e) for d, _ in _CATALOG for e in ("graph", "disk")], "dataset string, engine string")
    return ex.validate(requests, _catalog(spark), engines).select("step_id", "reason")


@query(
    "discover",
    """WITH e AS (SELECT DISTINCT c_custkey AS dataset, ['graph', 'disk', 'flat'][1 + o_orderkey % 3] AS engine,
                         CASE WHEN o_custkey % 5 = 0 OR o_orderkey % 4 = 0 THEN 'legacy' ELSE 'current' END AS source
                  FROM customer JOIN orders ON o_custkey = c_custkey),
       l AS (SELECT dataset, string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (WHERE source <> 'legacy') AS modern,
                    string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (WHERE source = 'legacy') AS old FROM e GROUP BY dataset),
       p AS (SELECT DISTINCT o_custkey AS dataset, ['create-index', 'bulk-ingest-data', 'vector-search'][1 + o_orderkey % 3] AS procedure,
                    CASE WHEN o_orderkey % 3 = 2 THEN 4 END AS sweep_count FROM orders)
       SELECT c_custkey AS dataset, coalesce(modern, old, '') AS engines, procedure, sweep_count IS NOT NULL AS has_sweeps,
              CAST(coalesce(sweep_count, 0) AS BIGINT) AS sweep_count
       FROM customer LEFT JOIN l ON l.dataset = c_custkey LEFT JOIN p ON p.dataset = c_custkey""",
)
def discover(spark, sf):
    """A11 with customers as datasets."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    nth = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (1 + key % 3).cast("int"))
    engines = o.select(
        cust.alias("dataset"), nth(views.ENGINES).alias("engine"),
        F.when((cust % 5 == 0) | (key % 4 == 0), "legacy").otherwise("current").alias("source"),
    )
    procedures = o.select(
        cust.alias("dataset"), nth(views.PROCEDURES).alias("procedure"), F.when(key % 3 == 2, F.lit(4).cast("bigint")).alias("sweep_count")
    ).distinct()
    datasets = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset"))
    return ex.discover(datasets, engines, procedures).withColumn("engines", F.array_join("engines", ","))


@query(
    "file_completeness",
    """WITH e AS (SELECT 'file-' || p_partkey AS name, p_partkey,
                         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 4100 * (1 + p_partkey) END AS expected_bytes FROM part),
       i AS (SELECT 'file-' || p_partkey AS name, 4100 * (1 + p_partkey) - CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS bytes
             FROM part WHERE p_type <> 'ECONOMY')
       SELECT e.name, CASE WHEN bytes IS NULL THEN 'missing' WHEN expected_bytes IS NULL OR expected_bytes = bytes THEN 'present'
                           ELSE 'mismatch' END AS state FROM e LEFT JOIN i ON i.name = e.name""",
)
def file_completeness(spark, sf):
    """J15."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    name = F.concat(F.lit("file-"), key).alias("name")
    expected = p.select(name, F.when(key % 5 != 0, units.byte_range(1 + key, 1024)).alias("range"))
    inventory = p.filter(F.col("p_type") != "ECONOMY").select(name, (4100 * (1 + key) - F.when(key % 3 == 0, 1).otherwise(0)).alias("bytes"))
    return ex.file_completeness(expected, inventory).select("name", "state")


@query(
    "user_tags",
    """SELECT p_partkey, concat_ws(',', 'dataset:' || p_brand, 'num_vectors:' || (p_partkey * 10),
                CASE WHEN p_partkey % 2 = 0 THEN 'dimension:' || p_size END,
                CASE WHEN p_partkey % 3 = 0 THEN 'query_k:' || p_type END, 'ef_search:128') AS tags FROM part""",
)
def user_tags(spark, sf):
    """The count and the search knob are taken under either of their two names."""
    key = F.col("p_partkey")
    absent = F.lit(None).cast("string")
    tags = text.user_tags(
        {
            "query_k": F.when(key % 3 == 0, F.col("p_type")),
            "dataset": F.col("p_brand"),
            "num_vectors": F.coalesce(absent, (key * 10).cast("string")),
            "dimension": F.when(key % 2 == 0, F.col("p_size")),
            "ef_search": F.coalesce(absent, F.lit("128")),
        }
    )
    return table(spark, sf, "part").select("p_partkey", tags.alias("tags"))
