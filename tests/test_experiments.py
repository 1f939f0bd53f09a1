import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from probeline.operators import experiments as ex

SUITE = {
    "description": "d",
    "engine": "__ENGINE__",
    "params": {"corpus_size": "1m", "bulk": 500, "username": "u"},
    "parameter_sweeps": [{"params": {"m": 8}}, {"params": {"m": 16}}],
    "versions": ["3.7.0", "3.7.0"],
    "first_run_steps": [{"dataset": "cohere-a", "scenario": "create-index"}],
    "steps": [
        {"dataset": "cohere-a", "scenario": "bulk-ingest-data", "params": {"bulk": 5000}},
        {
            "dataset": "cohere-a", "scenario": "vector-search",
            "params": {"query_k": 64, "body": {"a": [1, 2]}, "parameter_sweeps": [{"params": {"f": 5}}, {"params": {"f": 8}}]},
            "parameter_sweeps": [{"params": {"ef": 128}}, {"params": {"ef": 256, "query_k": 10}}],
        },
    ],
}


def suites(spark, *documents):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "suite_id bigint, document string")


def steps_of(spark, *documents, **kw):
    return ex.suite_steps(ex.parse_suites(suites(spark, *documents), "graph"), **kw)


def test_suite_to_runs(spark):
    assert ex.parse_suites(suites(spark, SUITE), "graph").first()["engine"] == "graph"
    steps = ex.dedupe_labels(ex.label_steps(ex.derive_params(ex.expand_sweeps(steps_of(spark, SUITE)))))
    got = steps.orderBy("ord").collect()
    assert [r["label"] for r in got] == [
        "a-1m-bulk-ingest-data", "a-1m-vector-search-k64", "a-1m-vector-search-k10",
        "a-1m-bulk-ingest-data-2", "a-1m-vector-search-k64-2", "a-1m-vector-search-k10-2",
    ]
    assert [r["params"]["m"] for r in got] == ["8"] * 3 + ["16"] * 3
    assert got[0]["params"]["bulk"] == "5000" and got[1]["params"]["bulk"] == "500"
    assert got[1]["params"]["target_index_name"] == "cohere-a-1m" and got[1]["params"]["num_vectors"] == "1000000"
    assert json.loads(got[1]["params"]["body"]) == {"a": [1, 2]}
    assert "parameter_sweeps" not in got[1]["params"]
    runs = ex.expand_nested(steps).filter("procedure = 'vector-search'").orderBy("ord", "sweep_index").collect()
    assert [(r["sweep_name"], r["params"]["f"]) for r in runs][:2] == [("sweep-1", "5"), ("sweep-2", "8")]
    assert len(runs) == 8
    plain = ex.expand_nested(steps).filter("procedure <> 'vector-search'").first()
    assert (plain["sweep_name"], plain["sweep_index"]) == (None, 1)


def test_first_run_steps(spark):
    assert [r["procedure"] for r in steps_of(spark, SUITE, first_run=True).orderBy("step_ord").collect()] == [
        "create-index", "bulk-ingest-data", "vector-search"]
    bare = {k: v for k, v in SUITE.items() if k != "first_run_steps"}
    assert steps_of(spark, bare, first_run=True).count() == 2


def test_empty_lists(spark):
    none = {**SUITE, "parameter_sweeps": []}
    assert ex.expand_sweeps(steps_of(spark, none)).count() == 0
    absent = {k: v for k, v in SUITE.items() if k != "parameter_sweeps"}
    absent["steps"] = [{"dataset": "d", "scenario": "s", "parameter_sweeps": [], "params": {"parameter_sweeps": []}}]
    got = ex.expand_sweeps(steps_of(spark, absent))
    assert got.count() == 1 and ex.expand_nested(got).count() == 1


def test_bad_size_is_named(spark):
    bad = {"steps": [{"dataset": "d", "scenario": "vector-search", "params": {"corpus_size": "1.5m"}}]}
    row = ex.derive_params(ex.expand_sweeps(steps_of(spark, bad))).first()
    assert row["reject_reason"] == "unrecognised corpus size" and "num_vectors" not in row["params"]


@pytest.mark.parametrize("labels, want", [(["a", "b", "a", "a"], ["a", "b", "a-2", "a-3"])])
def test_dedupe(spark, labels, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "suite_id int, ord bigint, label string")
    assert [r["label"] for r in ex.dedupe_labels(df, slices=3).orderBy("ord").collect()] == want


@pytest.mark.parametrize("versions, want", [(["3.7.0", "3.7.0"], ["3.7.0_run1", "3.7.0_run2"]), (["3.6.0", "3.7.0"], ["3.6.0", "3.7.0"])])
def test_versions(spark, versions, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(versions)], "suite_id int, version_ord bigint, version string")
    assert [r["version_label"] for r in ex.label_versions(df).orderBy("version_ord").collect()] == want


def test_matrix(spark):
    parsed = ex.parse_suites(suites(spark, SUITE, {"steps": [], "node_sizes": []}), "graph")
    got = ex.run_matrix(parsed, ["x", "y"], "9").orderBy("suite_id", "engine_ord", "version_ord", "size_ord").select("suite_id", "engine", "version_label", "node_size")
    assert rows(got, "suite_id", "engine", "version_label") == [
        (0, "x", "3.7.0_run1", "small"), (0, "x", "3.7.0_run2", "small"), (0, "y", "3.7.0_run1", "small"), (0, "y", "3.7.0_run2", "small"),
        (1, "x", "9", "small"), (1, "y", "9", "small")]


def layered(spark):
    data = [("r", 1, "k", "common"), ("r", 3, "k", "procedure"), ("r", 4, "k", "procedure.engine"), ("r", 5, "ef", "sweep"),
            ("r", 3, "ef", "128"), ("r", 6, "x", "runtime"), ("r", 5, "x", "sweep")]
    return spark.createDataFrame(data, "run_id string, layer int, key string, value string")


def test_layers(spark):
    assert rows(ex.resolve_layers(layered(spark)).select("key", "value")) == [("ef", "sweep"), ("k", "procedure.engine"), ("x", "runtime")]


def test_legacy_layers_mask_sweeps_and_engine_params(spark):
    assert rows(ex.resolve_layers(layered(spark), legacy=True).select("key", "value")) == [("ef", "128"), ("k", "procedure"), ("x", "runtime")]


def test_templates_and_finalize(spark):
    df = spark.createDataFrame([("r", "path", '{"f": "{{base_url}}/k{{query_k}}_{{corpus_size}}"}'), ("r", "corpus_size", "1m"), ("s", "num_vectors", "5")],
                               "run_id string, key string, value string")
    value = ex.resolve_templates(F.col("value"), {"corpus_size": F.lit("5m"), "query_k": F.lit(100), "base_url": F.lit("u")})
    out = df.withColumn("value", value)
    counts = spark.createDataFrame([("r", 7), ("s", 8)], "run_id string, num_vectors bigint")
    got = ex.finalize_params(out, counts)
    assert rows(got) == [("r", "num_vectors", "7"), ("r", "path", '{"f": "u/k100_5m"}'), ("s", "num_vectors", "5")]


def test_credentials(spark):
    df = spark.createDataFrame([("r", "username", "u"), ("r", "password", "p"), ("r", "k", "1")], "run_id string, key string, value string")
    assert rows(ex.drop_credentials(df)) == [("r", "k", "1")]


def requests(spark, column, *values):
    return spark.createDataFrame([("d", v) for v in values], f"dataset string, {column} bigint")


def test_pick_corpus_size(spark):
    supported = spark.createDataFrame([("d", "10m"), ("d", "1m"), ("d", "5m")], "dataset string, corpus_size string")
    got = ex.pick_corpus_size(requests(spark, "num_vectors", 1000000, 2000000, 11000000), supported)
    assert rows(got.select("num_vectors", "corpus_size"), "num_vectors") == [(1000000, "1m"), (2000000, "5m"), (11000000, "10m")]
    other = ex.pick_corpus_size(requests(spark, "num_vectors", 50000), supported.filter("dataset = 'x'"))
    assert other.first()["corpus_size"] == "50k"


def test_pick_truth_k(spark):
    supported = spark.createDataFrame([("d", 100), ("d", 10)], "dataset string, k bigint")
    got = ex.pick_truth_k(requests(spark, "query_k", 10, 64, 500), supported)
    assert rows(got.select("query_k", "truth_k"), "query_k") == [(10, 10), (64, 100), (500, 500)]
    assert ex.pick_truth_k(requests(spark, "query_k", 64), supported.filter("k = 0")).first()["truth_k"] == 100


def test_pick_source_file(spark):
    got = ex.pick_source_file(requests(spark, "num_vectors", 1000, 1001, 20000000))
    assert rows(got.select("num_vectors", "source_file"), "num_vectors") == [
        (1000, "documents-1k.hdf5.bz2"), (1001, "documents-100k.hdf5.bz2"), (20000000, "documents-10m.hdf5.bz2")]


def test_files(spark):
    expected = spark.createDataFrame([("a", "0-99"), ("b", "0-99"), ("c", None), ("d", "0-9")], "name string, range string")
    inventory = spark.createDataFrame([("a", 100), ("b", 99), ("c", 5)], "name string, bytes bigint")
    got = ex.file_completeness(expected, inventory).select("name", "state", "fetch")
    assert rows(got) == [("a", "present", False), ("b", "mismatch", True), ("c", "present", False), ("d", "missing", True)]


def test_discover_prefers_current_engines(spark):
    datasets = spark.createDataFrame([("d",), ("l",), ("n",)], "dataset string")
    engines = spark.createDataFrame([("d", "a", "current"), ("d", "z", "legacy"), ("l", "z", "legacy")], "dataset string, engine string, source string")
    procedures = spark.createDataFrame([("d", "p", 3), ("d", "q", None)], "dataset string, procedure string, sweep_count int")
    got = ex.discover(datasets, engines, procedures).select("dataset", "procedure", "engines", "has_sweeps", "sweep_count")
    assert rows(got) == [("d", "p", ["a"], True, 3), ("d", "q", ["a"], False, 0), ("l", None, ["z"], False, 0), ("n", None, [], False, 0)]


def test_layers_are_spread_before_they_are_sorted(spark):
    params = spark.range(40).select((F.col("id") % 4).alias("run_id"), (F.col("id") % 6 + 1).cast("int").alias("layer"), F.lit("k").alias("key"), F.col("id").cast("string").alias("value")).coalesce(1)
    for legacy in (False, True):
        found = ex.resolve_layers(params, legacy=legacy)
        steps = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in x or "Exchange" in x]
        assert "partial_max_by" in steps[-2] and "Exchange hashpartitioning" in steps[-1]
    tied = spark.createDataFrame([(1, x, "k", f"v{x}") for x in (2, 3, 5, 6)] + [(2, x, "k", f"v{x}") for x in (3, 4, 5)] + [(3, None, "k", "v"), (None, 1, None, None)], "run_id long, layer int, key string, value string")
    plain = {r["run_id"]: r["value"] for r in ex.resolve_layers(tied).collect()}
    assert plain == {1: "v6", 2: "v5", 3: None, None: None}
    assert {r["run_id"]: r["value"] for r in ex.resolve_layers(tied, legacy=True).collect()} == {1: "v6", 2: "v3", 3: None, None: None}
