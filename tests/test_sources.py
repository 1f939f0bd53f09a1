import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from probeline.operators import reports, tables
from probeline.sources import binary, trees, vecfiles


def test_fvec_and_ivec(spark, tmp_path):
    rng = np.random.default_rng(0)
    vectors, ids = rng.normal(size=(1000, 6)).astype("<f4"), rng.integers(0, 99, size=(50, 4)).astype("<i4")
    for name, values in (("a.fvec", vectors), ("a.ivec", ids)):
        with open(tmp_path / name, "wb") as f:
            for v in values:
                f.write(np.int32(len(v)).tobytes() + v.tobytes())
    got = binary.read_fvec(spark, str(tmp_path / "a.fvec"), 6).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(1000))
    assert np.array_equal(np.array([r["embedding"] for r in got], dtype="<f4"), vectors)
    truth = binary.truth_rows(binary.read_ivec(spark, str(tmp_path / "a.ivec"), 4))
    want = [(q, r + 1, int(v)) for q, row in enumerate(ids) for r, v in enumerate(row)]
    assert rows(truth, "query_id", "rank") == want
    with pytest.raises(Exception, match="header"):
        binary.read_fvec(spark, str(tmp_path / "a.ivec"), 9).count() or binary.read_fvec(spark, str(tmp_path / "a.ivec"), 9).collect()


def numbered(spark, n, width=5):
    rng = np.random.default_rng(n)
    values = rng.normal(size=(n, width)).astype("<f4")
    return values, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>").repartition(4)


def test_vector_files_round_trip(spark, tmp_path):
    values, df = numbered(spark, 500)
    path = str(tmp_path / "corpus")
    binary.write_records(df.filter("vec_id < 300"), path, 5, files=3)
    binary.write_records(df.filter("vec_id >= 300"), path, 5, files=2)  # goes behind what is there
    got = binary.read_fvec(spark, path, 5).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(500))
    assert np.array_equal(np.array([r["embedding"] for r in got], "<f4"), values)
    assert binary.read_fvec(spark, path, 5).filter("vec_id in (3, 499, 700) and embedding[0] is not null").count() == 2
    binary.write_records(df.filter("vec_id < 7"), path, 5, mode="overwrite")
    assert binary.read_fvec(spark, path, 5).count() == 7


def test_a_prefix_reads_only_its_bytes(spark, tmp_path, monkeypatch):
    files = [("a", 24 * 10), ("b", 24 * 1000), ("c", 24 * 5)]
    planned = vecfiles.ranges(files, 24, 4, 600, 24 * 256)
    assert [(r.path, r.skip, r.count, r.first) for r in planned] == [("a", 4, 6, 4), ("b", 0, 256, 10), ("b", 256, 256, 266), ("b", 512, 78, 522)]
    assert vecfiles.ranges(files, 24, 1012, None)[0].count == 3 and vecfiles.ranges(files, 24, 5, 5) == []
    with pytest.raises(ValueError, match="multiple"):
        vecfiles.ranges([("a", 25)], 24, 0, None)
    values, df = numbered(spark, 400)
    path = str(tmp_path / "corpus")
    binary.write_records(df, path, 5, files=4)
    names = [n for n, _ in vecfiles.data_files(path)]
    with open(names[-1], "r+b") as last:  # a broken record that a prefix must not meet
        last.write(b"\0\0\0\0")
    prefix = tables.corpus_prefix(binary.read_fvec(spark, path, 5), 50)
    assert prefix.count() == 50 and prefix.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="header"):
        binary.read_fvec(spark, path, 5).agg(F.sum("vec_id"), F.max("embedding")).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    values, df = numbered(spark, 200)
    path = str(tmp_path / "corpus")
    binary.write_records(df, path, 5, files=2)
    wrong = df.withColumn("embedding", F.when(F.col("vec_id") == 150, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="5 values"):
            binary.write_records(wrong, path, 5, files=4, mode=mode)
        assert binary.read_fvec(spark, path, 5).count() == 200
    with pytest.raises(Exception, match="distinct ids"):
        binary.write_records(df.union(df), path, 5, files=2)
    assert len(vecfiles.data_files(path)) == 2


def test_result_tree(spark, tmp_path):
    root = tmp_path / "results"
    a = root / "job-1" / "graph" / "ds-k10" / "sweep-1"
    b = root / "job-1" / "graph" / "ds-k10" / "sweep-2"
    c = root / "job-2" / "disk" / "ds-create"
    for d in (a, b, c):
        d.mkdir(parents=True)
    (a / "test_run.json").write_text('{"x": 1}')
    (a / "workload-params.json").write_text('{"k": 10}')
    (a / "benchmark.log").write_bytes(b"".join(b"line %d\n" % i for i in range(250)) + b"bad \xff byte\n")
    (b / "test_run.json").write_text("{broken")
    (c / "k8s_metrics.json").write_text("{}")
    (c / "server_stats.json").write_text("{}")
    got = {(r["job"], r["sweep_name"]): r for r in trees.scan_results(spark, str(root), 3).collect()}
    assert set(got) == {("job-1", "sweep-1"), ("job-1", "sweep-2"), ("job-2", None)}
    one = got[("job-1", "sweep-1")]
    assert (one["engine"], one["step"], one["test_run"], one["workload_params"], one["k8s_metrics"]) == ("graph", "ds-k10", '{"x": 1}', '{"k": 10}', None)
    assert one["benchmark_log"] == "line 248\nline 249\nbad  byte"
    two = got[("job-1", "sweep-2")]
    assert two["test_run"] is None and two["bad_artifacts"] == ["test_run.json"] and two["benchmark_log"] is None
    assert got[("job-2", None)]["k8s_metrics"] == "{}"
    shown = reports.artifact_presence(trees.scan_results(spark, str(root))).select("sweep_name", "has_test_run", "has_workload_params")
    assert (("sweep-1", True, True)) in rows(shown)


def test_log_tail_over_splits(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    (log / "big.log").write_text("".join(f"{i:06d} some text in the line\n" for i in range(20000)))
    (log / "small.log").write_text("only\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50000)
    try:
        got = {r["path"].rsplit("/", 1)[1]: r["tail"] for r in trees.log_tail(spark, str(log), 2500).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(line[:6]) for line in got["big.log"].split("\n")] == list(range(17500, 20000))
    assert got["small.log"] == "only"


def test_inventory_and_samples(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("12345")
    (tmp_path / "a" / "README").write_text("1")
    got = trees.file_inventory(spark, str(tmp_path / "a")).select("name", "type", "bytes")
    assert rows(got) == [("README", None, 1), ("x.json", "json", 5)]
    assert "content" not in trees.file_inventory(spark, str(tmp_path / "a"))._jdf.queryExecution().executedPlan().toString()
    line = {"ts": "2024-01-01T00:00:00Z", "node": "n", "heap_used_pct": 5, "gc_old_ms": None, "load_1m": 0.5}
    (tmp_path / "s.ndjson").write_text(json.dumps(line) + "\n")
    row = trees.read_node_samples(spark, str(tmp_path / "s.ndjson")).first()
    assert len(row) == 20 and row["heap_used_pct"] == 5.0 and row["gc_old_ms"] is None and row["cpu_pct"] is None


def test_read_cat(spark):
    lines = spark.createDataFrame([("index    health  docs",), ("a-1   green  10",), ("",), ("  b-2 red",)], "value string")
    got = trees.read_cat(lines, ["index", "health", "docs"], "index")
    assert rows(got) == [("a-1", "green", "10"), ("b-2", "red", None)]


def test_monthly(spark, tmp_path):
    df = spark.createDataFrame([("2024-10-05", 1), ("2024-01-31", 2), ("2024-10-06", 3)], "d string, v int").withColumn("ts", F.to_timestamp("d"))
    trees.write_monthly(df, str(tmp_path), "metrics")
    trees.write_monthly(df.filter("v = 2"), str(tmp_path), "metrics")
    back = trees.read_monthly(spark, str(tmp_path), "metrics")
    assert rows(back.select("month", "v")) == [("2024.01", 2), ("2024.01", 2), ("2024.10", 1), ("2024.10", 3)]
    with pytest.raises(ValueError):
        trees.write_monthly(df, str(tmp_path), "other")


def test_export_documents(spark, tmp_path):
    jobs = spark.createDataFrame([("j1", "completed"), ("j2", "failed")], "job string, status string")
    sweeps = spark.createDataFrame([("j1", i, f"s{i}") for i in range(5)], "job string, ord bigint, name string")
    documents = trees.results_documents(jobs, sweeps, sweeps_per_part=2)
    path = str(tmp_path / "out")
    trees.export_results(documents, path)
    texts = [json.loads(r["value"]) for r in spark.read.text(path).filter("job = 'j1'").collect()]
    texts.sort(key=lambda t: t["part"])
    assert [s["name"] for t in texts for s in t["sweeps"]] == [f"s{i}" for i in range(5)]
    assert [bool(t.get("job")) for t in texts] == [True, False, False]
    only = [json.loads(r["value"]) for r in spark.read.text(path).filter("job = 'j2'").collect()]
    assert only == [{"job_id": "j2", "part": 0, "job": {"job": "j2", "status": "failed"}, "sweeps": []}]


def test_metrics_payload(spark, tmp_path):
    header = spark.createDataFrame([("s", "ns", 3)], "scenario string, namespace string, total_samples long")
    nodes = spark.createDataFrame([("s", "n1", 0.5), ("s", "n2", 0.7)], "scenario string, node string, cpu_avg double")
    pods = spark.createDataFrame([("s", "p", 0, ["1m", "2m"]), ("s", "p", 1, ["3m"])], "scenario string, pod string, chunk long, cpu_samples array<string>")
    gc = spark.createDataFrame([("s", i, "n1", i * 2) for i in range(5)], "scenario string, ts long, node string, heap int")
    documents = trees.metrics_documents(header, nodes, pods, gc, rows_per_part=2)
    trees.write_metrics_payload(documents, str(tmp_path / "out"))
    merged, parts = {"nodes": {}, "pods": {}, "gc_timeline": []}, []
    for r in spark.read.text(str(tmp_path / "out")).collect():
        parts.append(json.loads(r["value"]))
    for p in sorted(parts, key=lambda p: p["part"]):
        if p["section"] == "header":
            assert p["header"] == {"namespace": "ns", "total_samples": 3}
        elif p["section"] == "gc_timeline":
            merged["gc_timeline"] += p["gc_timeline"]
        elif p["section"] == "pods":
            for pod, lists in p["pods"].items():
                merged["pods"].setdefault(pod, []).extend(lists["cpu_samples"])
        else:
            merged["nodes"].update(p["nodes"])
    assert merged["nodes"] == {"n1": {"cpu_avg": 0.5}, "n2": {"cpu_avg": 0.7}}
    assert merged["pods"] == {"p": ["1m", "2m", "3m"]}
    assert [g["ts"] for g in merged["gc_timeline"]] == list(range(5))


def test_vector_table(spark):
    name = "probe_vectors"
    tables.drop_vector_table(spark, name)
    tables.create_vector_table(spark, name, 2, "l2", 3)
    data = [(i, [float(i), 1.0]) for i in range(100)] + [(100, [1.0]), (101, None), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    assert tables.rejected_vectors(vectors, 2).count() == 3
    part = tables.corpus_prefix(vectors, 60)
    tables.ingest(part, name, files_per_shard=2)
    short = tables.verify_count(spark, name, 100).first()
    assert (short["actual_docs"], short["shortfall"], short["complete"]) == (60, 40, False)
    good = vectors.filter("vec_id < 100")
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(3).cast("bigint")).cast("int").alias("shard")
    expected = good.groupBy(shard).agg(F.count(F.lit(1)).alias("expected_docs"))
    failing = tables.verify_count(spark, name, expected).filter("not complete")
    assert failing.agg(F.sum("shortfall")).first()[0] == 40
    tables.ingest(tables.retry_shards(good, name, failing), name, files_per_shard=2)
    assert tables.verify_count(spark, name, 100).first()["complete"]
    files = lambda: spark.table(name).select("shard", "_metadata.file_path").distinct().groupBy("shard").count().agg(F.max("count")).first()[0]
    assert files() > 1
    tables.compact(spark, name)
    assert files() == 1 and spark.table(name).count() == 100
    assert tables.table_properties(spark, name) == {"dimension": "2", "space_type": "l2", "shards": "3"}
    shot = tables.snapshot_table(spark, name, "graph").first()
    assert json.loads(shot["stats"])["docs"] == 100 and json.loads(shot["stats"])["segments"] == 3
    tables.drop_vector_table(spark, name)
    gone = tables.snapshot_table(spark, name, "graph").first()
    assert "error" in json.loads(gone["stats"])


def test_result_tree_is_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "a b+%25"
    for path, body in {
        "j/e/s/test_run.json": b"", "j/e/s/benchmark.log": b"\xef\xbb\xbfone\r\ntwo\rthree", "j/e/s/sweep-1/test_run.json": b'{"x": 1}', "j/e/s/other-1/test_run.json": b"{}",
        "j/e/s/sweep-1/deep/test_run.json": b"{}", "j/_e/s/test_run.json": b"{}", ".j/e/s/test_run.json": b"{}", "j/test_run.json": b"{}", "j/e/_s=1/test_run.json": b"{}", "j/e/t/benchmark.log": b"",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    found = trees.scan_results(spark, f"file:{root}/")
    assert rows(found.select("job", "engine", "step", "sweep_name", "test_run", "benchmark_log")) == [
        ("j", "e", "_s=1", None, "{}", None), ("j", "e", "s", "sweep-1", '{"x": 1}', None), ("j", "e", "s", None, None, "one\ntwo\nthree")]
    assert "FileScan text" not in found._jdf.queryExecution().sparkPlan().toString()
    (tmp_path / "long.log").write_bytes(b"".join(b"%d\r\n" % i for i in range(5000)))
    from pyarrow import fs

    for block in (1, 2, 7, 1 << 16):
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "long.log")) as file:
            assert trees.last_lines(file, 3, block) == b"4997\n4998\n4999"
