import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from probeline.operators import cells, search
from probeline.sources.binary import synthetic_vectors


def make(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} bigint, embedding array<float>")


def brute(base, asked, k, space, skip_self=False):
    out = {}
    for q, a in enumerate(asked.astype(np.float32).astype(float)):
        scored = []
        for i, b in enumerate(base.astype(np.float32).astype(float)):
            if skip_self and i == q:
                continue
            s = {"innerproduct": a @ b, "l2": np.linalg.norm(a - b), "cosinesimil": a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[space]
            scored.append((s if space == "l2" else -s, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found_ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("space", ["innerproduct", "l2", "cosinesimil"])
@pytest.mark.parametrize("block", [search.BLOCK_BYTES, 2000])
def test_exact_knn(spark, space, block):
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(90, 8)), rng.normal(size=(15, 8))
    got = search.exact_knn(make(spark, base, "vec_id").repartition(5), make(spark, asked, "query_id"), 7, space, block_bytes=block)
    assert found_ids(got) == brute(base, asked, 7, space)


@pytest.mark.parametrize("block", [search.BLOCK_BYTES, 700])
def test_equal_scores_go_to_the_lower_id(spark, block):
    base = np.array([[1, 0]] * 30 + [[2, 0]] * 5, dtype=float)
    got = search.exact_knn(make(spark, base, "vec_id").repartition(4), make(spark, base[:3], "query_id"), 8, block_bytes=block)
    assert set(map(tuple, found_ids(got).values())) == {(30, 31, 32, 33, 34, 0, 1, 2)}


def test_self_is_left_out(spark):
    base = np.random.default_rng(2).normal(size=(20, 4))
    df = make(spark, base, "vec_id")
    got = search.exact_knn(df, df.withColumnRenamed("vec_id", "query_id"), 3, "l2", exclude_self=True)
    assert found_ids(got) == brute(base, base, 3, "l2", True)


def test_vectors_that_do_not_fit_are_not_scored(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [0.5, 0.0])], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert found_ids(search.exact_knn(df, asked, 5)) == {0: [0, 4]}


def test_more_wanted_than_there_are(spark):
    base = np.eye(3)
    got = search.exact_knn(make(spark, base, "vec_id"), make(spark, base, "query_id"), 10)
    assert got.count() == 9


@pytest.mark.parametrize("block", [search.BLOCK_BYTES, 3000])
def test_overquery(spark, block):
    rng = np.random.default_rng(3)
    base, asked = rng.normal(size=(60, 6)).astype(np.float32), rng.normal(size=(9, 6)).astype(np.float32)
    got = search.overquery_search(make(spark, base, "vec_id"), make(spark, asked, "query_id"), 4, 3, scale=1.0, block_bytes=block)
    want = {}
    for q, a in enumerate(asked.astype(float)):
        coarse = sorted(range(60), key=lambda i: (-(np.rint(a) @ np.rint(base[i].astype(float))), i))[:12]
        want[q] = sorted(coarse, key=lambda i: (-(a @ base[i].astype(float)), i))[:4]
    assert found_ids(got) == want


def test_recall_slices_truth(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12), (2, 2, 99)], "query_id bigint, rank int, vec_id bigint")
    truth = spark.createDataFrame([(1, 1, 11), (1, 2, 10), (1, 3, 5), (2, 1, 7), (2, 2, 12), (2, 3, 99)], "query_id bigint, rank int, vec_id bigint")
    assert rows(search.recall_at_k(found, truth, 2), "query_id") == [(1, 1.0), (2, 0.5)]
    assert search.mean_recall(search.recall_at_k(found, truth, 2)).first()["recall"] == 0.75


def test_curve_agrees_with_single_searches(spark):
    rng = np.random.default_rng(4)
    base = make(spark, rng.normal(size=(80, 6)), "vec_id")
    asked = base.withColumnRenamed("vec_id", "query_id")
    curve = {(r["k"], r["factor"]): r["recall"] for r in search.quality_curve(base, asked, [3, 5], [1, 4], scale=1.0, exclude_self=True).collect()}
    truth = search.exact_knn(base, asked, 5, exclude_self=True)
    for (k, factor), recall in curve.items():
        found = search.overquery_search(base, asked, k, factor, scale=1.0, exclude_self=True)
        single = search.mean_recall(search.recall_at_k(found, truth, k)).first()["recall"]
        assert recall == pytest.approx(single)
    assert curve[(3, 1)] < curve[(3, 4)]


def test_cells(spark, tmp_path):
    base = synthetic_vectors(spark, 400, 8, 5, seed=3)
    asked = base.filter("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    model = cells.train_cells(base, 5)
    path = str(tmp_path / "cells")
    cells.write_cells(cells.assign_cells(base.drop("cell"), model), path)
    index = spark.read.parquet(path)
    truth = search.exact_knn(base, asked, 5, "l2")
    every = cells.ann_search(index, asked, model, 5, 5, "l2")
    assert found_ids(every) == found_ids(truth)
    one = cells.ann_search(index, asked, model, 5, 1, "l2")
    assert found_ids(one) == found_ids(cells.ann_search(index, asked, model, 5, 1, "l2", block_bytes=4000))
    recall = search.mean_recall(search.recall_at_k(one, truth, 5)).first()["recall"]
    assert 0.8 <= recall <= 1.0
    for block in (search.BLOCK_BYTES, 4000):
        curve = {r["nprobe"]: r["recall"] for r in cells.probe_curve(index, asked, truth, model, 5, [1, 5], "l2", block_bytes=block).collect()}
        assert curve == {1: pytest.approx(recall), 5: 1.0}


def test_synthetic_vectors_do_not_depend_on_partitions(spark):
    a = synthetic_vectors(spark, 50, 4, 3).select("vec_id", F.col("embedding").cast("string"))
    b = synthetic_vectors(spark, 50, 4, 3).repartition(7).select("vec_id", F.col("embedding").cast("string"))
    assert rows(a, "vec_id") == rows(b, "vec_id")
    spreads = synthetic_vectors(spark, 3000, 2, 1, spread=2.0).select(F.explode("embedding").alias("x"), F.col("vec_id"))
    assert spreads.count() == 6000
