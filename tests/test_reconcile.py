import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probeline.operators import reconcile, tables


def cells_of(ids, signs, third):
    n, key, check = (np.zeros(reconcile.HASHES * third, np.int64) for _ in range(3))
    for x, s in zip(ids, signs, strict=True):
        one = np.array([x], np.int64)
        for c in reconcile.places(one, third)[0]:
            n[c] += s
            key[c] ^= x
            check[c] ^= reconcile.hash_long(one).view(np.int64)[0]
    return n, key, check


def test_hash_is_the_one_of_sql(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "x long").select("x", F.xxhash64("x").alias("a"), F.xxhash64("x", F.lit(2).cast("bigint")).alias("b"))
    for r in rows.collect():
        x = np.array([r["x"]], np.int64)
        assert reconcile.hash_long(x).view(np.int64)[0] == r["a"]
        assert reconcile.hash_long(np.array([2]), reconcile.hash_long(x)).view(np.int64)[0] == r["b"]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(1 << 62), 1 << 62), max_size=60), st.sets(st.integers(0, 500), max_size=30))
def test_opening_gives_the_differences_or_says_no(ids, extra):
    extra -= ids
    signs = [1] * len(ids) + [-1] * len(extra)
    for third in (8, 64, 256):
        found, sign, done = reconcile.opened(*cells_of([*ids, *extra], signs, third), third)
        if done:
            assert dict(zip(found.tolist(), sign.tolist(), strict=True)) == {**dict.fromkeys(ids, 1), **dict.fromkeys(extra, -1)}
    assert done  # at 256 cells per hash


def test_ids_that_occur_twice_do_not_open():
    assert not reconcile.opened(*cells_of([5, 5, 9], [1, 1, 1], 32), 32)[2]


@pytest.fixture
def table(spark):
    name = f"reconciled_{uuid.uuid4().hex}"
    tables.create_vector_table(spark, name, 2, "l2", 4)
    yield name
    tables.drop_vector_table(spark, name)


def corpus(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))


@pytest.mark.parametrize("lost", ["false", "vec_id % 400 = 3", "vec_id % 10 = 3", "vec_id > 100", "true"])
def test_retry_set_is_the_anti_join(spark, table, lost, monkeypatch):
    monkeypatch.setattr(reconcile, "MOST", 200)  # larger losses are joined
    base = corpus(spark).repartition(3)
    tables.ingest(base.filter(f"not ({lost})"), table)
    counts = base.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(4).cast("bigint")).cast("int").alias("shard")).agg(F.count("*").alias("expected_docs"))
    failing = tables.verify_count(spark, table, counts).filter("not complete")
    wanted = sorted(r["vec_id"] for r in base.filter(lost).select("vec_id").collect())
    for some in (failing, failing.select("shard")):
        again = tables.retry_shards(base, table, some)
        assert again.columns == base.columns and sorted(r["vec_id"] for r in again.collect()) == wanted


def test_repeated_and_extra_ids(spark, table):
    base = corpus(spark, 400)
    tables.ingest(base.filter("vec_id % 50 <> 7"), table)
    tables.ingest(corpus(spark, 500).filter("vec_id >= 450"), table)  # rows that nobody asked for
    twice = base.union(base.filter("vec_id in (3, 7)"))
    shards = spark.range(4).select(F.col("id").cast("int").alias("shard"), F.lit(8).cast("bigint").alias("shortfall"))
    found = sorted(r["vec_id"] for r in tables.retry_shards(twice, table, shards).collect())
    assert found == sorted([x for x in range(400) if x % 50 == 7] + [7])


def test_small_losses_shuffle_no_vectors(spark, table):
    base = corpus(spark)
    tables.ingest(base.filter("vec_id % 400 <> 3"), table)
    shards = spark.range(4).select(F.col("id").cast("int").alias("shard"), F.lit(2).cast("bigint").alias("shortfall"))
    plan = tables.retry_shards(base, table, shards)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any(x in plan for x in ("SortMergeJoin", "ShuffledHashJoin", "CartesianProduct"))


def test_ingest_registers_new_shards_and_a_failed_one_adds_no_row(spark, table):
    base = corpus(spark, 200)
    tables.ingest(base, table)
    broken = base.withColumn("vec_id", F.when(F.col("vec_id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.col("vec_id") + 1000).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        tables.ingest(broken, table, files_per_shard=1)
    assert spark.table(table).count() == 200
    assert spark.sql(f"SHOW PARTITIONS {table}").count() == 4
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, None)], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["reason"]) for r in tables.rejected_vectors(odd, 2).collect()) == [(0, "id"), (2, "dimension"), (3, "component"), (4, "dimension")]
