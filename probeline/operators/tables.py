"""Vector tables: create, ingest, count, compact, drop, refresh, snapshot."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.functions.vectors import check_space
from probeline.operators.reconcile import missing_rows
from probeline.session import kept, scratch_path

FILE_BYTES = 256 << 20  # data per file that writers aim at
_PROPERTIES = ("dimension", "space_type", "shards")


def create_vector_table(spark: SparkSession, name: str, dim: int, space_type: str, shards: int, path: str | None = None) -> str:
    """M1: an empty table partitioned by shard, with dimension, metric and shard count as table properties."""
    check_space(space_type)
    path = path or scratch_path(spark, name.replace(".", "_"))
    spark.sql(
        f"CREATE TABLE {name} (vec_id BIGINT, embedding ARRAY<FLOAT>, shard INT) USING parquet PARTITIONED BY (shard) "
        f"LOCATION '{path}' TBLPROPERTIES ('dimension'='{int(dim)}', 'space_type'='{space_type}', 'shards'='{int(shards)}')"
    )
    return path


def drop_vector_table(spark: SparkSession, name: str) -> None:
    """M2."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def refresh(spark: SparkSession, name: str) -> None:
    """M3: make rows written by other jobs visible before counting."""
    spark.catalog.refreshTable(name)


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()  # a handful of settings
    return {r["key"]: r["value"] for r in rows if r["key"] in _PROPERTIES}


def table_location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def read_vectors(spark: SparkSession, path: str, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A Parquet corpus as ``vec_id, embedding``; only these two columns are read."""
    return spark.read.parquet(path).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding")
    )


def corpus_prefix(vectors: DataFrame, n: int) -> DataFrame:
    """S3: the first ``n`` vectors. The filter reaches the Parquet row groups."""
    return vectors.filter(F.col("vec_id") < F.lit(int(n)).cast("bigint"))


def _fits(dim: int):
    return (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull()


def rejected_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows that ingest leaves out, with the ``reason``: no ``id``, a wrong ``dimension``, or a null ``component``."""
    reason = F.when(F.col("vec_id").isNull(), "id").when(~F.coalesce(F.size("embedding") == dim, F.lit(False)), "dimension")
    return vectors.filter(~F.coalesce(_fits(dim), F.lit(False))).withColumn("reason", reason.otherwise("component"))


def ingest(vectors: DataFrame, name: str, rows_per_file: int = 1_000_000, files_per_shard: int | None = None) -> None:
    """Append vectors to their shards (by hash of the id).

    One shuffle by (shard, slot) lets every shard be written by ``files_per_shard`` tasks; by default as many as the
    counted vectors have ``FILE_BYTES``. ``rejected_vectors`` tells which rows do not fit and are left out, and why. Files
    show up when the whole write has ended; a failed one adds no row. Shards that are new to the table are registered in one
    statement, none is listed.
    """
    spark = vectors.sparkSession
    settings = table_properties(spark, name)
    dim, shards = int(settings["dimension"]), int(settings["shards"])
    writers = files_per_shard or max(1, math.ceil(vectors.count() * 4 * dim / (shards * FILE_BYTES)))
    hashed = F.xxhash64("vec_id")
    rows = vectors.filter(_fits(dim)).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.withColumn("shard", F.pmod(hashed, F.lit(shards).cast("bigint")).cast("int"))
    slot = F.pmod(F.shiftright(hashed, 20), F.lit(writers).cast("bigint"))
    rows = rows.withColumn("_slot", slot).repartition(shards * writers, "shard", "_slot").drop("_slot")
    location = table_location(spark, name)
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(location)
    known = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}  # a row per shard
    fresh = [i for i in range(shards) if f"shard={i}" not in known]
    if fresh:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (shard={i})" for i in fresh))
    refresh(spark, name)


def shard_counts(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).groupBy("shard").agg(F.count(F.lit(1)).alias("docs"))


def verify_count(spark: SparkSession, name: str, expected: DataFrame | int) -> DataFrame:
    """M5: actual against expected counts with the shortfall.

    ``expected`` is one number for the table, or (shard, expected_docs): then failing shards are the retry set.
    """
    refresh(spark, name)
    if isinstance(expected, int):
        total = spark.table(name).agg(F.count(F.lit(1)).alias("actual_docs"))
        counted = total.withColumn("expected_docs", F.lit(expected).cast("bigint"))
    else:
        counted = expected.join(shard_counts(spark, name).withColumnRenamed("docs", "actual_docs"), "shard", "left")
        counted = counted.na.fill(0, ["actual_docs"])
    short = F.greatest(F.col("expected_docs") - F.col("actual_docs"), F.lit(0).cast("bigint"))
    return counted.withColumn("shortfall", short).withColumn("complete", F.col("shortfall") == 0)


def retry_shards(vectors: DataFrame, name: str, failing: DataFrame) -> DataFrame:
    """M5: the vectors of the failing shards that the table does not hold yet.

    ``failing`` has ``shard`` and may have the ``shortfall`` of ``verify_count``. Where little is missing, sketches of the
    shards name it and neither side is shuffled; else, or where a sketch does not open, shards are joined.
    """
    spark = vectors.sparkSession
    shards = int(table_properties(spark, name)["shards"])
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("bigint")).cast("int")
    wanted = vectors.withColumn("shard", shard)
    if "shortfall" in failing.columns:
        expected = failing.groupBy("shard").agg(F.max("shortfall").alias("difference"))
    else:
        counts = shard_counts(spark, name).select("shard", (-F.col("docs")).alias("docs"))
        both = wanted.groupBy("shard").agg(F.count(F.lit(1)).alias("docs")).unionByName(counts)
        both = both.join(failing.select("shard").distinct(), "shard", "left_semi")
        expected = both.groupBy("shard").agg(F.abs(F.sum("docs")).alias("difference"))
    expected = kept(expected, "expected")
    held = spark.table(name).select("shard", "vec_id").join(F.broadcast(expected.select("shard")), "shard", "left_semi")  # prunes whole shards
    return missing_rows(wanted, held, expected).drop("shard")


def compact(spark: SparkSession, name: str, target_bytes: int = FILE_BYTES) -> str:
    """M4: rewrite every shard to files of about ``target_bytes`` and point the table at the new folder.

    The new files are complete before the first shard moves, and a shard moves by one change of its location, so a
    failure leaves a table that holds the same rows. The old folder stays for readers that still use it.
    """
    new_path = scratch_path(spark, name.replace(".", "_"))
    rows = spark.table(name)
    files = rows.select("shard", "_metadata.file_path", "_metadata.file_size").distinct()
    needed = files.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("file_size") / target_bytes)).cast("int").alias("_files"))
    sizes = {r["shard"]: r["_files"] for r in needed.collect()}  # a row per shard
    rows = rows.join(F.broadcast(needed), "shard")
    slot = F.pmod(F.shiftright(F.xxhash64("vec_id"), 20), F.col("_files").cast("bigint"))
    rows = rows.withColumn("_slot", slot).repartition(max(1, sum(sizes.values())), "shard", "_slot")
    rows.select("vec_id", "embedding", "shard").write.mode("errorifexists").partitionBy("shard").parquet(new_path)
    for shard in sorted(sizes):
        spark.sql(f"ALTER TABLE {name} PARTITION (shard={shard}) SET LOCATION '{new_path}/shard={shard}'")
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{new_path}'")
    refresh(spark, name)
    return new_path


def snapshot_table(spark: SparkSession, name: str, engine: str) -> DataFrame:
    """Mapping, settings and stats of a table as JSON documents; a failure is stored in place of the documents."""
    try:
        settings = table_properties(spark, name)
        rows = spark.table(name)
        fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    except Exception as problem:  # the snapshot records what went wrong
        text = json.dumps({"error": type(problem).__name__})
        return spark.range(1).select(
            F.lit(name).alias("index"), F.lit(engine).alias("engine"),
            *[F.lit(text).alias(c) for c in ("mapping", "settings", "stats")],
        )
    files = rows.select("_metadata.file_path", "_metadata.file_size").distinct()
    stats = rows.agg(F.count(F.lit(1)).alias("docs")).withColumn(
        "segments", files.agg(F.count(F.lit(1))).scalar()
    ).withColumn("store_bytes", files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).scalar())
    return stats.select(
        F.lit(name).alias("index"), F.lit(engine).alias("engine"), F.lit(json.dumps(fields)).alias("mapping"),
        F.lit(json.dumps(settings)).alias("settings"), F.to_json(F.struct("docs", "segments", "store_bytes")).alias("stats"),
    )
