"""Fixed-width vector files and synthetic vectors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.sources.vecfiles import VectorFiles


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _source(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")


def read_fvec(spark: SparkSession, path: str, d: int) -> DataFrame:
    """``(vec_id, embedding)`` from an fvec file, or a folder of them, of dimension ``d``.

    A filter on ``vec_id``, such as that of ``corpus_prefix``, limits the bytes that are read.
    """
    _source(spark)
    return spark.read.format("vectorfile").option("width", d).load(path)


def read_ivec(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``(query_id, neighbors)`` from an ivec file, or a folder of them, with ``k`` neighbours per query."""
    _source(spark)
    options = {"width": k, "kind": "int", "id": "query_id", "values": "neighbors"}
    return spark.read.format("vectorfile").options(**options).load(path)


def write_records(rows: DataFrame, path: str, width: int, kind: str = "float", files: int | None = None, mode: str = "append") -> None:
    """Write ``rows`` (id, list of ``width`` numbers) as a folder of fvec or ivec files in order of the id.

    A range shuffle gives every task its own ids. The whole write shows up at once or, if a task fails, not at all.
    """
    _source(rows.sparkSession)
    name, values = rows.columns
    rows = rows.select(F.col(name).cast("bigint").alias(name), F.col(values).cast(f"array<{kind}>").alias(values))
    placed = rows.repartitionByRange(files, name) if files else rows.repartitionByRange(name)
    placed.sortWithinPartitions(name).write.format("vectorfile").options(width=width, kind=kind).mode(mode).save(path)


def truth_rows(neighbors: DataFrame) -> DataFrame:
    """S2 as ``(query_id, rank, vec_id)``, rank from 1."""
    return neighbors.select("query_id", F.posexplode("neighbors").alias("_p", "vec_id")).select(
        "query_id", (F.col("_p") + 1).alias("rank"), F.col("vec_id").cast("bigint").alias("vec_id")
    )


def synthetic_vectors(
    spark: SparkSession, n: int, d: int, centers: int, seed: int = 42, box: float = 10.0, spread: float = 1.0,
) -> DataFrame:
    """``n`` vectors in Gaussian clusters around ``centers`` uniform centres in ``[-box, box]^d``.

    Every number is a hash of (seed, row, component), so the result does not depend on partitioning.
    """
    return clustered(spark.range(n).select(F.col("id").alias("vec_id")), d, centers, seed, box, spread)


def clustered(ids: DataFrame, d: int, centers: int, seed: int = 42, box: float = 10.0, spread: float = 1.0) -> DataFrame:
    """S8 for the ``vec_id`` values of a given table."""
    def uniform(*parts):
        # 53 hash bits, moved off zero so that the logarithm below is finite
        bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
        return (bits + 0.5) / F.lit(float(1 << 53))

    tag = lambda t: F.lit(seed * 16 + t).cast("bigint")
    cell = F.pmod(F.xxhash64(F.col("vec_id"), tag(0)), F.lit(centers).cast("bigint"))

    def component(j):
        centre = (uniform(F.col("cell"), j, tag(1)) * 2.0 - 1.0) * F.lit(box)
        u, v = uniform(F.col("vec_id"), j, tag(2)), uniform(F.col("vec_id"), j, tag(3))
        gauss = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
        return (centre + gauss * F.lit(spread)).cast("float")

    rows = ids.select("vec_id", cell.alias("cell"))
    return rows.select("vec_id", "cell", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), component).alias("embedding"))
