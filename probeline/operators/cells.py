"""Approximate search over k-means cells with a quality knob."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.functions.vectors import HIGHER_IS_BETTER, check_space
from probeline.operators.search import BLOCK_BYTES, TopList, block_top, mean_recall, recall_at_k, top_k


def train_cells(base: DataFrame, n_cells: int, seed: int = 42, iterations: int = 10) -> KMeansModel:
    """Fit the cell centres on the whole corpus (distributed k-means; ``n_cells × dimension`` numbers come back)."""
    points = base.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=n_cells, seed=seed, maxIter=iterations, initMode="random").fit(points)


class GivenCells:
    """Cells around given centres, numbered from 0, wherever a trained model is accepted."""

    def __init__(self, centres: Sequence[Sequence[float]]):
        self.centres = [np.asarray(c, dtype=np.float64) for c in centres]

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as a trained model has it
        return self.centres


def _nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each vector, nearest first; the lower number of equally near ones."""
    gaps = (vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2.0 * vectors @ centres.T
    return np.argsort(gaps, axis=1, kind="stable")[:, :n].astype(np.int32)


def assign_cells(base: DataFrame, model: KMeansModel | GivenCells) -> DataFrame:
    """Add the ``cell`` of every vector. Rows that hold no full vector are left out."""
    centres = np.array(model.clusterCenters())
    kept = [c for c in base.columns if c != "cell"]
    kind = T.StructType([*(base.schema[c] for c in kept), T.StructField("cell", T.IntegerType())])
    place = kept.index("embedding")

    def assign(batches):
        for batch in batches:
            vectors = np.asarray(batch.column(place).flatten(), dtype=np.float64).reshape(-1, centres.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(vectors, centres, 1)[:, 0])], kind.names)

    full = (F.size("embedding") == centres.shape[1]) & ~F.exists("embedding", lambda x: x.isNull())
    return base.filter(full).select(*kept).mapInArrow(assign, kind)


def write_cells(assigned: DataFrame, path: str) -> None:
    """Store an assigned corpus by cell. Range partitioning splits a hot cell over several files."""
    ranged = assigned.repartitionByRange("cell", "vec_id")
    ranged.write.mode("errorifexists").partitionBy("cell").parquet(path)


def probe_cells(queries: DataFrame, model: KMeansModel | GivenCells, nprobe: int) -> DataFrame:
    """Add ``probes``: the ``nprobe`` cells whose centres are nearest to each query."""
    centres = np.array(model.clusterCenters())
    shared = queries.sparkSession.sparkContext.broadcast(centres)  # n_cells × dimension, fixed by the caller

    def probe(batches):
        cells = shared.value
        for batch in batches:
            asked = np.asarray(batch.column("embedding").flatten(), dtype=np.float64).reshape(-1, cells.shape[1])
            near = _nearest(asked, cells, nprobe)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("embedding"), pa.array(list(near), pa.list_(pa.int32()))],
                names=["query_id", "embedding", "probes"],
            )

    return queries.select("query_id", F.col("embedding").cast("array<double>")).mapInArrow(
        probe, "query_id bigint, embedding array<double>, probes array<int>"
    )


def ann_search(
    index: DataFrame, queries: DataFrame, model: KMeansModel, k: int, nprobe: int, space_type: str = "innerproduct",
    exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """K-NN over the ``nprobe`` nearest cells of each query; all cells probed equals exact search.

    Only probed cells are read from an index stored by cell, and a hot cell is scored by as many tasks as it has
    splits.
    """
    check_space(space_type)
    asked = probe_cells(queries, model, nprobe)
    found = block_top(index, asked, [TopList(k)], space_type, exclude_self, block_bytes, cells=True)
    return top_k(found, k, HIGHER_IS_BETTER[space_type]).select("query_id", "rank", "vec_id", "score")


def probe_curve(
    index: DataFrame, queries: DataFrame, truth: DataFrame, model: KMeansModel, k: int, probes: Sequence[int],
    space_type: str = "innerproduct", exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """X3 over ``nprobe``: ``(nprobe, recall, queries)`` from one pass that keeps a list per knob value."""
    check_space(space_type)
    asked = probe_cells(queries, model, max(probes))
    lists = [TopList(k, nprobe=n) for n in probes]
    found = block_top(index, asked, lists, space_type, exclude_self, block_bytes, cells=True)
    knob = F.element_at(F.array(*[F.lit(n) for n in probes]), F.col("list") + 1)
    way = F.col("score").desc() if HIGHER_IS_BETTER[space_type] else F.col("score").asc()
    order = Window.partitionBy("list", "query_id").orderBy(way, "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("nprobe", knob)
    return mean_recall(recall_at_k(best, truth, k, ["nprobe"]), ["nprobe"])
