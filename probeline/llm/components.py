"""Connected components by repeated contraction towards the smallest neighbour, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.tables import cut

SMALL = 1 << 18  # edges that one task can finish


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    point = np.arange(len(nodes))
    while True:
        x, y = point[left], point[right]
        if (x == y).all():
            return nodes, nodes[point]
        np.minimum.at(point, np.maximum(x, y), np.minimum(x, y))
        while (point[point] != point).any():
            point = point[point]


def _finished(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of a number of edges that is known to be small, in one task."""
    kind = f"node {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if parts:
            found = smallest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

    return edges.repartition(1).mapInArrow(work, kind)


def components(edges: DataFrame, jumps: int = 2, small: int = SMALL) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``a``, ``b``, of one integer type): the smallest node it reaches.

    Each round orders the nodes anew by a hash, points a node to its first neighbour (or itself), follows the pointers a few
    steps, and contracts the edges. Less than half of the nodes come before all their neighbours, so rounds are few whatever
    the shape, chains included. Every step is a partial aggregation or an equi-join, so a hub is spread by the map side of
    the aggregation and by the skew join. As soon as at most ``small`` edges are left, one task finishes them. Null ends and
    self-links are left out.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label, rounds = None, 0
    while edges.count() > small:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda x: F.struct(F.xxhash64(F.col(x), F.lit(rounds)).alias("h"), F.col(x).alias("to"))
        point = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least(rank("a"), "near")["to"].alias("to"))
        point = cut(point)
        for _ in range(jumps):
            onward = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            point = point.join(onward, "to").select("node", F.col("far").alias("to"))
        point = cut(point)
        label = _followed(label, point)
        here = point.select(F.col("node").alias("a"), F.col("to").alias("x"))
        there = point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(here, "a").join(there, "b").filter("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        rounds += 1
    label = _followed(label, cut(_finished(edges)).withColumnRenamed("component", "to"))
    if not rounds:
        return label
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return label.join(least, "component").select("node", F.col("least").alias("component"))


def _followed(label: DataFrame | None, point: DataFrame) -> DataFrame:
    """Labels after the components they name have moved on along ``point`` (``node``, ``to``)."""
    if label is None:
        return point.withColumnRenamed("to", "component")
    step = point.select(F.col("node").alias("component"), F.col("to").alias("far"))
    return cut(label.join(step, "component", "left").select("node", F.coalesce("far", "component").alias("component")))
