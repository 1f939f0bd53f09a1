"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products, one representative per group.

Cells are the nearest centres by angle. A vector is compared with the members of its own cell and of every cell that
can hold a partner: with ``h`` its own centre and ``c`` another, members of ``c`` are on the other side of the plane
between ``h`` and ``c``, so a partner at cosine ``t`` exists only if ``v (h - c) <= sqrt(1 - t^2) |h - c|``. No link is
lost by the cells, whatever the centres are. A pair is met in the cell with the smaller number only, so once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.components import components
from probeline.llm.tables import sample_bar, written

FITTED = 20_000  # vectors that centres are fitted on at most, about
CELL = 2_000  # vectors per cell that the number of cells aims at
CELLS = 1_024  # cells at most
BLOCK = 2_048  # vectors per side of a product, about


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """``k`` unit centres (fewer if there are fewer distinct directions)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.unique(unit, axis=0)
    k = min(k, len(unit))
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), k, replace=False)] if k else unit
    for _ in range(rounds if k > 1 else 0):
        home = (unit @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, home, unit)
        size = np.linalg.norm(total, axis=1)
        centres = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def distances(centres: np.ndarray) -> np.ndarray:
    """Between unit vectors, by one matrix product."""
    return np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))


def visits(vectors: np.ndarray, centres: np.ndarray, threshold: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each vector, and all (row, cell) it has to be compared in: its own and smaller ones in reach."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ centres.T
    home = near.argmax(1)
    apart = distances(centres) if apart is None else apart
    reach = np.sqrt(max(0.0, 1 - threshold**2))
    inside = near[np.arange(len(unit)), home][:, None] - near <= reach * apart[home] + 1e-7
    inside &= np.arange(len(centres)) <= home[:, None]
    inside[np.arange(len(unit)), home] = True
    row, cell = np.nonzero(inside)
    return home, row, cell


def block_links(x: np.ndarray, y: np.ndarray, x_id: np.ndarray, y_id: np.ndarray, same: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of two blocks as a Boolean matrix, and smallest ids that matches connect on either side.

    Rows of ``y`` that are members of the same cell (``same``) match a row of ``x`` only from a larger id.
    """
    cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    match = (cosine >= threshold) & (~same | (x_id[:, None] < y_id))
    left, right = x_id.copy(), y_id.copy()
    rows, columns = np.flatnonzero(match.any(1)), np.flatnonzero(match.any(0))
    some = match[np.ix_(rows, columns)]
    a, b = left[rows], right[columns]
    last = np.iinfo(np.int64).max
    while some.size:
        b_new = np.minimum(b, np.where(some, a[:, None], last).min(0))
        a_new = np.minimum(a, np.where(some, b_new, last).min(1))
        if (a_new == a).all() and (b_new == b).all():
            break
        a, b = a_new, b_new
    left[rows], right[columns] = a, b
    return match, left, right


def _grid(column: pa.Array) -> np.ndarray:
    """Vectors as rows, each divided by a power of two (exact) so that its largest component is near 1: squares of very
    large or small components neither overflow nor vanish."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return np.ldexp(found, -np.frexp(np.abs(found).max(1, initial=0.0))[1][:, None]) if found.size else found


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    fitted: int = FITTED, cell: int = CELL, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: the id, ``n_links``, ``component_id`` and ``kept``.

    Vectors are compared in double precision if their labels are equal and not null and their lengths are equal. A null
    or zero vector, or one that holds a null or a number that is not finite, links with nothing and is kept. Equal
    vectors of a label are one in the comparison and count as many, repeated rows too. ``component_id`` is the smallest
    id that links reach; a null id counts only among null ids. Classes of equal vectors go by a 64-bit hash.
    """
    values = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & (F.size(values) > 0) & F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(F.coalesce(usable, F.lit(False)), F.struct(F.col(label_col).alias("label"), values.alias("v"))).alias("_v"))
    rows = written(rows.withColumn("cid", F.when(F.col("_v").isNotNull(), F.xxhash64("_v.label", F.size("_v.v"), "_v.v"))), "vectors")
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.first("_v").alias("_v"), F.count("*").alias("copies"))
    classes = written(classes.select("cid", "copies", F.xxhash64("_v.label", F.size("_v.v")).alias("part"), F.size("_v.v").alias("dim"), F.col("_v.v").alias("v")), "classes")

    dims = classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, n = dims[0]["dim"], dims[0]["n"]
    sample = classes.filter((F.col("dim") == dim) & (F.col("cid") <= F.lit(sample_bar(fitted / n)))).orderBy("cid").select("v").toArrow()
    centres = spherical_kmeans(_grid(sample.column("v")), min(CELLS, -(-n // cell))) if sample.num_rows else np.ones((1, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = distances(centres)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                some = batch.slice(begin, 1024)
                fits = some.column("dim").to_numpy() == dim
                usual, other = np.flatnonzero(fits), np.flatnonzero(~fits)  # vectors of another length are one cell
                home = np.zeros(len(fits), np.int64)
                row, where = other, np.zeros(len(other), np.int64)
                if len(usual):
                    home[usual], at, cells = visits(_grid(some.column("v").take(pa.array(usual))), centres, threshold, apart)
                    row, where = np.concatenate([row, usual[at]]), np.concatenate([where, cells])
                out = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(where), pa.array(home[row] == where)], [*some.schema.names, "cell", "home"])

    placed = written(classes.mapInArrow(assign, "cid long, copies long, part long, dim int, v array<double>, cell long, home boolean"), "cells")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / block)).cast("int")
    sizes = placed.groupBy("part", "cell").agg(blocks(F.count_if("home")).alias("n_own"), blocks(F.count("*")).alias("n_all"))
    sized = placed.join(sizes, ["part", "cell"])
    deal = lambda size: F.pmod(F.xxhash64("cid"), size).cast("int")
    own = sized.filter("home").select("part", "cell", deal(F.col("n_own")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(True).alias("left"), "home", "cid", "copies", "v")
    every = sized.select("part", "cell", F.explode(F.sequence(F.lit(0), F.col("n_own") - 1)).alias("i"), deal(F.col("n_all")).alias("j"), F.lit(False).alias("left"), "home", "cid", "copies", "v")

    def compare(group: pa.Table) -> pa.Table:
        left = group.column("left").to_numpy()
        a, b = group.filter(pa.array(left)), group.filter(pa.array(~left))
        if not a.num_rows or not b.num_rows:
            return pa.table({"cid": pa.array([], pa.int64()), "to": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        x_id, y_id = a.column("cid").to_numpy(), b.column("cid").to_numpy()
        x_n, y_n = a.column("copies").to_numpy(), b.column("copies").to_numpy()
        y = _grid(b.column("v"))
        found = []
        for begin in range(0, len(x_id), 512):
            part = slice(begin, begin + 512)
            match, low, high = block_links(_grid(a.column("v").slice(begin, 512)), y, x_id[part], y_id, b.column("home").to_numpy(), threshold)
            found.append((x_id[part], low, match @ y_n))
            found.append((y_id, high, x_n[part] @ match))
        cid, to, links = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = links > 0
        return pa.table({"cid": cid[keep], "to": to[keep], "links": links[keep].astype(np.int64)})

    met = own.union(every).groupBy("part", "cell", "i", "j").applyInArrow(compare, "cid long, to long, links long")
    met = written(met, "links")
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    place = components(met.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    known = classes.select("cid", "copies").join(counts, "cid", "left").join(place.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("cid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("_c"))
    named = rows.select("_id", "cid").join(known, "cid", "left")
    first = named.filter("_c is not null").groupBy("_c").agg(F.min("_id").alias("_first"))
    smallest = F.when(F.col("_c").isNull(), F.col("_id")).otherwise(F.col("_first"))
    return named.join(first, "_c", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id"),
        F.col("_id").eqNullSafe(smallest).alias("kept"),
    )
