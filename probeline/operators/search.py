"""Exact and over-query nearest neighbours, top-k, recall.

Scores are computed block by block inside tasks (one matrix product per block) and only a running top list per query
leaves a task, so ``queries × vectors`` pairs are never rows of a DataFrame.

Two ways to bring queries and vectors together, chosen by the measured size of the query set:

* up to ``block_bytes`` the queries are broadcast and the corpus is read once, with no shuffle of the corpus;
* beyond it both sides are cut into hash blocks of at most ``block_bytes`` and every (corpus block, query block) pair
  is one bounded co-group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeline.functions.vectors import HIGHER_IS_BETTER, check_space

BLOCK_BYTES = 64 << 20
_TILE = 4 << 20  # score cells held at once per task
_FOUND = "list int, query_id bigint, vec_id bigint, rank_score double, score double"


class TopList(NamedTuple):
    """A list to keep per query: its length, the rounding of the ranking scores, and how many probed cells count."""

    keep: int
    quantise: float | None = None
    nprobe: int | None = None


def _scores(queries: np.ndarray, vectors: np.ndarray, space_type: str) -> np.ndarray:
    """Scores of every query against every vector, turned so that higher is better."""
    if space_type == "l2":
        squared = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2.0 * (queries @ vectors.T)
        return -np.sqrt(np.maximum(squared, 0.0))
    dots = queries @ vectors.T
    if space_type == "cosinesimil":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
        return np.divide(dots, norms, out=np.full_like(dots, np.nan), where=norms > 0)
    return dots


def _exact_for(queries: np.ndarray, vectors: np.ndarray, picks: np.ndarray, space_type: str) -> np.ndarray:
    """Exact scores of the picked vectors only (``picks`` holds vector positions per query)."""
    chosen = vectors[picks]
    if space_type == "l2":
        return -np.sqrt(((chosen - queries[:, None, :]) ** 2).sum(2))
    dots = np.einsum("qkd,qd->qk", chosen, queries)
    if space_type == "cosinesimil":
        norms = np.linalg.norm(chosen, axis=2) * np.linalg.norm(queries, axis=1)[:, None]
        return np.divide(dots, norms, out=np.full_like(dots, np.nan), where=norms > 0)
    return dots


class _TopLists:
    """The best ``keep`` vectors per query seen so far by one task; equal scores go to the lower vec_id."""

    def __init__(self, query_ids, queries, wanted: TopList, space_type, exclude_self):
        self.query_ids, self.queries = query_ids, queries
        self.keep, self.quantise, self.nprobe = wanted
        self.space_type, self.exclude_self = space_type, exclude_self
        self.coarse = np.rint(queries * self.quantise) if self.quantise else queries
        n = len(query_ids)
        self.rank = np.full((n, 0), -np.inf)
        self.exact = np.full((n, 0), -np.inf)
        self.ids = np.full((n, 0), -1, dtype=np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Offer vectors to all queries, or only to the queries at positions ``rows``."""
        if not len(ids) or (rows is not None and not len(rows)):
            return
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        coarse = np.rint(vectors * self.quantise) if self.quantise else vectors
        rows = np.arange(len(self.query_ids)) if rows is None else rows
        width = max(len(ids), self.keep * vectors.shape[1] if self.quantise else 0)
        step = max(1, _TILE // max(1, width))
        self._grow(min(self.keep, self.ids.shape[1] + len(ids)))
        for start in range(0, len(rows), step):
            self._add_tile(ids, vectors, coarse, rows[start : start + step])

    def _grow(self, width: int) -> None:
        more = width - self.ids.shape[1]
        if more > 0:
            pad = ((0, 0), (0, more))
            self.rank = np.pad(self.rank, pad, constant_values=-np.inf)
            self.exact = np.pad(self.exact, pad, constant_values=-np.inf)
            self.ids = np.pad(self.ids, pad, constant_values=-1)

    def _add_tile(self, ids, vectors, coarse, rows) -> None:
        fresh = _scores(self.coarse[rows], coarse, self.space_type)
        fresh = np.where(np.isnan(fresh), -np.inf, fresh)
        if self.exclude_self:
            fresh[ids[None, :] == self.query_ids[rows][:, None]] = -np.inf
        picks = _best(fresh, np.broadcast_to(ids, fresh.shape), self.keep)
        rank = np.take_along_axis(fresh, picks, 1)
        exact = _exact_for(self.queries[rows], vectors, picks, self.space_type) if self.quantise else rank
        found = np.where(np.isneginf(rank), -1, ids[picks])
        all_rank = np.concatenate([self.rank[rows], rank], 1)
        all_exact = np.concatenate([self.exact[rows], exact], 1)
        all_ids = np.concatenate([self.ids[rows], found], 1)
        keep = _best(all_rank, all_ids, self.ids.shape[1])
        self.rank[rows] = np.take_along_axis(all_rank, keep, 1)
        self.exact[rows] = np.take_along_axis(all_exact, keep, 1)
        self.ids[rows] = np.take_along_axis(all_ids, keep, 1)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keep = self.ids >= 0
        sign = 1.0 if HIGHER_IS_BETTER[self.space_type] else -1.0
        queries = np.broadcast_to(self.query_ids[:, None], self.ids.shape)[keep]
        return queries, self.ids[keep], self.rank[keep] * sign, self.exact[keep] * sign

    def batches(self, list_no: int, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        queries, ids, rank, exact = self.columns()
        for start in range(0, len(ids), rows):
            cut = slice(start, start + rows)
            found = pa.array(np.full(len(ids[cut]), list_no, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [found, pa.array(queries[cut]), pa.array(ids[cut]), pa.array(rank[cut]), pa.array(exact[cut])],
                names=["list", "query_id", "vec_id", "rank_score", "score"],
            )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best per row, by score and then by lower id."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    picks = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    worst = np.take_along_axis(scores, picks, 1).min(1)
    tied = np.flatnonzero((scores >= worst[:, None]).sum(1) > k)
    if len(tied):  # a tie on the border: settle it by id
        picks[tied] = np.lexsort((ids[tied], -scores[tied]), axis=1)[:, :k]
    return picks


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def _shape(df: DataFrame) -> tuple[int, int]:
    """Row count and dimension of a vector table: the length most vectors have, the shorter of equally common ones."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("embedding"), True).alias("d")).first()
    return row["n"], max(row["d"] or 0, 0)


def rejected_vectors(df: DataFrame, dimension: int | None = None) -> DataFrame:
    """Rows of a vector table that a search leaves out, with ``reason``: ``null``, ``length`` or ``component``.

    ``dimension`` is the length to have, by default the one most vectors of the table have.
    """
    if dimension is None:
        dimension = _shape(df)[1]
    reason = (
        F.when(F.col("embedding").isNull(), "null").when(F.size("embedding") != dimension, "length")
        .when(F.exists("embedding", lambda x: x.isNull()), "component")
    )
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def _usable(df: DataFrame, dimension: int) -> DataFrame:
    """Rows that can be scored: a full vector without null components."""
    return df.filter((F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull()))


def block_top(
    base: DataFrame, queries: DataFrame, lists: Sequence[TopList], space_type: str,
    exclude_self: bool = False, block_bytes: int = BLOCK_BYTES, cells: bool = False, dimension: int | None = None,
) -> DataFrame:
    """Per task and query the best vectors: ``(list, query_id, vec_id, rank_score, score)``.

    ``lists`` are kept side by side in one pass over the corpus. With a quantise value a list ranks by the scores of
    vectors rounded to ``1/quantise`` steps, and ``score`` is the exact score. With ``cells`` the corpus has a ``cell``
    and the queries a ``probes`` array, nearest first, and a vector only meets the queries that have its cell among
    the first ``nprobe`` (or all) of their probes. Vectors of another length than ``dimension`` (by default the one most
    queries have) are left out; ``rejected_vectors`` tells which.
    """
    check_space(space_type)
    n_queries, d = _shape(queries)
    if dimension is not None:
        d = dimension
    query_cols = ["query_id", "embedding"] + (["probes"] if cells else [])
    base_cols = ["vec_id", "embedding"] + (["cell"] if cells else [])
    queries, base = _usable(queries, d).select(*query_cols), _usable(base, d).select(*base_cols)
    query_bytes = n_queries * (16 * d + sum(24 * t.keep for t in lists) + 64)

    def tops(ids, matrix):
        return [_TopLists(ids, matrix, t, space_type, exclude_self) for t in lists]

    if query_bytes <= block_bytes:
        return _broadcast_top(base, queries, d, tops, cells)
    return _grid_top(base, queries, d, query_bytes, tops, block_bytes, cells)


def _broadcast_top(base, queries, d, make_tops, cells) -> DataFrame:
    table = queries.toArrow()  # at most block_bytes, checked by the caller
    ids = np.asarray(table["query_id"], dtype=np.int64)
    matrix = np.concatenate([_matrix(c, d) for c in table["embedding"].chunks]) if len(ids) else np.zeros((0, d))
    probed: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # cell: the queries that probe it, and at which place
    if cells:
        lists = table["probes"].to_pylist()
        flat = np.array([c for probes in lists for c in probes], dtype=np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
        place = np.array([i for probes in lists for i in range(len(probes))], dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        probed = {int(c): (owner[some], place[some]) for c, some in zip(found, np.split(order, first[1:]), strict=True)}
        base = base.filter(F.col("cell").isin([int(c) for c in probed]))
    shared = base.sparkSession.sparkContext.broadcast((ids, matrix, probed))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix, by_cell = shared.value
        tops = make_tops(query_ids, query_matrix)
        for batch in batches:
            vec_ids = np.asarray(batch.column("vec_id"), dtype=np.int64)
            vectors = _matrix(batch.column("embedding"), d)
            if not cells:
                for top in tops:
                    top.add(vec_ids, vectors)
                continue
            cell = np.asarray(batch.column("cell"), dtype=np.int64)
            for c in np.unique(cell):
                here = cell == c
                owner, place = by_cell[int(c)]
                for top in tops:
                    near = owner if top.nprobe is None else owner[place < top.nprobe]
                    top.add(vec_ids[here], vectors[here], near)
        for number, top in enumerate(tops):
            yield from top.batches(number)

    return base.mapInArrow(search, _FOUND)


def _grid_top(base, queries, d, query_bytes, make_tops, block_bytes, cells) -> DataFrame:
    query_blocks = math.ceil(query_bytes / block_bytes)
    vector_bytes = 16 * d + 16
    per_block = max(1, block_bytes // vector_bytes)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n)
    if cells:
        sizes = base.groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(per_block)).cast("bigint").alias("_parts")
        )
        base = base.join(sizes, "cell").withColumn("_g", hashed("vec_id", F.col("_parts"))).drop("_parts")
        queries = queries.select("*", F.posexplode("probes").alias("_place", "cell")).join(sizes, "cell")
        queries = queries.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        keys = ["cell", "_g", "_b"]
    else:
        parts = max(1, math.ceil(base.count() / per_block))
        base = base.withColumn("_g", hashed("vec_id", F.lit(parts).cast("bigint")))
        queries = queries.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
        queries = queries.withColumn("_place", F.lit(0))
        keys = ["_g", "_b"]
    queries = queries.withColumn("_b", hashed("query_id", F.lit(query_blocks).cast("bigint")))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))
    base = base.withColumn("_b", F.explode(blocks))

    def search(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(asked):
            ids, matrix = vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["embedding"]).astype(np.float64)
            tops = make_tops(asked["query_id"].to_numpy(np.int64), np.stack(asked["asked"]).astype(np.float64))
            place = asked["place"].to_numpy(np.int64)
            for number, top in enumerate(tops):
                top.add(ids, matrix, None if top.nprobe is None else np.flatnonzero(place < top.nprobe))
                q, v, r, s = top.columns()
                found.append(pd.DataFrame({"list": np.int32(number), "query_id": q, "vec_id": v, "rank_score": r, "score": s}))
        if not found:
            found = [pd.DataFrame({"list": [], "query_id": [], "vec_id": [], "rank_score": [], "score": []})]
        return pd.concat(found).astype({"list": "int32", "query_id": "int64", "vec_id": "int64"})

    pairs = base.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(
        queries.select(*[F.col(k).alias(k) for k in keys], "query_id", F.col("_place").alias("place"), F.col("embedding").alias("asked")).groupBy(*keys)
    )
    return pairs.applyInPandas(search, _FOUND)


def top_k(
    scored: DataFrame, k: int, descending: bool = True, score: str = "score", query: str = "query_id",
    item: str = "vec_id", rank: str = "rank",
) -> DataFrame:
    """The ``k`` best rows per query with their rank. Spark prunes each task to ``k`` rows before the shuffle."""
    by = F.col(score).desc() if descending else F.col(score).asc()
    order = Window.partitionBy(query).orderBy(by, F.col(item))
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def exact_knn(
    base: DataFrame, queries: DataFrame, k: int, space_type: str = "innerproduct", exclude_self: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best vectors; equal scores go to the lower vec_id."""
    found = block_top(base, queries, [TopList(k)], space_type, exclude_self, block_bytes)
    best = top_k(found, k, HIGHER_IS_BETTER[space_type])
    return best.select("query_id", "rank", "vec_id", "score")


def overquery_candidates(
    base: DataFrame, queries: DataFrame, keep: int, space_type: str = "innerproduct", scale: float = 127.0,
    exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``keep`` best vectors per query by quantised score, with ``coarse_rank`` and the exact ``score``.

    The exact score of a candidate is taken while its vector is at hand, so reranking needs no second read.
    """
    found = block_top(base, queries, [TopList(keep, scale)], space_type, exclude_self, block_bytes)
    return top_k(found, keep, HIGHER_IS_BETTER[space_type], "rank_score", rank="coarse_rank").select(
        "query_id", "vec_id", "coarse_rank", "score"
    )


def overquery_search(
    base: DataFrame, queries: DataFrame, k: int, factor: int, space_type: str = "innerproduct", scale: float = 127.0,
    exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Fetch ``k × factor`` candidates by quantised score, rerank them exactly, keep k."""
    found = overquery_candidates(base, queries, k * factor, space_type, scale, exclude_self, block_bytes)
    return top_k(found, k, HIGHER_IS_BETTER[space_type]).select("query_id", "rank", "vec_id", "score")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Per query, the share of the first k true neighbours that were found.

    A truth table with more neighbours than k is sliced to the first k. ``by`` names further columns of ``found``
    (run, knob value) to score separately. A query of the truth that was not answered scores 0, in each of the runs;
    the runs are those that answered anything, and the driver holds one row for each.
    """
    asked = truth.select("query_id").distinct()
    if by:
        runs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(by, r, strict=True)]) for r in found.select(*by).distinct().collect()]
        asked = asked.select("query_id", F.explode(F.array(*runs)).alias("_run")).select("query_id", "_run.*") if runs else asked.limit(0)
    wanted = truth.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("_true"))
    returned = found.filter(F.col("rank") <= k).select(*by, "query_id", "vec_id")
    hits = returned.join(wanted, ["query_id", "vec_id"], "left")
    scored = hits.groupBy(*by, "query_id").agg((F.count("_true") / F.lit(float(k))).alias("recall"))
    if by and not runs:
        return scored
    return asked.join(scored, [*by, "query_id"], "left").select(*by, "query_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))


def mean_recall(recall: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the queries of each group."""
    return recall.groupBy(*by).agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("queries"))


def quality_curve(
    base: DataFrame, queries: DataFrame, ks: Sequence[int], factors: Sequence[int], space_type: str = "innerproduct",
    scale: float = 127.0, exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(k, factor, recall, candidates)`` over a grid.

    The corpus is read once: a task keeps both the exact list for the largest k and the widest candidate list, and
    every grid point is a cut of these two.
    """
    better = HIGHER_IS_BETTER[space_type]
    widest = max(ks) * max(factors)
    found = block_top(base, queries, [TopList(max(ks)), TopList(widest, scale)], space_type, exclude_self, block_bytes)
    # Every query has equally many candidates, so one shuffle by query serves all steps below.
    found = found.repartition("query_id")
    way = F.col("rank_score").desc() if better else F.col("rank_score").asc()
    per_list = Window.partitionBy("list", "query_id").orderBy(way, "vec_id")
    exact = F.col("list") == 0
    ranked = found.withColumn("_r", F.row_number().over(per_list)).filter(F.col("_r") <= widest)
    pairs = ranked.filter(~exact | (F.col("_r") <= max(ks))).groupBy("query_id", "vec_id").agg(
        F.max(F.when(exact, F.col("_r"))).alias("true_rank"),
        F.max(F.when(~exact, F.col("_r"))).alias("coarse_rank"),
        F.max(F.when(~exact, F.col("score"))).alias("score"),
    )
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("factor")) for k in ks for f in factors])
    inside = F.filter(grid, lambda p: F.col("coarse_rank") <= p["k"] * p["factor"])
    cut = pairs.filter(F.col("coarse_rank").isNotNull()).withColumn("_p", F.explode(inside)).select("*", "_p.*")
    by_score = F.col("score").desc() if better else F.col("score").asc()
    order = Window.partitionBy("k", "factor", "query_id").orderBy(by_score, "vec_id")
    scored = cut.withColumn("rank", F.row_number().over(order))
    hit = (F.col("rank") <= F.col("k")) & (F.col("true_rank") <= F.col("k"))
    per_query = scored.groupBy("k", "factor", "query_id").agg(
        (F.count_if(hit) / F.first("k").cast("double")).alias("recall"), F.count(F.lit(1)).alias("candidates")
    )
    return per_query.groupBy("k", "factor").agg(
        F.avg("recall").alias("recall"), F.sum("candidates").alias("candidates")
    )
