"""Mixing sources to target weights.

Each source's words, in an order of its documents, are packed into blocks of a fixed number of words; small sources have
smaller blocks. The output is a sequence of shards of equally many slots. A source's slots in all are its target over
the words that its blocks hold on average, rounded up or down by a draw that keeps the expectation. Per shard every source
gets the whole part of its expected count and the rest is drawn without replacement, so that the totals hold. The
slots of a source are numbered through all shards; slot ``s`` is block ``s mod n`` of the source's order in its round
``s div n``, and each round orders the ``n`` blocks by its own pseudorandom permutation. Blocks then join slots by
index. A source has at most ``REPEATS`` rounds, so no document is taken more often than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm.tables import partitions, text_of, word_list, written

BLOCK = 32  # words at most
BLOCKS = 64  # blocks that a source has at least, if it has as many words
SHARD = 4_096  # slots of an output shard
REPEATS = 3
CHUNK = 512  # documents that are ordered together at least, about
SHARDS = 1 << 16  # shards at most; beyond, shards are longer
STEP = 1 << 20  # slots that a task fills at once
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: Sequence[int] = (1, 2, 3), repeats: int = REPEATS) -> dict[str | None, float]:
    """Target words per source. Sources by code point, null last, weigh ``weights`` in turn and share all words.

    No target is above ``repeats`` times its source; what is too much is shared out again by weight among the others
    until none is above. Without words all targets are 0.
    """
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    found = dict.fromkeys(order, 0.0)
    left, free = float(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[x] for x in free)
        full = [x for x in free if left * weight[x] / total > repeats * sizes[x]]
        if not full:
            found.update({x: left * weight[x] / total for x in free})
            break
        for x in full:
            found[x] = float(repeats * sizes[x])
            left -= found[x]
        free = [x for x in free if x not in full]
    return found


def width_of(size: int) -> int:
    """Words of the blocks of a source of ``size`` words."""
    return max(1, min(BLOCK, size // BLOCKS))


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. n - 1`` at ``index``: a Feistel network on the next even power of two, walked
    until it is below ``n``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    found = once(index.astype(np.uint64))
    while (out := found >= np.uint64(n)).any():
        found[out] = once(found[out])
    return found.astype(np.int64)


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per input row: ``_id, print`` (a hash of the text), ``source, size`` (words), ``start``, its first word in
    its source, and ``width``, the words of its source's blocks.

    A source's documents follow each other by chunk (a hash), then by id and print; rows that agree in both are
    interchangeable. Chunks are about as many as the documents of one, so that neither the ordering of a chunk nor the
    running totals over a source's chunks is a large task.
    """
    text = text_of(text_col)
    size = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    counted = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("print"), F.col(source_col).cast("string").alias("source"), size)
    counted = written(counted, "sizes")
    rows = counted.count()
    chunks = max(1, rows // max(CHUNK, int(rows**0.5)))
    counted = counted.withColumn("chunk", F.pmod(F.xxhash64("_id", "print"), F.lit(chunks)))
    total = counted.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = total.withColumn("before", F.expr("sum(words) over (partition by source order by chunk rows unbounded preceding) - words"))
    width = f"greatest(1, least({BLOCK}, sum(words) over (partition by source) div {BLOCKS}))"
    before = before.withColumn("width", F.expr(width).cast("long"))
    inside = "sum(size) over (partition by source, chunk order by _id, print rows unbounded preceding) - size"
    here = F.col("b.source").eqNullSafe(F.col("o.source")) & (F.col("b.chunk") == F.col("o.chunk"))
    out = counted.withColumn("inside", F.expr(inside)).alias("o").join(before.alias("b"), here)
    return written(out.select("_id", "print", "o.source", "size", (F.col("before") + F.col("inside")).alias("start"), "width"), "places")


def rounded(share: np.ndarray, seed: int) -> np.ndarray:
    """Whole numbers that are each the one below or above and whose expectation is ``share``; sums are off by less than 2."""
    rng = np.random.default_rng([seed, 1])
    order = rng.permutation(len(share))
    whole = np.floor(share + 1e-9)
    steps = np.floor(np.concatenate([[0.0], np.cumsum(np.maximum(share - whole, 0)[order])]) + rng.random())
    whole[order] += np.diff(steps)
    return whole.astype(np.int64)


def slots(spark, sizes: dict[str | None, int], goal: dict[str | None, float], seed: int = 0) -> DataFrame:
    """``(shard, source, round, block)``: one row per slot of the output.

    All draws go by the seed, so reruns and retries agree, and each shard's counts are found without those of others: what
    the whole parts leave is one list of slots in order of source, which a permutation deals out to the shards. The driver
    holds a few numbers per source; the slots are made in tasks, a source's running totals by exact arithmetic.
    """
    order = [x for x in sorted(sizes, key=lambda x: (x is None, x or "")) if sizes[x]]
    blocks = np.array([-(-sizes[x] // width_of(sizes[x])) for x in order], np.int64)
    share = np.array([goal[x] / sizes[x] for x in order]) * blocks
    wanted = np.minimum(rounded(share, seed), REPEATS * blocks)
    total = int(wanted.sum())
    length = max(SHARD, -(-total // SHARDS))
    shards = -(-total // length)
    kind = "shard long, source string, round int, block long"

    def fixed(size: int) -> np.ndarray:
        return np.array([int(n) * size // total for n in wanted.tolist()], np.int64)  # exact however large

    full = fixed(length) if shards > 1 else None
    last_size = total - (shards - 1) * length
    last_whole = fixed(last_size) if shards else None
    spare = length - int(full.sum()) if shards > 1 else 0
    rest = wanted - (full * (shards - 1) if shards > 1 else 0) - (last_whole if shards else 0)
    ends = np.cumsum(rest)

    def draw(shard: int) -> np.ndarray:
        whole = last_whole if shard == shards - 1 else full
        left = last_size - int(whole.sum()) if shard == shards - 1 else spare
        if not left:
            return whole
        at = permuted(np.arange(left, dtype=np.int64) + shard * spare, int(ends[-1]), f"{seed}/rest")
        return whole + np.bincount(np.searchsorted(ends, at, "right"), minlength=len(whole))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(order)), pa.array(np.arange(len(order))), pa.array(draw(shard))], ["shard", "s", "n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, n, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                last = min(first + n, REPEATS * int(blocks[s]))
                for begin in range(first, last, STEP):
                    slot = np.arange(begin, min(begin + STEP, last), dtype=np.int64)
                    turn, index = slot // blocks[s], slot % blocks[s]
                    block = np.empty(len(slot), np.int64)
                    for t in np.unique(turn).tolist():
                        block[turn == t] = permuted(index[turn == t], int(blocks[s]), f"{seed}/{order[s]}/{t}")
                    columns = [pa.array(np.full(len(slot), shard)), pa.array([order[s]] * len(slot), pa.string()), pa.array(turn.astype(np.int32)), pa.array(block)]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "source", "round", "block"])

    drawn = spark.range(0, shards, 1, max(1, min(shards, 1 + shards // 64))).mapInArrow(counts, "shard long, s long, n long")
    running = drawn.withColumn("first", F.expr("sum(n) over (partition by s order by shard rows unbounded preceding) - n"))
    dealt = running.select("shard", "s", "n", "first").filter("n > 0").repartition(partitions(spark), "shard", "s")
    return dealt.mapInArrow(fill, kind)  # many more rows than a planner expects of it, so joins with it ask for a merge


def pieces(where: DataFrame) -> DataFrame:
    """``where`` with a row per block that a document touches: ``block``, and its words ``begin`` to ``end`` (exclusive)."""
    first, last = F.expr("start div width"), F.expr("(start + size - 1) div width")
    out = where.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * F.col("width") - F.col("start"), F.lit(0))
    return out.withColumn("begin", begin).withColumn("end", F.least((F.col("block") + 1) * F.col("width") - F.col("start"), F.col("size")))


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], seed: int):
    """Places of the documents, words per source, target per source, and the slots of the output."""
    where = placed(docs, id_col, text_col, source_col)
    sizes = {r["source"]: r["size"] for r in where.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes, weights)
    return where, sizes, goal, slots(docs.sparkSession, sizes, goal, seed)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3), seed: int = 0,
) -> DataFrame:
    """One row per input row: the id, ``size``, ``source_size``, ``target`` (of its source) and ``taken`` (words, with repeats).

    A null or empty text has no words and is not taken. Null sources are one source. Rows that repeat an id and a text
    are documents of their own. An empty table gives an empty result. The driver holds the sources, one number each. A very
    long text is counted in one pass and spans as many blocks as it has; columns other than the three are not read.
    """
    where, sizes, goal, filled = plan(docs, id_col, text_col, source_col, weights, seed)
    times = filled.groupBy("source", "block").agg(F.count("*").alias("times"))
    met = pieces(where).alias("p").join(times.alias("t").hint("merge"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
    taken = met.groupBy(F.col("p.source").alias("_s"), F.col("start").alias("_p")).agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_p")) & (F.col("size") > 0)
    out = where.join(taken, same, "left")
    rows = [(x, sizes[x], goal[x]) for x in sizes]
    known = docs.sparkSession.createDataFrame(rows, "_n string, source_size long, target double")
    out = out.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_n")), "left")  # a row per source
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3), seed: int = 0, size_col: str | None = None,
) -> DataFrame:
    """``docs`` as the mix takes them: per round the words that are taken of each document, as a row with its columns.

    A document that a round takes whole keeps its text as it is; of another the taken words stay in order, one space
    apart. ``size_col``, if given, is set to the length of the text. What no round takes is left out.
    """
    where, _, _, filled = plan(docs, id_col, text_col, source_col, weights, seed)
    met = pieces(where).alias("p").join(filled.alias("t").hint("merge"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")))
    parts = met.groupBy("_id", "print", F.col("p.source").alias("_s"), "start", "size", "round").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_parts"), F.sum(F.col("end") - F.col("begin")).alias("_words"))
    rounds = parts.groupBy("_id", "print", "_s", "start", "size").agg(F.collect_list(F.struct("round", "_parts", "_words")).alias("_rounds"))
    # Rows that agree in id and print are told apart by number only.
    rounds = rounds.withColumn("_row", F.expr("row_number() over (partition by _id, print, _s order by start)"))
    text = text_of(text_col)
    named = docs.withColumn("_print", F.xxhash64(text)).withColumn("_source", F.col(source_col).cast("string"))
    named = named.withColumn("_key", F.col(id_col)).withColumn("_row", F.expr("row_number() over (partition by _key, _print, _source order by _key)"))
    same = (
        F.col("d._key").eqNullSafe(F.col("r._id")) & (F.col("d._print") == F.col("r.print"))
        & F.col("d._source").eqNullSafe(F.col("r._s")) & (F.col("d._row") == F.col("r._row"))
    )
    words = word_list(F.col(f"d.{text_col}").cast("string"))  # once per document: below the explode, not in the lambda
    out = named.alias("d").join(rounds.alias("r"), same).withColumn("_text_words", words).withColumn("_round", F.explode("_rounds"))
    some = F.array_join(F.flatten(F.transform("_round._parts", lambda x: F.slice("_text_words", x["begin"].cast("int") + 1, (x["end"] - x["begin"]).cast("int")))), " ")
    taken = F.when(F.col("_round._words") == F.col("r.size"), F.col(f"d.{text_col}")).otherwise(some)
    columns = []
    for c in docs.columns:
        value = taken if c == text_col else F.char_length(taken).cast(docs.schema[c].dataType) if c == size_col else F.col(f"d.{c}")
        columns.append(value.alias(c))
    return out.select(*columns)
