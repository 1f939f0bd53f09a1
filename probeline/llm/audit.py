"""Filter interaction audit: what each filter removes under every order of the filters.

Documents meet only as counts per part and set of failed filters (a mask). A mask is a row that holds 0 for a failed
filter and infinity for a passed one; an order is the row of its inverse permutation, each filter's position. The min-plus
product of the two, the least ``mask + position`` over the filters, is the step at which a mask is removed under an order.
Weighted counts scattered by that step give removals and losses; positions behind it give redundancies.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.llm import textbytes as tb
from probeline.llm.tables import text_of, written

NEVER = 127  # the step of a mask without a failed filter
LISTED = 1 << 17  # rows of a table that are broadcast at most


def orders(filters: int) -> np.ndarray:
    """All orders of so many filters: row by row the filter at each position."""
    return np.array(list(itertools.permutations(range(filters))), np.int64).reshape(-1, filters)


def positions(order: np.ndarray) -> np.ndarray:
    """The inverse of each order: the position (from 1) of each filter."""
    found = np.empty_like(order)
    np.put_along_axis(found, order, np.arange(1, order.shape[1] + 1)[None], 1)
    return found


def removal_steps(masks: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Orders x masks: the min-plus product of positions and masks (bit i: filter i fails); ``NEVER`` where nothing fails."""
    fails = (masks[:, None] >> np.arange(position.shape[1])) & 1
    cost = np.where(fails == 1, 0, NEVER)
    found = np.full((len(position), len(masks)), NEVER, np.int64)
    for i in range(position.shape[1]):
        np.minimum(found, position[:, i, None] + cost[None, :, i], out=found)
    return found


def tally(masks: np.ndarray, weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Orders x steps of each count, from masks and their weights (columns: documents, good ones, toxic ones)."""
    order = orders(filters)
    step = removal_steps(masks, positions(order))
    lost = np.zeros((len(order), filters, 3), np.int64)
    for s in range(filters):
        lost[:, s] = (step == s + 1) @ weights
    fails = (masks[:, None] >> np.arange(filters)) & 1
    late = np.zeros((len(order), filters), np.int64)
    for s in range(filters):
        late[:, s] = ((step <= s) & (fails.T[order[:, s]] == 1)) @ weights[:, 0]
    alone = np.array([weights[masks == 1 << i, 0].sum() for i in range(filters)], np.int64)
    removed = lost[:, :, 0]
    share = np.zeros(filters, np.int64)
    np.add.at(share, order.ravel(), removed.ravel())
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed, 1), "removed": removed, "redundant": late, "unique_fails": alone[order],
        "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": share[order],
    }


#: Failure conditions of the filters that read one text, over what ``measured`` counts.
CONDITIONS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_points",
    "D": "n_symbols > 0",
}


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, 0 for white space; and the bit of each byte's kind: code point, capital, symbol."""
    values = tb.exact_values().copy()
    values[tb.white()] = 0
    kind = np.zeros((3, 256), bool)
    kind[0] = (np.arange(256) & 0xC0) != 0x80
    kind[1, ord("A") : ord("Z") + 1] = True
    kind[2, [ord(x) for x in "#$%&*|"]] = True
    return values, kind


def text_counts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Words, distinct words, code points, capitals and symbols of each text in a block."""
    values, kinds = _kinds()
    start, _, first = tb.words(data, at)
    bits = np.uint64((len(at) - 1).bit_length())  # few where texts are long, so that hashes keep nearly all of theirs
    text = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(first))
    keys = np.unique((text << (np.uint64(64) - bits)) | (tb.word_hashes(data, start, values) >> bits))
    owner = (keys >> (np.uint64(64) - bits)).astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(kind[data])]) for kind in kinds]
    return [np.diff(first), np.bincount(owner, minlength=len(at) - 1), *(x[at[1:]] - x[at[:-1]] for x in sums)]


def measured(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep``, and ``name`` (SHA-256) and counts of each text; a null text is empty."""
    counts = ["n_words", "n_distinct", "n_points", "n_capitals", "n_symbols"]
    base = docs.select(*keep, F.unhex(F.sha2(text_of(text_col), 256)).alias("name"), text_of(text_col).alias("_text"))
    kind = T.StructType([*base.schema.fields[:-1], *(T.StructField(x, T.LongType()) for x in counts)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in tb.blocks(batch.columns[-1]):
                own = batch.slice(row, len(at) - 1).columns[:-1]
                found = [pa.array(x, pa.int64()) for x in text_counts(data, at)]
                yield pa.RecordBatch.from_arrays([*own, *found], kind.names)

    return base.mapInArrow(work, kind)


def masks(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, str] = CONDITIONS, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """``(part, mask, good, toxic, n)``: rows per part, failed filters and labels. The last bit, after those of
    ``conditions``, stands for a text that a row of a smaller id has as well.

    Texts are compared by SHA-256. Rows are counted per id, text and part first, then per text and part, so neither copies
    of a text nor a hot part nor repeated rows meet in one task. A null part is the empty string. A row without an id has
    no labels, is no copy, and makes no other row one. An id counts as good or toxic if any of its labels says so.
    """
    bit = sum((F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), text_of(part_col).alias("part"), F.col(text_col).alias("text"))
    base = measured(base, "text", ["id", "part"]).select("id", "name", "part", bit.alias("mask"))
    rows = written(base.groupBy("id", "name", "part", "mask").agg(F.count("*").alias("n")), "audit")
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter("id is not null").join(marks, "id", "left").select(
        "id", "name", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kinds = ["name", "part", "mask", "good", "toxic"]
    known = written(known.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low")), "audit-texts")
    last = F.lit(1 << len(conditions))
    lows = known.groupBy("name").agg(F.min("low").alias("least"), F.sum("n").alias("all"), F.min_by("n_low", "low").alias("n_least"))
    copied = lows.filter("all > n_least").select("name", "least")  # a text of one id alone has no copy
    copied = written(copied, "audit-copies")
    copied = F.broadcast(copied) if copied.count() <= LISTED else copied
    met = known.join(copied, "name", "left")
    first = F.when(F.col("least").isNull(), F.col("n")).when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(F.lit(0))
    nameless = rows.filter("id is null").groupBy("part", "mask").agg(F.sum("n").alias("n"))
    found = (
        met.select("part", "mask", "good", "toxic", first.alias("n"))
        .union(met.select("part", F.col("mask").bitwiseOR(last), "good", "toxic", F.col("n") - first))
        .union(nameless.select("part", "mask", F.lit(0), F.lit(0), "n"))
    )
    return found.filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, with its counts, zeros included.

    ``counts`` is what ``masks`` gives: ``4 * 2 ** len(filters)`` rows per part at most, which meet as one list.
    """
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    order = orders(len(filters))
    steps = np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(order))
    labels = pa.array(np.repeat(["".join(filters[i] for i in row) for row in order], len(filters)).tolist(), pa.string())
    kind = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in names)
    columns = ["part", "filter_order", "step", *names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.array([x["n"] for x in cells], np.int64)
                weights = np.stack([n, n * [x["good"] for x in cells], n * [x["toxic"] for x in cells]], 1)
                found = tally(np.array([x["mask"] for x in cells], np.int64), weights, len(filters))
                rest = [pa.array(found[x].ravel(), pa.int64()) for x in names]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), labels, pa.array(steps), *rest], columns)

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    return cells.mapInArrow(work, kind)


def interactions(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """The audit of the five filters: few words, few distinct words, capitals, symbols, and copies of a smaller id's text.

    Null and empty texts fail the first; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    return audit(masks(docs, labels, CONDITIONS, id_col, text_col, part_col), [*CONDITIONS, "E"])
