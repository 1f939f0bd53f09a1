"""Removal of long repeated passages by a sorted, range-partitioned set of suffixes.

Which bytes start a 200-byte string that also starts elsewhere is decided on every byte, but suffixes are sorted only at
anchors: in each 200-byte string the smallest hash of 32 bytes among its first 128 positions is its anchor, so equal
strings have their anchors at equal offsets. An anchor's suffix and the bytes before it, back to the first string whose
anchor it is, hold all strings of that anchor.

1. Anchors whose following 73 bytes occur once cannot take part; counting hashes of those bytes drops them.
2. The other suffixes are range-partitioned by their leading bytes with sampled splitters (ties by place, so a passage
   that repeats very often is split). A bucket sorts its suffixes by multikey quicksort on 8-byte words. The common bytes
   of neighbours, forward and backward, prove strings to be repeated; strings of a run of suffixes with the same 73
   leading bytes that no neighbour proves are compared by their hashes.
3. A run at either end of a bucket may go on in the next. Its strings are compared across all buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeline.llm import textbytes as tb
from probeline.llm.tables import partitions, text_of, tidy, written

SIZE = 200  # bytes of a repeated string
GRAM = 32  # bytes an anchor is chosen by
SPREAD = 128  # positions an anchor is chosen from
LEAD = SIZE - SPREAD + 1  # bytes from its anchor on that every string has
BUCKET = 20_000  # suffixes per bucket; a task holds all strings of one
LISTED = 1 << 20  # ids that are broadcast at most
SMALL = 48  # suffixes that are sorted without further splitting


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor, first and last string start of each anchor in a block of texts, and the block's hash sums."""
    total = tb.sums(data)
    none = np.empty(0, np.int64)
    if len(data) < SIZE:
        return none, none, none, none, total
    place = np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    best = (tb.stretch(total, place.astype(np.int64), GRAM) & np.uint64(0xFFFFFFFF00000000)) | place
    step = 1
    while step < SPREAD:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    size = np.diff(at)
    many = np.maximum(size - SIZE + 1, 0)
    row = np.repeat(np.arange(len(size)), many)
    begin = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(many) - many), many)
    anchor = (best[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return row[first], anchor[first], begin[first], begin[last], total


def _anchor_keys(texts: DataFrame) -> DataFrame:
    """``(key, doc, at)`` of every anchor of ``texts`` (``doc``, ``text``), once per task for equal texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            name = batch.column(0).to_numpy()
            fresh = []
            for i, x in enumerate(name.tolist()):
                fresh.append(x not in seen)
                seen.add(x)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            name = batch.column(0).to_numpy()
            for begin, data, at in tb.blocks(batch.column(1)):
                row, anchor, _, _, total = anchors(data, at)
                columns = [tb.stretch(total, anchor, LEAD).astype(np.int64), name[begin + row], anchor - at[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "doc", "at"])

    return texts.mapInArrow(tidy(work), "key long, doc long, at long")


def _suffixes(texts: DataFrame) -> DataFrame:
    """``(lead, back, name, at)`` of the anchors listed in ``places``; ``texts`` has ``name, places, text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, places = batch.column(0).to_pylist(), batch.column(1)
            for begin, data, at in tb.blocks(batch.column(2)):
                row, anchor, first, last, _ = anchors(data, at)
                ends = np.searchsorted(row, np.arange(len(at)))
                raw = data.tobytes()
                found: list[tuple[bytes, bytes, bytes, int]] = []
                for i in range(len(at) - 1):
                    mine = slice(ends[i], ends[i + 1])
                    wanted = np.isin(anchor[mine] - at[i], places[begin + i].values.to_numpy())
                    some = zip(*(x[mine][wanted].tolist() for x in (anchor, first, last)), strict=True)
                    found += [(raw[x : q + SIZE], raw[p:x], names[begin + i], x - int(at[i])) for x, p, q in some]
                if found:
                    lead, back, name, place = zip(*found, strict=True)
                    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip((lead, back, name, place), kinds, strict=True)], ["lead", "back", "name", "at"])

    return texts.select("name", "places", "text").mapInArrow(tidy(work), "lead binary, back binary, name binary, at long")


def multikey_order(texts: list[bytes]) -> np.ndarray:
    """Positions of ``texts`` in byte order, by multikey quicksort on words of 8 bytes."""
    width = -(-max(map(len, texts), default=0) // 8)
    words = np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in texts), ">u8").reshape(len(texts), width).astype(np.uint64)
    done: list[np.ndarray] = []
    stack = [(np.arange(len(texts)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= SMALL or depth == width:
            done.append(np.array(sorted(rows.tolist(), key=texts.__getitem__), np.int64))
            continue
        word = words[rows, depth]
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        stack.append((rows[word > pivot], depth))
        stack.append((rows[word == pivot], depth + 1))
        stack.append((rows[word < pivot], depth))
    return np.concatenate(done) if done else np.empty(0, np.int64)


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)
    return found, np.array([len(x) for x in texts], np.int64)


def _common(grid: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Leading bytes that each row shares with the next."""
    differ = grid[1:] != grid[:-1]
    here = np.where(differ.any(1), differ.argmax(1), grid.shape[1])
    return np.minimum(here, np.minimum(size[1:], size[:-1]))


def bucket_spans(lead: list[bytes], back: list[bytes], name: list[bytes], at: list[int]) -> tuple[list, list]:
    """Of a bucket's suffixes: removed spans ``(name, start, end)``, and strings to be compared with other buckets as
    ``(hash, name, start)``, the last two None where the string is known to be repeated already."""
    order = multikey_order(lead)
    lead, back, name = [lead[i] for i in order], [back[i] for i in order], [name[i] for i in order]
    place = np.array(at, np.int64)[order]
    ahead, n_lead = _matrix(lead, SIZE)
    new = np.ones(len(lead), bool)
    new[1:] = (ahead[1:, :LEAD] != ahead[:-1, :LEAD]).any(1)
    run = np.cumsum(new) - 1
    edge = (run == 0) | (run == run[-1])
    keep = np.flatnonzero((np.bincount(run)[run] > 1) | edge)
    behind, n_back = _matrix([x[::-1] for x in back], SPREAD)
    forward, backward = _common(ahead, n_lead), _common(behind, n_back)
    many = n_back + n_lead - SIZE + 1  # strings of a suffix; the one with i bytes before the anchor is number n_back - i
    many_kept = many[keep]
    base = np.full(len(lead), -1)
    base[keep] = np.cumsum(many_kept) - many_kept
    steps = np.zeros(int(many_kept.sum()) + 1, np.int64)
    for side in (0, 1):
        mine = np.arange(len(lead) - 1) + side
        low = np.maximum(n_back[mine] - backward, 0)
        high = np.minimum(n_back[mine] - (SIZE - forward), many[mine] - 1)
        good = np.flatnonzero((low <= high) & (base[mine] >= 0) & ~new[1:])
        np.add.at(steps, base[mine][good] + low[good], 1)
        np.add.at(steps, base[mine][good] + high[good] + 1, -1)
    known = np.cumsum(steps)[:-1] > 0
    hashes = np.empty(len(known), np.uint64)
    for begin in range(0, len(keep), 4096):
        some = keep[begin : begin + 4096]
        whole = [back[i] + lead[i] for i in some]
        total = tb.sums(np.frombuffer(b"".join(whole), np.uint8))
        start = np.cumsum([0, *map(len, whole)])[:-1]
        n = many[some]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hashes[base[some[0]] : base[some[0]] + len(inner)] = tb.stretch(total, np.repeat(start, n) + inner, SIZE)
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    known |= count[which] > 1
    owner = np.repeat(keep, many_kept)
    begin = np.repeat(place[keep] - n_back[keep], many_kept) + np.arange(len(owner)) - np.repeat(base[keep], many_kept)
    rise = known.copy()
    rise[1:] &= ~(known[:-1] & (owner[1:] == owner[:-1]))
    fall = known.copy()
    fall[:-1] &= ~(known[1:] & (owner[1:] == owner[:-1]))
    spans = [(name[o], p, q + SIZE) for o, p, q in zip(owner[rise].tolist(), begin[rise].tolist(), begin[fall].tolist(), strict=True)]
    outer = np.flatnonzero(edge[owner])
    told = np.unique(hashes[outer[known[outer]]]).astype(np.int64).tolist()
    open_ones = outer[~known[outer]]
    asked = zip(hashes[open_ones].astype(np.int64).tolist(), owner[open_ones].tolist(), begin[open_ones].tolist(), strict=True)
    return spans, [(h, None, None) for h in told] + [(h, name[o], p) for h, o, p in asked]


def _buckets(suffixes: DataFrame) -> DataFrame:
    """``(name, first, last, hash)``: spans (hash null) and strings to be compared across buckets (last null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}  # a repeated input row is one text here
        for batch in batches:
            lead, back, name, at = (batch.column(i).to_pylist() for i in range(4))
            rows.update(zip(zip(name, at, strict=True), zip(lead, back, strict=True), strict=True))
        if not rows:
            return
        spans, strings = bucket_spans([x[0] for x in rows.values()], [x[1] for x in rows.values()], [x[0] for x in rows], [x[1] for x in rows])
        kinds = {"name": pa.binary(), "first": pa.int64(), "last": pa.int64(), "hash": pa.int64()}
        whole = [*((n, p, q, None) for n, p, q in spans), *((n, p, None, h) for h, n, p in strings)]
        for begin in range(0, len(whole), 100_000):
            columns = zip(*whole[begin : begin + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return suffixes.mapInArrow(tidy(work), "name binary, first long, last long, hash long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans: those that overlap or touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def _removed(texts: DataFrame) -> DataFrame:
    """``(name, n_removed, spans, kept)`` from ``name, spans, text``."""
    kind = "name binary, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            found = []
            for name, spans, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                first, last = merged(spans.values.field(0).to_numpy(), spans.values.field(1).to_numpy())
                stay = zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True)
                each = [{"first": p, "last": q} for p, q in zip(first.tolist(), last.tolist(), strict=True)]
                found.append((name, int((last - first).sum()), each, b"".join(raw[p:q] for p, q in stay)))
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.int64(), pairs, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["name", "n_removed", "spans", "kept"])

    return texts.mapInArrow(tidy(work), kind)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs) and ``kept_sha256``.

    A byte goes if it is under a 200-byte string that also starts elsewhere, in the same text, another one or a repeated
    row; matches do not cross texts. A null text is empty and shorter texts lose nothing. Rows with equal texts of 200
    bytes or more lose all; one of them stands for all in what follows. Null ids are ids like others. A text of any length is one block of bytes in its
    task; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    marks = base.select("_id", F.xxhash64("text").alias("doc"), F.unhex(F.sha2("text", 256)).alias("name"), F.octet_length("text").cast("long").alias("n_bytes"))
    marks = written(marks, "texts")
    kinds = marks.filter(F.col("n_bytes") >= SIZE).groupBy("name").agg(F.min("_id").alias("_first"), F.min("doc").alias("doc"), F.count("*").alias("copies"))
    kinds = written(kinds, "kinds")

    keyed = _anchor_keys(base.filter(F.octet_length("text") >= SIZE).select(F.xxhash64("text").alias("doc"), "text"))
    place = F.xxhash64("doc", "at")
    twice = keyed.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("key")
    held = written(keyed.join(twice, "key", "left_semi").select("doc", "at").distinct(), "anchors")
    listed = held.groupBy("doc").agg(F.collect_list("at").alias("places")).join(kinds.select("doc", "name", "_first"), "doc")
    listed = written(listed.select("name", "_first", "places"), "places")
    suffixes = _suffixes(_with_text(base, listed))
    buckets = max(partitions(spark), held.count() // BUCKET + 1)
    sorted_out = written(_buckets(suffixes.repartitionByRange(buckets, "lead", "back", "name", "at")), "spans")

    strings = sorted_out.filter("hash is not null")
    again = strings.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    across = strings.filter("name is not null").join(again, "hash", "left_semi").select("name", "first", (F.col("first") + SIZE).alias("last"))
    spans = sorted_out.filter("hash is null").select("name", "first", "last").union(across)
    spans = spans.groupBy("name").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    alone = kinds.filter("copies = 1").select("name", "_first")
    spans = written(spans.join(alone, "name").select("name", "_first", "spans"), "covered")
    cleaned = _removed(_with_text(base, spans).select("name", "spans", "text"))
    cleaned = cleaned.select("name", "n_removed", "spans", F.sha2("kept", 256).alias("kept_sha256"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last")))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    out = marks.join(kinds.select("name", "copies"), "name", "left").join(cleaned, "name", "left")
    return out.select(
        F.col("_id").alias(id_col), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("name")))).alias("kept_sha256"),
    )


def _with_text(base: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` (with ``_first``) and the text of that id whose hash is ``name``. Few ids are broadcast to spare a shuffle of texts."""
    texts = base.withColumnRenamed("_id", "_doc")
    if listed.count() <= LISTED:
        ids = F.broadcast(listed.select("_first").distinct())
        texts = texts.join(ids, F.col("_doc").eqNullSafe(F.col("_first")), "left_semi")
    texts = texts.withColumn("_name", F.unhex(F.sha2("text", 256)))
    same = F.col("_doc").eqNullSafe(F.col("_first")) & (F.col("_name") == F.col("name"))
    return texts.join(listed, same).drop("_doc", "_first", "_name")
