"""Phrase collocations by a distributed multikey quicksort of suffix pointers.

A suffix is a place in a piece of text with the words that follow it, four at most; words are 64-bit hashes that depend on
the language. Words are counted first. A fixed-size bit map of the frequent ones then ends each suffix before a word that
cannot be part of a frequent phrase (a chance hit only spares less work). Suffixes are routed to tasks by their leading
words: by the first alone, or, while the leading words are hot, by one more. Each task sorts its suffixes by multikey
three-way quicksort; the size of an equal partition is the count of its leading words. Partitions below the support are
abandoned where all their suffixes are known to have met; the counts of hot leading words are summed over the tasks.

A word is hot if it occurs more often than a task shall hold. A suffix goes by its leading words up to the first that is
not hot, so the suffixes that go with it are fewer than that word; where all are hot it goes by all of its words, and equal
suffixes of a block travel once, with their number. No group of leading words is unbounded in a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.llm import textbytes as tb
from probeline.llm.tables import partitions, tidy, written

DEPTH = 4  # words of a phrase at most
SUPPORT = 30
BITS = (1 << 20, 1 << 28)  # of a map of words, at least and at most
BLOCK = 1 << 21  # bytes of text that are worked on at once
GATHERED = 1 << 19  # suffixes that a task sorts, about
FLUSH = 1 << 19  # suffixes a task holds before it hands them on
LISTED = 1 << 17  # rows of a table that are broadcast at most
SMALL = 24  # suffixes of a partition that is sorted at once
_FACTORS = tb.mix(np.arange(11, 11 + DEPTH, dtype=np.uint64)) | np.uint64(1)


@functools.cache
def breaks() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end a word, and those that end a piece."""
    piece = np.zeros(256, bool)
    piece[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
    word = piece.copy()
    word[[0x20, 0x09]] = True
    return word, piece


@functools.cache
def letter_values() -> np.ndarray:
    """A random number per byte, equal for both cases of A-Z and 0 for bytes that end a word."""
    found = np.random.default_rng(20240417).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    found[ord("A") : ord("Z") + 1] = found[ord("a") : ord("z") + 1]
    found[breaks()[0]] = 0
    return found


def lang_number(lang: str) -> np.uint64:
    total = 0
    for byte in lang.encode():
        total = (total * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return tb.mix(np.array([total], np.uint64))[0]


def read(data: np.ndarray, at: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last byte and number of words left in the piece (itself included) of each word in a block of texts;
    ``langs`` has a number per text. Keys are never 0."""
    word, piece = breaks()
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~inside))
    if not len(start):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = tb.word_hashes(data, start, letter_values())
    text = np.searchsorted(at, start, "right") - 1
    keys = tb.mix(hashes + langs[text]) | np.uint64(1)
    ends = np.cumsum(piece[data])
    gap = ends[start] if len(ends) else start
    last = np.ones(len(start), bool)  # the last word of a piece
    last[:-1] = (gap[1:] != gap[:-1]) | (text[1:] != text[:-1])
    stops = np.flatnonzero(last)
    left = stops[np.searchsorted(stops, np.arange(len(start)))] - np.arange(len(start)) + 1
    return keys, start, end, left


def suffixes(keys: np.ndarray, left: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """``n x DEPTH`` keys of each place with two words or more: the words that follow in its piece up to the first that is
    not ``alive``, 0 behind them."""
    found = np.zeros((len(keys), DEPTH), np.uint64)
    good = np.ones(len(keys), bool)
    for d in range(DEPTH):
        n = max(len(keys) - d, 0)
        good = good[:n] & (left[:n] > d) & alive[d:]
        found[:n, d] = np.where(good, keys[d:], 0)
    return found[found[:, 1] > 0]


def prefix_ids(grid: np.ndarray) -> np.ndarray:
    """Ids of the leading 1 to ``DEPTH`` words of each suffix, 0 where it has fewer."""
    total = np.cumsum(np.where(grid > 0, tb.mix(grid * _FACTORS[: grid.shape[1]]), 0), 1, dtype=np.uint64)
    return np.where(grid > 0, tb.mix(total + np.arange(1, grid.shape[1] + 1, dtype=np.uint64)) | np.uint64(1), 0)


def multikey_counts(grid: np.ndarray, weight: np.ndarray, support: int, known: int) -> list[tuple[int, int, int]]:
    """``(row, depth, size)`` of equal partitions of two words or more: a row that begins with the words, and how many do.

    Depths below ``known`` may go on in other tasks, so their partitions are told whatever their size; below them, and
    among the partitions that are not equal, those under the support are abandoned.
    """
    found: list[tuple[int, int, int]] = []
    stack = [(np.arange(len(grid)), 0)]

    def equal(rows: np.ndarray, depth: int, size: int) -> None:
        if size >= support or depth + 1 < known:
            if depth:
                found.append((int(rows[0]), depth + 1, size))
            if depth + 1 < DEPTH:
                stack.append((rows, depth + 1))

    while stack:
        rows, depth = stack.pop()
        word = grid[rows, depth]
        some = np.flatnonzero(word)  # suffixes that end here are no longer phrases
        if len(some) < len(rows):
            rows, word = rows[some], word[some]
        if len(rows) == 0 or (depth + 1 >= known and int(weight[rows].sum()) < support):
            continue
        if len(rows) <= SMALL:
            order = np.argsort(word, kind="stable")
            rows, word = rows[order], word[order]
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            for p, q, size in zip(begin, [*begin[1:], len(rows)], np.add.reduceat(weight[rows], begin).tolist(), strict=True):
                equal(rows[p:q], depth, size)
            continue
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        low, same = word < pivot, word == pivot
        stack.append((rows[low], depth))
        stack.append((rows[~(low | same)], depth))
        rows = rows[same]
        equal(rows, depth, int(weight[rows].sum()))
    return found


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") > 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: languages, language of each text, bytes, and what ``read`` gives."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.to_pylist()
        numbers = np.array([lang_number(x) for x in names], np.uint64)
        which = langs.indices.to_numpy()
        for row, data, at in tb.blocks(batch.column(1), BLOCK):
            mine = which[row : row + len(at) - 1]
            keys, start, end, left = read(data, at, numbers[mine])
            yield names, mine[np.searchsorted(at, start, "right") - 1], data, keys, start, end, left


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(key, id, lang, word, f)``: all words of a language with their counts; words are lower-cased bytes, ``id`` is that
    of the word as a phrase."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "id": pa.int64(), "lang": pa.string(), "word": pa.binary(), "n": pa.int64()}
        small = np.arange(256, dtype=np.uint8)
        small[ord("A") : ord("Z") + 1] += 32
        for names, lang, data, keys, start, end, _ in _blocks(batches):
            key, first, n = np.unique(keys, return_index=True, return_counts=True)
            raw = small[data].tobytes()
            text = [raw[p:q] for p, q in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            columns = [key.view(np.int64), prefix_ids(key[:, None])[:, 0].view(np.int64), [names[i] for i in lang[first].tolist()], text, n]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    found = _texts(docs, text_col, lang_col).mapInArrow(tidy(work), "key long, id long, lang string, word binary, n long")
    return found.groupBy("key", "id", "lang", "word").agg(F.sum("n").alias("f"))


def bit_map(keys: DataFrame, count: int) -> np.ndarray:
    """Which classes (a power of two of them, 16 per key up to a bound) hold some ``key``, as packed bits. Tasks build it
    in pieces of 4 KiB, so the driver gets its fixed size and no keys."""
    bits = min(max(1 << (16 * max(count, 1) - 1).bit_length(), BITS[0]), BITS[1])
    place = keys.select((F.shiftrightunsigned("key", 8).bitwiseAND(bits - 1) + 1).alias("place"))
    rows = place.groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    found = np.zeros(bits // 8, np.uint8)
    for bucket, body in rows.collect():
        found[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(body)] = np.frombuffer(body, np.uint8)
    return found


def inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(8)) & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrase_counts(docs: DataFrame, words: DataFrame, total: int, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT) -> DataFrame:
    """``(id, k1, k2, k3, k4, depth, f)``: id, words and count of all phrases of 2 to 4 words that occur ``support`` times
    or more. ``words`` has the frequent words, ``total`` is the number of all occurrences."""
    spark = docs.sparkSession
    tasks = max(partitions(spark), total // GATHERED)
    often = words.filter(F.col("f") > max(min(total // tasks, GATHERED // 2), 1))
    shared = spark.sparkContext.broadcast((bit_map(words, words.count()), bit_map(often, 4 * tasks)))
    keys = [f"k{d + 1}" for d in range(DEPTH)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive, hot = shared.value
        held, rows = [], 0
        for _, _, _, key, _, _, left in _blocks(batches):
            grid = suffixes(key, left, inside(alive, key))
            ids = prefix_ids(grid)
            size = (grid > 0).sum(1)
            _, first, n = np.unique(ids[np.arange(len(ids)), size - 1], return_index=True, return_counts=True)
            grid, ids, size = grid[first], ids[first], size[first]
            known = 1 + np.cumprod(np.stack([inside(hot, grid[:, d]) for d in range(DEPTH - 1)], 1), 1).sum(1)
            route = (ids[np.arange(len(ids)), np.minimum(known, size) - 1] >> np.uint64(8)) % np.uint64(tasks)
            held.append((route.astype(np.int64), grid, known.astype(np.uint8), size.astype(np.uint8), n.astype(np.uint32)))
            rows += len(grid)
            if rows >= FLUSH:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """The suffixes of each part as one row of bytes: their known depths, sizes, numbers and keys."""
        route, grid, known, size, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(route, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(route[order]) > 0]))
        bodies = []
        for p, q in zip(begin, [*begin[1:], len(order)], strict=True):
            mine = order[p:q]
            some = grid[mine]
            bodies.append(known[mine].tobytes() + size[mine].tobytes() + n[mine].tobytes() + some[some > 0].tobytes())
        columns = [pa.array(route[order[begin]].astype(np.int32)), pa.array(np.diff(np.append(begin, len(order))).astype(np.int32)), pa.array(bodies, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "many", "body"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for many, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(body.as_buffer(), np.uint8)
                known, size = raw[:many], raw[many : 2 * many]
                n = raw[2 * many : 6 * many].copy().view(np.uint32).astype(np.int64)
                grid = np.zeros((many, DEPTH), np.uint64)
                grid[np.arange(DEPTH) < size[:, None]] = raw[6 * many :].copy().view(np.uint64)
                for depth in np.unique(known).tolist():
                    held.setdefault(depth, []).append((grid[known == depth], n[known == depth]))
        for depth in sorted(held):
            mine = held.pop(depth)
            some, weight = (np.concatenate(x) for x in zip(*mine, strict=True))
            del mine
            found = multikey_counts(some, weight, support, depth)
            for at in range(0, len(found), 1 << 16):
                row, deep, size = np.array(found[at : at + (1 << 16)], np.int64).T
                own = np.where(np.arange(DEPTH) < deep[:, None], some[row], 0).astype(np.uint64)
                name = prefix_ids(own)[np.arange(len(own)), deep - 1]
                columns = [name.view(np.int64), *(np.ascontiguousarray(own[:, d]).view(np.int64) for d in range(DEPTH)), deep.astype(np.int32), size, deep >= depth]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", *keys, "depth", "n", "all"])

    kind = " long, ".join(keys) + " long"
    made = _texts(docs, text_col, lang_col).mapInArrow(tidy(make), "part int, many int, body binary")
    routed = made.repartitionById(tasks, F.col("part"))
    found = written(routed.mapInArrow(tidy(sort), f"id long, {kind}, depth int, n long, all boolean"), "partitions")
    names = ["id", *keys, "depth"]
    summed = found.filter("not all").groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= support)
    return found.filter("all").select(*names, F.col("n").alias("f")).union(summed)


def _parts(phrases: DataFrame) -> DataFrame:
    """``phrases`` with the ids of both sides of each cut and of the shorter phrases (two words or more) inside."""
    keys = [f"k{d + 1}" for d in range(DEPTH)]
    kind = T.StructType([*phrases.schema, *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("left", "right", "inner"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([batch.column(x).to_numpy() for x in keys], 1).view(np.uint64)
            depth = batch.column("depth").to_numpy()
            ids = {}  # by first word: ids of the phrases that begin there
            for i in range(DEPTH):
                shifted = np.zeros_like(grid)
                shifted[:, : DEPTH - i] = grid[:, i:]
                ids[i] = prefix_ids(shifted).view(np.int64)
            left = [ids[0][row, : d - 1].tolist() for row, d in enumerate(depth.tolist())]
            right = [[int(ids[k][row, d - k - 1]) for k in range(1, d)] for row, d in enumerate(depth.tolist())]
            inner = [
                [int(ids[i][row, n - 1]) for i in range(d) for n in range(2, d - i + 1) if n < d] for row, d in enumerate(depth.tolist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int64())) for x in (left, right, inner))], kind.names)

    return phrases.mapInArrow(tidy(work), kind)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= LISTED else df


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, top: int = 2000, scale: int = 2_000_000
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of each language.

    A-Z count as lower case; a null language is ``und``; null and empty texts, and texts of delimiters, have no words. A
    word without white space of any length is one word. Repeated rows count each. ``a``, ``l`` and ``r`` are the counts of
    the phrase and of both sides of its worst cut, ``n`` all words of the language. Words are told apart by 64-bit hashes.
    An empty table, or one without a frequent phrase, gives no rows. Columns other than the two are not read.
    """
    words = written(word_counts(docs, text_col, lang_col), "words")
    sizes = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    total = sizes.agg(F.sum("n")).collect()[0][0] or 0
    words = words.filter(F.col("f") >= support)
    phrases = written(_parts(phrase_counts(docs, words, total, text_col, lang_col, support)), "phrases")

    freq = written(words.select("id", "f").union(phrases.select("id", "f")), "counts")
    freq = _small(freq.withColumnRenamed("f", "part"))
    cuts = phrases.select("id", "f", F.posexplode(F.arrays_zip("left", "right")).alias("k", "cut"))
    cuts = cuts.select("id", "f", "k", F.col("cut.left").alias("left"), F.col("cut.right").alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(freq.select(F.col("id").alias(side), F.col("part").alias(side[0])), side)
    cuts = cuts.withColumn("score", F.expr(f"(cast(f as decimal(38,0)) * {scale}) div (l + r)"))
    worst = cuts.groupBy("id").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")).select("id", "cut.*")
    longer = phrases.select(F.explode("inner").alias("id"), "f").groupBy("id").agg(F.max("f").alias("longest"))
    scored = phrases.join(longer, "id", "left").filter("longest is null or cast(longest as decimal(38,0)) * 100 < cast(f as decimal(38,0)) * 80")
    spoken = _small(written(words.select(F.col("key").alias("k1"), "lang"), "spoken"))
    scored = scored.select("id", *[f"k{d + 1}" for d in range(DEPTH)], F.col("f").alias("a")).join(worst, "id").join(spoken, "k1")
    order = [F.desc("score"), F.desc("a")]
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top)
    best = written(best.drop("place"), "best")  # the first ``top`` of each language, and ties with the last

    each = best.select("id", F.posexplode(F.array(*[f"k{d + 1}" for d in range(DEPTH)])).alias("at", "key")).filter("key <> 0")
    named = words.select("key", "word").join(_small(each.select("key").distinct()), "key", "left_semi")
    named = each.join(named, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("words"))
    named = named.select("id", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(named, "id").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")))
    ranked = ranked.filter(F.col("rank") <= top).join(F.broadcast(sizes) if sizes.count() <= LISTED else sizes, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
