"""Exact Jaccard join of documents on word shingles, by token-combination prefixes.

Shingles ("tokens") are ordered rare first. At threshold ``t`` a set of ``n`` tokens may miss at most
``e = n - ceil(t * n)`` of them in a partner, so any ``e + 1`` tokens share one. If the first ``e + 1`` tokens are all
rare, each is a signature by itself. Otherwise the prefix is extended to ``e + m + 1`` tokens: of these at least
``m + 1`` are shared, so a rare one is shared or, the frequent ones being dealt into ``m`` classes by hash, two of one
class. Rare tokens are signatures, and so are pairs of frequent tokens of one class. ``m`` depends on a level of sizes;
partners are at most one level apart, so a set uses its own level and the next.

Sets are verified against each other before a link is made: first by an exact bound on their symmetric difference from
sketches of parity bits, then by the sets themselves. A signature's members meet its smallest member (its centre) first.
Where they are then still in different components, all members of one centre are compared by their sketches, in blocks
inside tasks, so that a pair becomes a row only if the bound allows a link. Signatures with the same members count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.llm import textbytes as tb
from probeline.llm.components import components
from probeline.llm.tables import partitions, tidy, written

RARE = 16  # a token in at most so many texts is rare
HEAVY = 1 << 20  # at most so many tokens are told from rare ones by their counts; the bar rises to keep to it
PARTS = 2048  # ranges of token hashes that are counted apart
FLUSH = 1 << 19  # tokens a task holds before it hands them on
LISTED = 1 << 20  # ids that are broadcast at most
GATHERED = 1 << 21  # signatures that a task gathers, about
SALTS = 64  # tasks that the rows of a frequent signature are dealt to
BLOCK = 512  # members of a centre that are compared with as many others at once


def levels(percent: int, most: int = 1 << 40) -> list[int]:
    """Smallest size of each level, so that sizes which can be linked are at most one level apart."""
    starts = [1, 2]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return starts


def overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any partner."""
    return -(-percent * n // 100)


def text_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text."""
    for row, data, at in tb.blocks(column):
        start, _, first = tb.words(data, at)
        hashes, base = tb.shingles(tb.word_hashes(data, start), first, k)
        for i in range(len(at) - 1):
            yield row + i, np.unique(hashes[base[i] : base[i + 1]])


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit id of a set, equal for equal sets."""
    total = tb.mix(np.array([np.sum(tb.mix(tokens)), np.bitwise_xor.reduce(tb.mix(~tokens)), len(tokens)], np.uint64))
    return int(tb.mix(np.sum(total * np.array([1, 3, 5], np.uint64), keepdims=True)).astype(np.int64)[0])


def _distinct_sets(batches: Iterator[pa.RecordBatch], column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Id and tokens of every set that is not empty, once per task."""
    seen: set[int] = set()
    for batch in batches:
        for _, tokens in text_sets(batch.column(column), k):
            if len(tokens) and (name := set_id(tokens)) not in seen:
                seen.add(name)
                yield name, tokens


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of a power of two of hash classes, two or more per token.

    Two sets differ in at least as many tokens as their sketches differ in bits. Half a sketch is the exclusive or of
    its halves, so sketches of any two sets can be compared.
    """
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketch bytes, folded to ``size`` bytes."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def classes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(<id>, n, cls, sketch)`` per row: size, id and sketch of its set; an empty set has no id."""
    kind = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(x), set_id(x), sketch(x)) if len(x) else (0, None, None) for _, x in text_sets(batch.column(1), k)]
            rest = [pa.array([x[i] for x in sets], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], kind.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(work), kind)


def frequent(docs: DataFrame, text_col: str, k: int, rare: int = RARE, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The tokens in more than ``rare`` texts (48 bits of each, sorted) and their counts; equal texts of a task count once.

    All tokens of all texts are counted: tasks hand on sorted runs of tokens, packed by range, and each range is counted
    by itself. If more than ``most`` tokens are frequent, the bar doubles until at most that many are, which bounds what
    the driver holds and sends. The bar decides only how selective signatures are, never which links are found.
    """
    span = np.uint64((1 << 48) // PARTS)

    def pack(tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        run = np.sort(np.concatenate(tokens))
        at = np.searchsorted(run, np.arange(PARTS + 1, dtype=np.uint64) * span)
        low = (run % span).astype(np.uint64)
        raw = np.stack([(low >> np.uint64(8 * i)).astype(np.uint8) for i in range(5)], 1)
        bodies = [raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(bodies, pa.binary())], ["part", "body"])

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, tokens in _distinct_sets(batches, 0, k):
            held.append(tokens >> np.uint64(16))
            size += len(tokens)
            if size >= FLUSH:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bodies.setdefault(part, []).append(body)
        for part in sorted(bodies):
            raw = np.frombuffer(b"".join(bodies.pop(part)), np.uint8).reshape(-1, 5)
            low = sum(raw[:, i].astype(np.uint64) << np.uint64(8 * i) for i in range(5))
            token, n = np.unique(low, return_counts=True)
            keep = n > rare
            found = (token[keep] + np.uint64(part) * span).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[keep].astype(np.int64))], ["token", "n"])

    runs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(hand_on), "part int, body binary")
    counted = written(runs.repartition(partitions(docs.sparkSession), "part").mapInArrow(tidy(count), "token long, n long"), "frequent")
    steps = counted.groupBy(F.length(F.bin(F.expr(f"(n - 1) div {rare}"))).alias("step")).agg(F.count("*").alias("n")).collect()
    by_step = {r["step"]: r["n"] for r in steps}
    bar, left = 1, sum(by_step.values())
    while left > most:
        left -= by_step.get(bar, 0)
        bar += 1
    found = counted.filter(F.col("n") > rare * 2 ** (bar - 1)).toArrow()
    token = found.column("token").to_numpy().astype(np.uint64)
    order = np.argsort(token)
    return token[order], found.column("n").to_numpy()[order]


def signatures(docs: DataFrame, text_col: str, heavy: tuple[np.ndarray, np.ndarray], percent: int, k: int, tasks: int) -> DataFrame:
    """``(sig, cls, n, first, first_n, size, members)``: the members of signatures that several sets have, with the
    smallest member and its size, the number of members and a hash of them all.

    A rare token has a bounded number of members, so its rows meet in one task. Rows of pairs of frequent tokens are
    dealt out by salt and get the last four columns by a partial aggregation and a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    sent = {"sig": pa.int64(), "cls": pa.int64(), "n": pa.int64(), "salt": pa.int64()}
    found = {"sig": pa.int64(), "cls": pa.int64(), "n": pa.int64(), "first": pa.int64(), "first_n": pa.int64(), "size": pa.int64(), "members": pa.int64()}

    def packed(held: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
        many = np.array([len(x[0]) + len(x[1]) for x in held])
        sig = np.concatenate([x for one, two, _, _ in held for x in (one, two)]).astype(np.int64)
        salt = np.concatenate([np.concatenate([np.zeros(len(one), np.int64), np.full(len(two), 1 + name % SALTS)]) for one, two, name, _ in held])
        columns = [sig, np.repeat(np.array([x[2] for x in held]), many), np.repeat(np.array([x[3] for x in held]), many), salt]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], list(sent))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = shared.value
        starts = levels(percent)
        held, size = [], 0
        for name, tokens in _distinct_sets(batches, 0, k):
            one, two = prefix(tokens, names, counts, percent, starts)
            held.append((one, two, name, len(tokens)))
            size += len(one) + len(two)
            if size >= FLUSH >> 2:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy() for i in range(4)] for batch in batches]
        if not parts:
            return
        sig, cls, n, salt = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((cls, sig))
        sig, cls, n, salt = sig[order], cls[order], n[order], salt[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls, n, salt = sig[new], cls[new], n[new], salt[new]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(begin, len(sig)))
        members = np.bitwise_xor.reduceat(tb.mix(cls.astype(np.uint64)), begin).astype(np.int64)
        known = [np.repeat(x, size) for x in (cls[begin], n[begin], size, members)]
        keep = np.flatnonzero((known[2] > 1) | (salt > 0))
        nothing = salt[keep] > 0
        for at in range(0, len(keep), 1 << 18):
            some, null = keep[at : at + (1 << 18)], nothing[at : at + (1 << 18)]
            columns = [pa.array(x[some], pa.int64()) for x in (sig, cls, n)] + [pa.array(x[some], pa.int64(), mask=null) for x in known]
            yield pa.RecordBatch.from_arrays(columns, list(found))

    schema = lambda kinds: ", ".join(f"{x} long" for x in kinds)
    dealt = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(make), schema(sent)).repartition(tasks, "sig", "salt")
    rows = written(dealt.mapInArrow(tidy(gather), schema(found)), "signatures")
    often = rows.filter("first is null").select("sig", "cls", "n")
    same = often.groupBy("sig").agg(
        F.min("cls").alias("first"), F.expr("min_by(n, cls)").alias("first_n"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("members"))
    return rows.filter("first is not null").union(often.join(same.filter("size > 1"), "sig"))


def prefix(tokens: np.ndarray, names: np.ndarray, counts: np.ndarray, percent: int, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set of tokens (sorted), as unsigned 64-bit hashes: rare tokens, and what frequent ones give."""
    n = len(tokens)
    spare = n - overlap(n, percent)
    short = tokens >> np.uint64(16)
    at = np.minimum(np.searchsorted(names, short), max(len(names) - 1, 0))
    weight = np.where(names[at] == short, counts[at], 0) if len(names) else np.zeros(n, np.int64)
    rare = tokens[weight == 0]
    if len(rare) > spare:
        return rare[: spare + 1], rare[:0]
    heavy = tokens[weight > 0]
    heavy = heavy[np.lexsort((heavy, weight[weight > 0]))]
    level = int(np.searchsorted(starts, n, "right")) - 1
    found = []
    for here in (level, level + 1):
        smallest = starts[max(here - 1, 0)]
        groups = min(max(1, smallest // 8), overlap(smallest, percent) - 1)
        if groups < 1:  # too small to share two tokens for certain
            found.append(tb.mix(heavy[: spare + 1 - len(rare)] + np.uint64(here + 1)))
            continue
        some = np.sort(heavy[: spare + groups + 1 - len(rare)])
        group = tb.mix(some) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        some, group = some[order], group[order]
        ends = np.searchsorted(group, group, "right")
        after = ends - np.arange(len(some)) - 1
        left = np.repeat(np.arange(len(some)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        found.append(tb.mix(tb.mix(some[left]) + some[right] * np.uint64(3) + np.uint64(here + 1)))
    return rare, np.unique(np.concatenate(found))


def sets_of(docs: DataFrame, wanted: DataFrame, marked: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(cls, body)``: the tokens of the classes ``wanted``, from one text of each."""
    ids = marked.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(id_col).alias("_id")).select("_id").distinct()
    ids = written(ids, "listed")
    listed = F.broadcast(ids) if ids.count() <= LISTED else ids
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(listed, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, tokens in _distinct_sets(batches, 0, k):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([tokens.tobytes()], pa.binary())], ["cls", "body"])

    return written(texts.mapInArrow(tidy(work), "cls long, body binary").dropDuplicates(["cls"]), "sets")


def _allowed(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that two linked sets of these sizes may differ in at most."""
    return (n_a + n_b) * (100 - percent) // (100 + percent)


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sketches allow a link."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = _allowed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            keep = []
            for left, right, limit in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True):
                size = min(len(left), len(right))
                x, y = (folded(np.frombuffer(z, np.uint8)[None], size) for z in (left, right))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidy(work), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose Jaccard similarity reaches the threshold."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("cls").alias(side), F.col("body").alias(f"s_{side}")), side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "s_a", "s_b").mapInArrow(tidy(work), "a long, b long")


def block_pairs(
    cls: np.ndarray, n: np.ndarray, component: np.ndarray, sketches: list[bytes], block: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components (and, where there are two blocks, of both) whose sketches allow a link."""
    size = np.array([len(x) for x in sketches])
    left, right = [], []
    across = block[0] != block[-1] if len(block) else False
    for wide in np.unique(size):
        one = np.flatnonzero(size == wide)
        near = np.flatnonzero((size == wide) | (size == 2 * wide))  # linked sets differ less than twofold in size
        x = np.frombuffer(b"".join(sketches[i] for i in one), np.uint8).reshape(len(one), wide)
        y = np.empty((len(near), wide), np.uint8)
        for length in (wide, 2 * wide):
            mine = np.flatnonzero(size[near] == length)
            if len(mine):
                y[mine] = folded(np.frombuffer(b"".join(sketches[near[i]] for i in mine), np.uint8).reshape(len(mine), length), wide)
        u, v = (np.unpackbits(z, axis=1).astype(np.float32) for z in (x, y))
        differ = u.sum(1)[:, None] + v.sum(1) - 2 * (u @ v.T)
        good = differ <= _allowed(n[one][:, None], n[near], percent)
        good &= component[one][:, None] != component[near]
        good &= (size[near] > wide) | (cls[one][:, None] < cls[near])
        if across:
            good &= block[one][:, None] != block[near]
        a, b = np.nonzero(good)
        left.append(cls[one[a]])
        right.append(cls[near[b]])
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def crossing(members: DataFrame, sketches: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: members (``first, cls, component``) of one centre, in different components, whose sketches allow a link.

    A centre's members are dealt into blocks; a task compares two blocks, or all members where there is one block.
    """
    sizes = members.groupBy("first").agg(F.count("*").alias("many"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = sizes.filter("low <> high").select("first", F.ceil(F.col("many") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "first").join(sketches, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("first", "cls", "n", "component", "sketch", "block", other)
    placed = placed.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    placed = placed.repartition(partitions(members.sparkSession), "first", "i", "j").sortWithinPartitions("first", "i", "j", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(x).to_numpy() for x in ("first", "i", "j")]
            edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], 0)) + 1 if held.num_rows else []
            if len(edge):
                yield from compare(held.slice(0, edge[-1]), [0, *edge[:-1]], edge)
                held = held.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from compare(held, [0], [held.num_rows])

    def compare(table: pa.Table, begins, ends) -> Iterator[pa.RecordBatch]:
        cls, n, component, at = (table.column(x).to_numpy() for x in ("cls", "n", "component", "block"))
        bits = table.column("sketch").to_pylist()
        for p, q in zip(begins, ends, strict=True):
            if (component[p:q] != component[p]).any():
                a, b = block_pairs(cls[p:q], n[p:q], component[p:q], bits[p:q], at[p:q], percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return placed.mapInArrow(tidy(work), "a long, b long").distinct()


def links(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, percent: int, k: int) -> DataFrame:
    """``(a, b)``: links between classes that connect every component of the similarity graph."""
    total = marked.agg(F.sum("n")).collect()[0][0] or 0
    tasks = max(partitions(docs.sparkSession), total * (100 - percent + 5) // 100 // GATHERED)
    shared = signatures(docs, text_col, frequent(docs, text_col, k), percent, k, tasks)
    once = shared.groupBy("first", "size", "members").agg(F.min("sig").alias("sig")).select("sig")
    shared = written(shared.join(once, "sig", "left_semi"), "shared")
    sized = F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * percent
    stars = shared.filter((F.col("cls") != F.col("first")) & sized).select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    sketches = marked.select("cls", "n", "sketch").join(shared.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    sketches = written(sketches, "sketches")
    stars = written(possible(stars, sketches, percent), "stars")
    near = written(_exact(stars, docs, marked, id_col, text_col, percent, k), "links")
    # What is not connected by now: members of one signature that are in different components.
    place = components(near).withColumnRenamed("node", "cls")
    placed = shared.filter("size > 2").join(place, "cls", "left").select("sig", "first", "cls", F.coalesce("component", "cls").alias("component"))
    mixed = placed.filter("cls <> first").groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    members = placed.join(mixed.filter("low <> high").select("sig"), "sig", "left_semi").filter("cls <> first").select("first", "cls", "component").distinct()
    rest = written(crossing(written(members, "members"), sketches, percent), "crossing")
    return near.union(_exact(rest, docs, marked, id_col, text_col, percent, k))


def _exact(pairs: DataFrame, docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, percent: int, k: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    return verified(pairs, sets_of(docs, wanted, marked, id_col, text_col, k), percent)


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Per row id, ``n`` and ``_c``, the class that stands for its component (null for an empty set); and ``(_c, _first)``, the
    smallest id of each component."""
    marked = written(classes(docs, id_col, text_col, k), "classes")
    place = components(links(docs, marked, id_col, text_col, percent, k))
    placed = marked.drop("sketch").join(place.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.withColumn("_c", F.coalesce("component", "cls")).drop("component")
    return placed, placed.filter("_c is not null").groupBy("_c").agg(F.min(id_col).alias("_first"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` and ``component_id``.

    Words are runs without white space, ``A-Z`` in lower case. A text of fewer than ``k`` words is one shingle; a null
    text or one without words has none and is its own component. Rows with equal sets are linked. ``component_id`` is
    the smallest id that links reach; null ids do not count unless there are no others. An empty table stays empty.
    Texts are read whole, in blocks, however long; columns other than the two are not read.
    """
    placed, smallest = _placed(docs, id_col, text_col, percent, k)
    return placed.join(smallest, "_c", "left").select(
        id_col, F.col("n").alias("n_shingles"), F.when(F.col("_c").isNull(), F.col(id_col)).otherwise(F.col("_first")).alias("component_id")
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group: that with the group's smallest id.

    An id may stand on several rows, with one text or others: a row goes by its own text, never by its namesake's. Rows
    without an id belong to groups like others; a group without any id keeps one row. Rows without words are no copies of
    others, and those that repeat an id and a text count once. Of several rows that could stand for a group the one whose
    text is first in order stays. An empty table stays empty; further columns of any name and kind pass through.
    """
    placed, _ = _placed(docs, id_col, text_col, percent, k)
    placed = placed.select(F.col(id_col).alias("id"), "cls", "_c")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cls"))
    chosen = placed.filter("_c is not null").groupBy("_c").agg(best.alias("best")).select("best.id", "best.cls")
    wordless = placed.filter("_c is null and id is not null").select("id", "cls").distinct()
    many = written(placed.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "namesakes")
    listed = _listed(many)
    chosen = written(chosen.union(wordless), "chosen")
    once = chosen.filter("id is not null").join(listed, "id", "left_anti").select("id").distinct()
    plain = docs.join(_listed(written(once, "once")).withColumnRenamed("id", "_near_id"), F.col(id_col) == F.col("_near_id"), "left_semi")
    rest = docs.join(listed.withColumnRenamed("id", "_near_id"), F.col(id_col) == F.col("_near_id"), "left_semi").union(docs.filter(F.col(id_col).isNull()))
    rest = written(_with_class(rest, id_col, text_col, k), "repeated")
    empty = rest.filter("cls is null").groupBy("id", "text").agg(F.any_value("row").alias("row"))
    worded = rest.filter("cls is not null").groupBy("id", "cls").agg(F.min_by("row", "text").alias("row"))
    stay = chosen.filter("cls is not null").withColumnsRenamed({"id": "_id", "cls": "_cls"})
    worded = worded.join(stay, (F.col("cls") == F.col("_cls")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return plain.union(empty.select("row.*")).union(worded.select("row.*"))


def _listed(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= LISTED else ids


def _with_class(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(id, text, cls, row)``: id, text and set id of each row, and all of it as a struct."""
    row = F.struct(*docs.columns).alias("row")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), row)
    kind = T.StructType([*base.schema, T.StructField("cls", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_id(x) if len(x) else None for _, x in text_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], kind.names)

    return base.mapInArrow(tidy(work), kind).select("id", "text", "cls", "row")
