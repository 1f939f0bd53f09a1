"""Byte-level BPE encoding and decoding with published merge ranks.

A segment tree over the byte positions of a piece keeps, per node, the leftmost smallest rank of a pair that may merge.
The root names the next merge; a merge touches three leaves (its own, the one before and the one it swallows), so it
costs a logarithmic number of node updates however long the piece is. Many pieces of like length are worked on at once,
one tree per row of an array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = np.int64(1) << 60
CACHE = 300_000  # pieces a task remembers; more only cost time, as a forgotten piece is merged again


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merger:
    """Merges pieces by rank. ``ranks`` must hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        pairs = {
            ranks[left] * self.width + ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token))
            if (left := token[:i]) in ranks and token[i:] in ranks
        }
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[x] for x in self.pairs.tolist()], np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.bytes_rank = self.pair_rank(np.repeat(self.single, 256), np.tile(self.single, 256))  # of any two bytes

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of the token that two neighbours form, ``NEVER`` where they form none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NEVER)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece, as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                found[i] = rank.to_bytes(4, "little")
            elif piece:
                by_size.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for bits, which in by_size.items():
            step = max(1, (1 << 18) >> bits)  # trees that are held at once
            for begin in range(0, len(which), step):
                some = which[begin : begin + step]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], 1 << bits), strict=True):
                    found[i] = ids
        return found

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        n, wide = len(pieces), size + 1
        length = np.array([len(x) for x in pieces])
        inside = np.arange(size) < length[:, None]
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        tokens = np.full((n, wide), -1, np.int64)  # the id that begins at a position, -1: none
        tokens[:, :size][inside] = self.single[raw]
        # A node holds rank * size + position, so that the smaller is the lower rank and then the one further left.
        empty = NEVER
        first = np.empty(len(raw), np.int64)
        first[:-1] = self.bytes_rank[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        first[np.cumsum(length) - 1] = NEVER
        place = np.broadcast_to(np.arange(size), (n, size))[inside]
        trees = np.full((n, 2 * size), empty, np.int64)
        trees[:, size:][inside] = np.where(first < NEVER, first * size + place, empty)
        width = size
        while width > 1:
            half = trees[:, width : 2 * width]
            np.minimum(half[:, ::2], half[:, 1::2], out=trees[:, width // 2 : width])
            width //= 2
        token, tree = tokens.ravel(), trees.ravel()
        after = np.tile(np.arange(1, wide + 1), n)  # the position of the next token
        before = np.tile(np.arange(-1, size), n)
        root = np.arange(n) * (2 * size) + 1
        row = np.arange(n) * wide
        live = np.flatnonzero(tree[root] < empty)
        while len(live):
            top, base = root[live] - 1, row[live]
            best = tree[top + 1]
            made = best // size
            at = best - made * size
            gone = after[base + at]
            follow = np.minimum(after[base + gone], size)
            token[base + at] = made
            token[base + gone] = -1
            after[base + at] = follow
            before[base + follow] = at
            # the swallowed token's pair, the pair that begins here, and the one that ends here
            tree[top + gone + size] = empty
            self._rise(tree, top, gone, size)
            right = self.pair_rank(made, token[base + follow])
            tree[top + at + size] = np.where(right < NEVER, right * size + at, empty)
            prior = before[base + at]
            has = np.flatnonzero(prior >= 0)
            p, b, t = prior[has], base[has], top[has]
            left = self.pair_rank(token[b + p], made[has])
            tree[t + p + size] = np.where(left < NEVER, left * size + p, empty)
            self._rise(tree, t, p, size)
            self._rise(tree, top, at, size)
            live = live[tree[top + 1] < empty]
        kept = token >= 0
        ids = token[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.reshape(n, wide).sum(1)) * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _rise(tree: np.ndarray, top: np.ndarray, leaf: np.ndarray, size: int) -> None:
        """Take the smaller of two children from a leaf's parent up to the root."""
        node = leaf + size
        while size > 1:
            node = node >> 1
            size >>= 1
            child = top + 2 * node
            tree[top + node] = np.minimum(tree[child], tree[child + 1])


class Encoder:
    """Ids of whole texts. Remembers the ids of pieces; a full memory is emptied."""

    def __init__(self, merger: Merger, pattern: str):
        self.merger, self.split = merger, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.split(text or "") for text in texts]
        fresh = list(set().union(*split).difference(self.known))
        self.known.update(zip(fresh, self.merger.encode([x.encode() for x in fresh]), strict=True))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id column, ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``.

    Each match of ``pattern`` is merged by itself; special tokens are plain text. A null or empty text has no ids.
    Other columns are not read, so their names cannot clash. Rows are independent: repeated rows and ids stay.
    """
    kind = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merger(ranks), pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                ids = encoder(part.column(1).to_pylist())
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), counts], [id_col, "ids", "n_tokens"])
        pa.default_memory_pool().release_unused()  # the worker may wait for its next task for long

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(work, kind)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids. Null ids are no bytes; an unknown id is an error."""
    kept = [c for c in encoded.columns if c != "decoded"]
    kind = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    place = kept.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: text for text, rank in ranks.items()}.__getitem__
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*kept, "decoded"])
        pa.default_memory_pool().release_unused()

    return encoded.select(*kept).mapInArrow(work, kind)
