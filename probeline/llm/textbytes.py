"""Whole blocks of texts as numpy byte arrays: words, word hashes and word shingles without a Python object per word.

Words are runs of bytes other than ``0x20`` and ``0x09-0x0D``; those bytes never occur inside a multi-byte UTF-8
character, so bytes and characters give the same words. Hashes ignore the case of ``A-Z``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19  # bytes of text that are worked on at once; a longer text is a block of its own
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def white() -> np.ndarray:
    found = np.zeros(256, bool)
    found[[0x20, *range(0x09, 0x0E)]] = True
    return found


@functools.cache
def byte_values() -> np.ndarray:
    """A random number per byte, 0 for white space, equal for both cases of a letter."""
    found = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    found[ord("A") : ord("Z") + 1] = found[ord("a") : ord("z") + 1]
    found[white()] = 0
    return found


@functools.cache
def exact_values() -> np.ndarray:
    """A random number per byte, another for each."""
    return np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def sums(data: np.ndarray) -> np.ndarray:
    """Running hash sums (``n + 1``) of which ``stretch`` makes the hashes of stretches of bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(exact_values()[data] * powers(len(data))[: len(data)], out=total[1:])
    return total


def stretch(total: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each of ``start``; equal for equal bytes wherever they stand."""
    return mix((total[start + size] - total[start]) * powers(len(total), True)[start])


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """At least ``n`` powers of the base (or of its inverse) modulo 2**64."""
    return _powers(max(20, int(n).bit_length()), inverse)


@functools.lru_cache(maxsize=4)
def _powers(bits: int, inverse: bool) -> np.ndarray:
    found = np.full(1 << bits, _INVERSE if inverse else BASE, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their ``n + 1`` offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of whole texts of about ``size`` bytes."""
    data, at = utf8(texts)
    begin, n = 0, len(at) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield begin, data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (``n + 1`` numbers)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~white()[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~inside))
    return start, end, np.searchsorted(start, at)


@functools.cache
def plain_values() -> np.ndarray:
    """As ``byte_values``, but ASCII punctuation counts nothing, so ``word.`` hashes like ``word``."""
    found = byte_values().copy()
    found[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = 0
    return found


def word_hashes(data: np.ndarray, start: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; white space counts nothing, so a sum up to the next word is the word's own."""
    if not len(start):
        return np.empty(0, np.uint64)
    terms = (byte_values() if values is None else values)[data] * powers(len(data))[: len(data)]
    return mix(np.add.reduceat(terms, start) * powers(len(data), True)[start])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and the first of each text; a shorter text is one shingle, an empty one none."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.diff(first)
    many = np.maximum(count - k + 1, (count > 0).astype(count.dtype))
    base = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(base[-1]) + np.repeat(first[:-1] - base[:-1], many)
    size = np.repeat(np.minimum(count, k), many)
    total = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        here = np.where(j < size, hashes[np.minimum(at + j, max(len(hashes) - 1, 0))], np.uint64(0)) if len(at) else total
        total = total + here * factors[j]
    return mix(total), base
