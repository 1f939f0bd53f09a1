"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language by rank. A text's own most frequent n-grams are ranked likewise;
its distance to a language is the sum, over its n-grams, of how far each is out of place in that profile (an absent one
counts the most). The nearest language wins. Texts are lower-cased, every run of other characters than letters is one
blank, and words are padded with blanks, so profiles also hold how words begin and end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.llm.tables import sample_bar

SIZES = (1, 2, 3)
RANKS = 400  # n-grams of a language's profile
OWN = 300  # n-grams of a text that are compared
FITTED = 8_000  # texts that profiles are fitted on at most, about; shared out evenly among languages
POINTS = 1 << 18  # code points that are worked on at once
BLANK = 0x20
COMMON = 0x3000  # code points below are looked up in a table
UNKNOWN = "und"


def letter(point: int) -> int:
    """The lower-case letter of a code point (the first if it becomes several), a blank for what is no letter."""
    low = chr(point).lower()[:1]
    return ord(low) if chr(point).isalpha() and low.isalpha() else BLANK


@cache
def common_letters() -> np.ndarray:
    return np.array([letter(x) for x in range(COMMON)], np.uint32)


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, letters and single blanks, each text within blanks; offsets (``n + 1``)."""
    parts = [np.frombuffer(f" {x or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    at = np.cumsum([0, *map(len, parts)])
    points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    found = common_letters()[np.minimum(points, COMMON - 1)]
    far = np.flatnonzero(points >= COMMON)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        found[far] = np.array([letter(x) for x in kinds.tolist()], np.uint32)[which]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != BLANK) | (found[:-1] != BLANK)
    keep[at[:-1]] = True
    return found[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a folded text (packed 21 bits a letter) and their counts; a blank alone is none."""
    grams = []
    code = points.astype(np.int64) + 1  # so that a shorter n-gram differs from a longer one
    for size in SIZES:
        if len(code) >= size:
            packed = code[: len(code) - size + 1]
            for j in range(1, size):
                packed = (packed << 21) | code[j : len(code) - size + 1 + j]
            grams.append(packed)
    found = np.sort(np.concatenate(grams)) if grams else np.empty(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.empty(0, np.int64)
    gram, count = found[edge], np.diff(np.append(edge, len(found)))
    keep = gram != BLANK + 1
    return gram[keep], count[keep]


def top(gram: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order of rank; equal counts go by n-gram."""
    return gram[np.lexsort((gram, -count))[:most]]


def each_text(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, n-grams and counts of every text."""
    held, begin, size = [], 0, 0
    for i, text in enumerate([*texts.to_pylist(), ...]):
        if text is ... or size + len(text or "") > POINTS:
            points, at = folded(held)
            for j in range(len(held)):
                yield begin + j, *counted(points[at[j] : at[j + 1]])
            held, begin, size = [], i, 0
        if text is not ...:
            held.append(text)
            size += len(text or "")


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fitted: int = FITTED) -> dict[str, np.ndarray]:
    """Per language its ranked n-grams, from rows with a language and a text; what is collected is one profile each.

    Fits on about ``fitted`` texts at most, or a text of each language if those are more: each language gives an even
    share, picked by a hash of its texts. Only a language without letters in its texts has no profile; without labelled
    rows there is none at all.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    print_ = F.xxhash64("text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(print_).alias("least")).collect()
    if not sizes:
        return {}
    share = fitted / len(sizes)
    # The text with the smallest hash is in any sample.
    bars = rows.sparkSession.createDataFrame([(r["lang"], max(sample_bar(share / r["n"]), r["least"])) for r in sizes], "lang string, bar long")
    picked = rows.join(F.broadcast(bars), "lang").filter(print_ <= F.col("bar")).select("lang", "text")  # a row per language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, total = batch.column(0).to_pylist(), {}
            for i, gram, n in each_text(batch.column(1)):
                total.setdefault(langs[i], []).append((gram, n))
            for lang, parts in total.items():
                gram, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in parts]), len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    summed = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RANKS).toArrow().to_pandas()
    return {lang: some.sort_values("rank")["gram"].to_numpy() for lang, some in best.groupby("lang")}


class Ranker:
    """Compares texts with all profiles at once; only the ranks that profiles hold are kept, so thousands of them fit."""

    def __init__(self, known: dict[str, np.ndarray]):
        self.langs = sorted(known)
        sizes = [len(known[x]) for x in self.langs]
        grams = np.concatenate([*(known[x] for x in self.langs), np.empty(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.grams, begin = np.unique(grams[order], return_index=True)
        self.begin = np.append(begin, len(grams))  # where the entries of an n-gram begin: a language and a rank each
        self.columns = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.ranks = np.concatenate([*(np.arange(n, dtype=np.int32) for n in sizes), np.empty(0, np.int32)])[order]

    def __call__(self, gram: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        """Nearest language (the first by name of equals) and 1 less its share of the greatest distance."""
        if not len(gram) or not self.langs:
            return UNKNOWN, 0.0
        own = top(gram, count, OWN)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == own)
        first, n = self.begin[at[place]], self.begin[at[place] + 1] - self.begin[at[place]]
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        closer = RANKS - np.abs(self.ranks[entry] - np.repeat(place, n))  # than an absent n-gram
        total = RANKS * len(own) - np.bincount(self.columns[entry], closer, len(self.langs)).astype(np.int64)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (RANKS * len(own)))


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred`` and ``score`` (0 to 1). Every whole text is read.

    ``und`` with score 0 where the text is null or has no letter, or where there are no profiles. Other columns are not
    read, so their names cannot clash.
    """
    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(known)
        for batch in batches:
            found = [rank(gram, count) for _, gram, count in each_text(batch.column(1))]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(work, kind)
