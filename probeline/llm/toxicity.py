"""Toxicity by a convolutional text classifier that numpy trains and Spark tasks apply.

Words (without punctuation) and their beginnings are hashed to buckets; buckets that several learned texts hold, of all or
of one label in one language, have a row in an embedding table, all others share an empty one, so that a model remembers
no single text and still knows the rare words of a small language. A word is the sum of its rows, so words that were never
seen share what is known of their beginnings. Filters of several widths slide over a text, each keeps its largest
response (whole texts, however long), and a logistic layer weighs those. A second, linear reading of the same hashed
words tells the language of a text, and the logit at which a text counts as toxic is calibrated per language found, on
logits of texts that the scoring model has not seen, so that 0.5 is the threshold of the final score everywhere.

All labelled texts are learned from. Up to a few thousand are one task's work. Beyond that they are dealt to parts of bounded
size: buckets and the words of languages are counted by a Spark aggregation, parts train at the same time from common weights
in rounds, after each of which a row of weights moves by the mean of the parts that changed it, and thresholds are read
from counts of all logits.
"""

from __future__ import annotations

import copy
import functools
import pickle
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeline.llm import textbytes as tb
from probeline.llm.tables import cut, hand_back, tidy

BUCKETS = 1 << 22
ROWS = 1 << 16  # buckets with a row at most, those in the largest share of a language's texts of a label; row 0 stands for all others and what follows a text
COMMON = 3  # learned texts of one label in one language that a bucket with a row is in at least, or
SPREAD = 8  # texts of any, and
SHARE = 0.004  # the share of all
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8  # per width
BYTES = 1 << 26  # of texts that a task learns from in a round, about, and
FITTED = 6_000  # labelled texts up to which one task learns from all of them; beyond that they are dealt to parts
PART = 4  # times as many texts that a part has at most
HELD = 1 << 23  # bytes of texts, about, whose words a task of a part holds at once
ROUNDS = 2  # in which parts train from common weights, at least
LISTED = 1 << 20  # ids of labels that are broadcast at most
PIECE = 1 << 10  # rows of weights that are merged at once
FINE = 256  # parts of a logit that thresholds of dealt texts are read to
FAR = 64  # logits beyond count as this one there
LANGUAGES = 64  # languages with the most learned texts, told apart for thresholds
LEAST = 20  # texts of a language's rarer label at which its own threshold and the common one count alike
FOLDS = 2  # that thresholds are read across
BEGINS = (4, 5, 7)  # bytes of the beginnings of a word that have buckets of their own
PARTS = 1 + len(BEGINS)
RIDGE = 1e-4  # pull of embeddings towards 0
PAD = max(WIDTHS) - 1


def padded(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, buckets of each word (itself and its beginnings) and offsets of blocks of texts; every text is followed
    by ``PAD`` empty words (-1)."""
    for row, data, at in tb.blocks(texts):
        start, end, first = tb.words(data, at)
        found = np.full((len(start) + PAD * (len(at) - 1), PARTS), -1, np.int64)
        place = np.arange(len(start)) + np.repeat(np.arange(len(at) - 1) * PAD, np.diff(first))
        terms = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tb.plain_values()[data] * tb.powers(len(data))[: len(data)], out=terms[1:])
        for part, size in enumerate((len(data), *BEGINS)):
            hashes = tb.mix((terms[np.minimum(start + size, end)] - terms[start]) * tb.powers(len(data), True)[start] + np.uint64(part))
            found[place, part] = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        yield row, found, first + np.arange(len(at)) * PAD


def past(at: np.ndarray) -> np.ndarray:
    """Places of the empty words, where a filter would reach into the next text."""
    return (at[1:, None] - np.arange(1, PAD + 1)).ravel()


def known_buckets(kinds: np.ndarray, texts: Sequence[np.ndarray], groups: Sequence) -> np.ndarray:
    """The buckets with a row in the embedding table (from 1 on), in order.

    ``kinds`` has the buckets of each distinct word, ``texts`` the numbers of their words, ``groups`` the language and the
    label of each text.
    """
    names, place = np.unique(kinds, return_inverse=True)
    place = place.reshape(kinds.shape).astype(np.int32)
    count, most, share = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32), np.zeros(len(names), np.float32)
    for group in dict.fromkeys(groups):
        held, size = np.zeros(len(names), np.int32), 0
        for words, own in zip(texts, groups, strict=True):
            if own == group:
                held[np.unique(place[np.unique(words)])] += 1
                size += 1
        count += held
        most = np.maximum(most, held)
        share = np.maximum(share, (held / size).astype(np.float32))
    common = np.flatnonzero(((most >= COMMON) | (count >= max(SPREAD, SHARE * len(texts)))) & (names >= 0))
    return np.sort(names[common[np.lexsort((common, -share[common]))[: ROWS - 1]]])


@dataclass
class Model:
    """Weights of the classifier, the language reading and the thresholds (logits) per language; the last is for all others
    and for texts without a word that the reading knows."""

    buckets: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width, SIZE, FILTERS)
    weights: np.ndarray
    bias: float
    languages: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, 1), np.float32))
    limits: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @functools.cached_property
    def rows(self) -> np.ndarray:
        """Row of the table per bucket, 0 for those without one and for -1, at the end."""
        found = np.zeros(BUCKETS + 1, np.uint16)
        found[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # made anew where it is used

    def prepared(self) -> list[list[np.ndarray]]:
        return [[self.table @ part for part in kernel] for kernel in self.filters]

    def logits(self, words: np.ndarray, at: np.ndarray, ready: list[list[np.ndarray]]) -> np.ndarray:
        tail = np.concatenate([words, np.zeros((PAD, PARTS), words.dtype)])
        best = []
        for parts in ready:
            here = np.zeros((len(words), FILTERS), parts[0].dtype)
            for j in range(len(parts)):
                for part in range(PARTS):
                    here += parts[j][tail[j : j + len(words), part]]
            here[past(at)] = 0
            best.append(np.maximum.reduceat(here, at[:-1], axis=0))
        return np.maximum(np.concatenate(best, 1), 0) @ self.weights + self.bias

    def spoken(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(self.languages[words[:, 0]], at[:-1], axis=0)
        return np.where(total.any(1), total.argmax(1), len(self.limits) - 1)

    def scores(self, texts: pa.Array, ready: list[list[np.ndarray]]) -> np.ndarray:
        found = np.zeros(len(texts))
        for row, buckets, at in padded(texts):
            words = self.rows[buckets].astype(np.int64)
            rise = self.logits(words, at, ready) - self.limits[self.spoken(words, at)]
            found[row : row + len(rise)] = 1 / (1 + np.exp(-np.clip(rise, -30, 30)))
        return found


@dataclass
class Sample:
    """Learned texts as numbers of distinct words; ``kinds`` has the buckets of each distinct word."""

    kinds: np.ndarray
    texts: list[np.ndarray]
    toxic: np.ndarray
    langs: Sequence[str | None]
    folds: np.ndarray


def sample(batches: Iterator[pa.RecordBatch], most: int) -> Sample:
    """The first of ``samples``."""
    return next(samples(batches, most), None) or _sample([], [], [], [])


def samples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Sample]:
    """Texts, labels, languages and folds (columns ``text``, ``mark``, ``lang`` and, if any, ``fold``), whenever their texts
    have ``most`` bytes. Of the words, only numbers and the buckets of distinct ones are held."""
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    toxic, langs, folds, size = [], [], [], 0
    factors = np.arange(PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(tb.BASE)
    for batch in batches:
        for row, words, at in padded(batch.column(0)):
            name = tb.mix((words.astype(np.uint64) * factors).sum(1, dtype=np.uint64))
            distinct, place, which = np.unique(name, return_index=True, return_inverse=True)
            blocks.append((distinct, words[place].astype(np.int32), which.astype(np.int32), at))
            some = batch.slice(row, len(at) - 1)
            toxic += some.column(1).to_pylist()
            langs += some.column(2).to_pylist()
            folds += some.column(3).to_pylist() if batch.num_columns > 3 else [0] * len(some)
            size += sum(x or 0 for x in pc.binary_length(some.column(0)).to_pylist())
            if size >= most:
                yield _sample(blocks, toxic, langs, folds)
                blocks, toxic, langs, folds, size = [], [], [], [], 0
    if toxic:
        yield _sample(blocks, toxic, langs, folds)


def _sample(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], toxic: list, langs: list, folds: list) -> Sample:
    distinct, place = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[0] for x in blocks)]), return_index=True)
    texts = []
    for name, _, which, at in blocks:
        words = np.searchsorted(distinct, name).astype(np.int32)[which]
        texts += [words[at[i] : at[i + 1]] for i in range(len(at) - 1)]
    kinds = np.concatenate([np.empty((0, PARTS), np.int32), *(x[1] for x in blocks)])[place]
    return Sample(kinds, texts, np.array(toxic, np.float64), langs, np.array(folds, np.int64))


def fit(texts: list[str | None], toxic: Sequence[int], langs: Sequence[str | None], epochs: int = 5, seed: int = 7) -> Model:
    """``fitted`` of plain lists."""
    columns = [pa.array(texts, pa.string()), pa.array(toxic, pa.int32()), pa.array(langs, pa.string())]
    return fitted(sample(iter([pa.RecordBatch.from_arrays(columns, ["text", "mark", "lang"])]), BYTES), epochs, seed)


def fitted(known: Sample, epochs: int = 5, seed: int = 7) -> Model:
    """Train on all texts and calibrate on the logits that models of the other folds give each of them. Without both labels
    every score is that of the only one, without any 0."""
    model = _fitted(known, np.arange(len(known.texts)), epochs, seed)
    if not model.weights.any():
        return _float32(model)
    _languages(model, known)
    logit = np.zeros(len(known.texts))
    folds = np.random.default_rng(seed).permutation(len(known.texts)) % FOLDS
    for fold in range(FOLDS):
        other = _fitted(known, np.flatnonzero(folds != fold), epochs, seed)
        ready, rows = other.prepared(), other.rows[known.kinds]
        for some in _runs(np.flatnonzero(folds == fold)):
            logit[some] = other.logits(*_joined(known, some, rows), ready)
    _calibrate(model, _spoken(model, known), logit, known.toxic, 1 - known.toxic)
    return _float32(model)


def _runs(chosen: np.ndarray, size: int = 128) -> Iterator[np.ndarray]:
    return (chosen[begin : begin + size] for begin in range(0, len(chosen), size))


def _joined(known: Sample, some: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts (or what ``rows`` has for them) and the offsets of the texts."""
    words = np.concatenate([known.texts[i] for i in some])
    return words if rows is None else rows[words].astype(np.int64), np.cumsum([0, *(len(known.texts[i]) for i in some)])


def _fitted(known: Sample, used: np.ndarray, epochs: int, seed: int) -> Model:
    """A model of the texts ``used``; its weights are 0 if they do not have both labels."""
    rng = np.random.default_rng(seed)
    buckets = known_buckets(known.kinds, [known.texts[i] for i in used], [(known.langs[i], known.toxic[i]) for i in used])
    model = _begun(buckets, len(used), known.toxic[used].sum(), rng)
    if model.weights.any():
        _train(model, _unmoved(model), known, used, epochs, known.toxic[used].mean(), rng)
    return model


def _begun(buckets: np.ndarray, n: int, toxic: float, rng) -> Model:
    """Weights before ``n`` texts are learned; they are 0, and stay so, if not both labels are among those."""
    table = rng.normal(0, 0.01, (len(buckets) + 1, SIZE)).astype(np.float32)
    table[0] = 0
    model = Model(buckets, table, [rng.normal(0, 0.25, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0)
    if not 0 < toxic < n:
        model.weights[:], model.bias = 0, 30.0 if n and toxic > n / 2 else -30.0
    return model


@dataclass
class Steps:
    """Sums of squared steps of the weights of a model, by which Adagrad shortens further steps."""

    table: np.ndarray
    filters: list[np.ndarray]
    weights: np.ndarray
    bias: float


def _unmoved(model: Model) -> Steps:
    return Steps(np.full(model.table.shape, 1e-8, np.float32), [np.full(x.shape, 1e-8) for x in model.filters], np.full(model.weights.shape, 1e-8), 1e-8)


def _train(model: Model, seen: Steps, known: Sample, used: np.ndarray, epochs: int, share: float, rng, rate: float = 0.06) -> None:
    """Logistic loss by Adagrad, where ``share`` of all texts are toxic; only the word windows that gave a filter its largest
    response are changed."""
    rows = model.rows[known.kinds].astype(np.int64)
    weigh = np.where(known.toxic > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for batch in _runs(rng.permutation(used), 32):
            words, at = _joined(known, batch)
            kinds, which = np.unique(words, return_inverse=True)
            own = rows[kinds]
            vectors = np.concatenate([sum(np.take(model.table, own[:, part], 0) for part in range(PARTS)), np.zeros((1, SIZE), np.float32)])
            tail = np.concatenate([which, np.full(PAD, len(kinds))])
            best, spots = [], []
            for kernel in model.filters:
                here = np.take(vectors @ kernel[0], tail[: len(words)], 0)
                for j in range(1, len(kernel)):
                    here += np.take(vectors @ kernel[j], tail[j : j + len(words)], 0)
                here[past(at)] = 0
                spot = np.stack([at[i] + here[at[i] : at[i + 1]].argmax(0) for i in range(len(batch))])
                spots.append(spot)
                best.append(np.take_along_axis(here, spot, 0))
            pooled = np.maximum(np.concatenate(best, 1), 0)
            logit = pooled @ model.weights + model.bias
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - known.toxic[batch]) * weigh[batch] / len(batch)
            step_weights = pooled.T @ error
            back = error[:, None] * model.weights * (pooled > 0)
            changes: list[tuple[np.ndarray, np.ndarray]] = []
            for n, kernel in enumerate(model.filters):
                mine = back[:, n * FILTERS : (n + 1) * FILTERS]
                step = np.empty_like(kernel)
                for j in range(len(kernel)):
                    word = tail[spots[n] + j]
                    step[j] = np.einsum("df,dfs->sf", mine, vectors[word])
                    changes.append((word.ravel(), (mine[:, :, None] * kernel[j].T).reshape(-1, SIZE)))
                seen.filters[n] += step**2
                kernel -= rate * step / np.sqrt(seen.filters[n])
            word = np.concatenate([x for x, _ in changes])
            moved = np.concatenate([x for _, x in changes])[word < len(kinds)].astype(np.float32)
            row = own[word[word < len(kinds)]]
            touched, place = np.unique(row, return_inverse=True)
            place = place.reshape(row.shape)
            step = np.zeros((len(touched), SIZE), np.float32)
            for part in range(PARTS):
                np.add.at(step, place[:, part], moved)
            step += RIDGE * model.table[touched]
            step[touched == 0] = 0
            seen.table[touched] += step**2
            model.table[touched] -= rate * step / np.sqrt(seen.table[touched])
            seen.weights += step_weights**2
            model.weights -= rate * step_weights / np.sqrt(seen.weights)
            seen.bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(seen.bias)


def _languages(model: Model, known: Sample) -> None:
    """Log frequencies of hashed words per language; a text's language is the one with the largest sum. Languages beyond
    the ``LANGUAGES`` largest are read as one more, which has the common threshold."""
    sizes = Counter(x for x in known.langs if x is not None)
    largest = sorted(sizes, key=lambda x: (-sizes[x], x))
    kinds = sorted(largest[:LANGUAGES]) or [None]
    parts = [{x} for x in kinds] + [set(largest[LANGUAGES:])] * (len(largest) > LANGUAGES)
    count = np.zeros((len(model.table), len(parts)))
    rows = model.rows[known.kinds[:, 0]]
    for column, part in enumerate(parts):
        for words, lang in zip(known.texts, known.langs, strict=True):
            if lang in part:
                np.add.at(count[:, column], rows[words], 1)
    _read(model, count, len(kinds))


def _read(model: Model, count: np.ndarray, kinds: int) -> None:
    """Set the language reading by counts of words per row of the table and language, of which ``kinds`` have thresholds."""
    model.limits = np.zeros(kinds + 1)
    model.languages = np.log((count + 0.1) / (count[1:] + 0.1).sum(0)).astype(np.float32)
    model.languages[0] = 0


def _best_limit(logit: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit that errs least, where so many toxic and clean texts have each; the middle of the widest such gap."""
    order = np.argsort(logit)
    logit, toxic, clean = logit[order], toxic[order], clean[order]
    missed = np.concatenate([[0], np.cumsum(toxic)])
    wrong = np.concatenate([[clean.sum()], clean.sum() - np.cumsum(clean)])
    edges = np.concatenate([[logit[0] - 1], logit, [logit[-1] + 1]])
    gap = np.diff(edges)
    error = np.where(gap > 0, missed + wrong, np.inf)
    good = np.flatnonzero(error <= error.min() + 1e-12)
    pick = good[gap[good].argmax()]
    return float((edges[pick] + edges[pick + 1]) / 2)


def _spoken(model: Model, known: Sample) -> np.ndarray:
    rows = model.rows[known.kinds]
    return np.concatenate([model.spoken(*_joined(known, some, rows)) for some in _runs(np.arange(len(known.texts)))])


def _calibrate(model: Model, spoken: np.ndarray, logit: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
    """Limits from logits of texts that the scoring model had not learned, of which so many toxic and clean ones have each in
    a language. A language's own is drawn towards the common one the fewer toxic texts it has."""
    common = _best_limit(logit, toxic, clean)
    model.limits = np.full(len(model.limits), common)
    for lang in range(len(model.limits) - 1):
        mine = spoken == lang
        few = min(toxic[mine].sum(), clean[mine].sum())
        if few > 0:
            model.limits[lang] += (_best_limit(logit[mine], toxic[mine], clean[mine]) - common) * few / (few + LEAST)


def _float32(model: Model) -> Model:
    model.table = model.table.astype(np.float32)
    model.filters = [x.astype(np.float32) for x in model.filters]
    model.weights = model.weights.astype(np.float32)
    return model


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "toxic", rows: int = FITTED, most: int = BYTES,
) -> Model:
    """Fit on all labelled rows; labels other than 0 and 1 are left out. Up to ``rows`` rows with ``most`` bytes of text are
    trained on in one task, more are dealt to parts of ``PART`` times as many rows, or of as many bytes, at most. The driver
    gets weights and counts alone.

    The language is what the language reading learns to tell, never an input of a score. An id with several labels
    counts as toxic if any says so.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("mark"))
    few = marks.limit(LISTED + 1).count() <= LISTED
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    got = texts.join(F.broadcast(marks) if few else marks, F.col("_doc") == F.col("_id")).select(
        "text", "mark", "lang", F.pmod(F.xxhash64("_id", "text", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"),
        F.xxhash64("_id", F.lit("order")).alias("h"))
    n, size = got.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = max(rows, 32)
    if n > rows or size > most:
        parts = max(ceil(n / (PART * rows)), ceil(size / most))
        return _learn_in_parts(cut(got.repartition(parts).sortWithinPartitions("h", "text").drop("h")), n, parts, rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fitted(sample(batches, most + 1)).__getstate__()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["model"])

    found = got.repartition(1).sortWithinPartitions("h", "text").drop("fold").mapInArrow(tidy(work), "model binary").collect()
    return Model(**pickle.loads(found[0]["model"])) if found else fitted(sample(iter(()), most))


def _learn_in_parts(dealt: DataFrame, n: int, parts: int, rows: int, epochs: int = 5, seed: int = 7) -> Model:
    """``fitted`` of the texts of all partitions (columns ``text``, ``mark``, ``lang``, ``fold``), which train at the same time.
    A part takes as many steps as one of ``rows`` texts would in ``epochs`` rounds, in ``ROUNDS`` to ``epochs`` rounds."""
    spark = dealt.sparkSession
    sizes = cut(dealt.groupBy("lang").agg(*[
        F.count(F.when((F.col("mark") == mark) & (F.col("fold") == fold), 1)).alias(f"s{mark}{fold}") for mark in (0, 1) for fold in range(FOLDS)]))
    total = sizes.agg(*[F.sum(c).alias(c) for c in sizes.columns[1:]]).first()
    held = cut(_held(dealt))
    models = []
    for other in (None, *range(FOLDS)):  # one of all texts, one without each fold
        folds = [x for x in range(FOLDS) if x != other]
        clean, toxic = (sum(total[f"s{mark}{fold}"] for fold in folds) for mark in (0, 1))
        buckets = _known_of(held, sizes, folds, clean + toxic)
        model = _begun(buckets, clean + toxic, toxic, np.random.default_rng(seed))
        models.append((other, model, _unmoved(model), toxic / max(clean + toxic, 1)))
    scoring = models[0][1]
    if not scoring.weights.any():
        return _float32(scoring)
    for turn in range(min(epochs, max(ROUNDS, ceil(epochs * rows * parts / n)))):
        shared = spark.sparkContext.broadcast(models)
        for (_, model, seen, _), change in zip(models, _round(dealt, shared, turn, seed), strict=True):
            _move(model, seen, change)
        shared.destroy()
        hand_back()
    _read(scoring, *_words_of(held, sizes, scoring.buckets))
    shared = spark.sparkContext.broadcast([_float32(x[1]) for x in models])
    found = _logits(dealt, shared).toArrow()
    _calibrate(scoring, *(found[x].to_numpy() for x in ("spoken", "logit", "toxic", "clean")))
    shared.destroy()
    return scoring


def _held(dealt: DataFrame) -> DataFrame:
    """Per bucket and language: how many texts of each label and fold hold the bucket, and how often it is that of a word."""
    names = [f"n{mark}{fold}" for mark in (0, 1) for fold in range(FOLDS)]
    kind = ", ".join(["bucket int", "lang string", *(f"{x} long" for x in names), "words long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known in samples(batches, HELD):
            group = known.toxic.astype(np.int64) * FOLDS + known.folds
            for lang in dict.fromkeys(known.langs):
                mine = [i for i, x in enumerate(known.langs) if x == lang]
                own = [np.unique(known.kinds[np.unique(known.texts[i])]) for i in mine]
                key, texts = np.unique(np.concatenate(own) * len(names) + np.repeat(group[mine], [len(x) for x in own]), return_counts=True)
                key, texts = key[key >= 0], texts[key >= 0]  # the empty words have no bucket
                bucket, place = np.unique(key // len(names), return_inverse=True)
                count = np.zeros((len(bucket), len(names)), np.int64)
                count[place, key % len(names)] = texts
                whole = known.kinds[np.concatenate([known.texts[i] for i in mine]), 0]
                words = np.bincount(np.searchsorted(bucket, whole[whole >= 0]), minlength=len(bucket))
                columns = [pa.array(bucket.astype(np.int32)), pa.array([lang] * len(bucket), pa.string()), *(pa.array(x) for x in count.T)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words.astype(np.int64))], ["bucket", "lang", *names, "words"])

    return dealt.mapInArrow(tidy(work), kind).groupBy("bucket", "lang").agg(*[F.sum(c).alias(c) for c in [*names, "words"]])


def _known_of(held: DataFrame, sizes: DataFrame, folds: Sequence[int], n: int) -> np.ndarray:
    """``known_buckets`` of the ``n`` texts of some folds."""
    here = held.join(sizes.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    text = {mark: sum((F.col(f"n{mark}{x}") for x in folds), F.lit(0)) for mark in (0, 1)}
    size = {mark: sum((F.col(f"s{mark}{x}") for x in folds), F.lit(0)) for mark in (0, 1)}
    share = F.greatest(*[F.coalesce(F.try_divide(text[mark], size[mark]), F.lit(0.0)) for mark in (0, 1)])
    found = here.groupBy("bucket").agg(
        F.sum(text[0] + text[1]).alias("count"), F.max(F.greatest(text[0], text[1])).alias("most"), F.max(share).cast("float").alias("share"))
    common = found.filter((F.col("most") >= COMMON) | (F.col("count") >= max(SPREAD, SHARE * n)))
    return np.sort(common.orderBy(F.desc("share"), "bucket").limit(ROWS - 1).select("bucket").toArrow()["bucket"].to_numpy().astype(np.int64))


def _words_of(held: DataFrame, sizes: DataFrame, buckets: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of words per row of the table and language, and the number of languages with thresholds, as in ``_languages``."""
    texts = sum((F.col(c) for c in sizes.columns[1:]), F.lit(0))
    largest = [r["lang"] for r in sizes.filter("lang is not null").orderBy(F.desc(texts), "lang").limit(LANGUAGES + 1).collect()]
    kinds = sorted(largest[:LANGUAGES]) or [None]
    place: Column = F.lit(0)
    if largest:
        place = F.array_position(F.lit(kinds), F.col("lang")) - 1  # -1: of the others, null: of none
        place = F.when(place < 0, len(kinds)).otherwise(place)
    known = held.sparkSession.createDataFrame(pa.table({"bucket": pa.array(buckets.astype(np.int32)), "row": pa.array(np.arange(1, len(buckets) + 1, dtype=np.int32))}))
    found = held.join(F.broadcast(known), "bucket").groupBy("row", place.cast("int").alias("column")).agg(F.sum("words").alias("n")).filter("column is not null").toArrow()
    count = np.zeros((len(buckets) + 1, len(kinds) + (len(largest) > LANGUAGES)))
    count[found["row"].to_numpy(), found["column"].to_numpy()] = found["n"].to_numpy()
    return count, len(kinds)


def _flat(model: Model, seen: Steps) -> np.ndarray:
    """All weights and their sums of squared steps side by side; the rows of the table are the first ones."""
    parts = []
    for one in (model, seen):
        rest = np.concatenate([*(x.ravel() for x in one.filters), one.weights, [one.bias]])
        rest = np.append(rest, np.zeros(-len(rest) % SIZE)).reshape(-1, SIZE)
        parts.append(np.concatenate([one.table, rest.astype(np.float32)]))
    return np.concatenate(parts, 1)


def _move(model: Model, seen: Steps, change: np.ndarray) -> None:
    """Add a change of ``_flat``."""
    flat = _flat(model, seen) + change
    for one, part in ((model, flat[:, :SIZE]), (seen, flat[:, SIZE:])):
        rest, at = part[len(model.table) :].ravel(), 0
        one.table = np.ascontiguousarray(part[: len(model.table)])
        for i, kernel in enumerate(one.filters):
            one.filters[i], at = rest[at : at + kernel.size].reshape(kernel.shape).astype(kernel.dtype), at + kernel.size
        one.weights, one.bias = rest[at : at + len(one.weights)].astype(np.float64), float(rest[at + len(one.weights)])


def _round(dealt: DataFrame, shared, turn: int, seed: int) -> list[np.ndarray]:
    """Train every model once on each partition's texts, from common weights; gives their changes of ``_flat``. A row of weights
    changes by the mean over the partitions that changed it, so that words which few of them know are learned as fast as
    others."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, any_ = copy.deepcopy(shared.value), False
        for at, known in enumerate(samples(batches, HELD)):
            any_ = True
            for which, (other, model, seen, share) in enumerate(own):
                used = np.flatnonzero(known.folds != (-1 if other is None else other))
                if model.weights.any() and len(used):
                    _train(model, seen, known, used, 1, share, np.random.default_rng([seed, turn, part, at, which]))
        for which in range(len(own) if any_ else 0):
            change = _flat(*own[which][1:3]) - _flat(*shared.value[which][1:3])
            change = np.append(change, change.any(1)[:, None], 1).astype(np.float32)
            for begin in range(0, len(change), PIECE):
                columns = [pa.array([x], pa.int32()) for x in (which, begin // PIECE, part)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([change[begin : begin + PIECE].tobytes()], pa.binary())], ["which", "piece", "part", "change"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for row in _rows(batches):
            if row[:2] != place:
                if place is not None:
                    yield merged(place, total)
                place, total = row[:2], 0
            total = total + np.frombuffer(row[3], np.float32).reshape(-1, 2 * SIZE + 1)
        if place is not None:
            yield merged(place, total)

    def merged(place: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        mean = (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["which", "piece", "change"])

    changes = dealt.mapInArrow(tidy(train), "which int, piece int, part int, change binary")
    by_piece = changes.repartition("which", "piece").sortWithinPartitions("which", "piece", "part")
    pieces = by_piece.mapInArrow(tidy(merge), "which int, piece int, change binary").collect()
    found: list[list[np.ndarray]] = [[] for _ in shared.value]
    for row in sorted(pieces, key=lambda x: x["piece"]):
        found[row["which"]].append(np.frombuffer(row["change"], np.float32).reshape(-1, 2 * SIZE))
    return [np.concatenate(x) for x in found]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(x[i].as_py() for x in batch.columns)


def _logits(dealt: DataFrame, shared) -> DataFrame:
    """How many toxic and clean texts have each logit (to a ``FINE``th) that the model without their fold gives them, by the
    language that the model of all texts reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scoring, *others = shared.value
        ready = [x.prepared() for x in others]
        for known in samples(batches, HELD):
            spoken, logit = _spoken(scoring, known), np.zeros(len(known.texts))
            for fold, other in enumerate(others):
                rows = other.rows[known.kinds]
                for some in _runs(np.flatnonzero(known.folds == fold)):
                    logit[some] = other.logits(*_joined(known, some, rows), ready[fold])
            at = np.floor(np.clip(logit, -FAR, FAR) * FINE).astype(np.int64)
            columns = [pa.array(spoken.astype(np.int32)), pa.array(at), pa.array(known.toxic.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["spoken", "at", "toxic"])

    found = dealt.mapInArrow(tidy(work), "spoken int, at long, toxic long").groupBy("spoken", "at").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    return found.select("spoken", ((F.col("at") + 0.5) / FINE).cast("double").alias("logit"), "toxic", (F.col("n") - F.col("toxic")).alias("clean"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: the id, the columns ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Scores read the text alone. Null and empty texts get the score of no words. Rows are independent of each other. A very
    long text is a block of its own; an empty table gives no rows; columns named in ``keep`` pass through.
    """
    kept = list(dict.fromkeys([id_col, *keep]))
    plain = text_col in kept and isinstance(docs.schema[text_col].dataType, T.StringType)  # then it is sent once
    place = kept.index(text_col) if plain else len(kept)
    kind = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ready = own.prepared()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                found = own.scores(part.column(place), ready)
                columns = [*part.columns[: len(kept)], pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, kind.names)

    scored = [] if plain else [F.col(text_col).cast("string").alias("_scored")]
    return docs.select(*kept, *scored).mapInArrow(tidy(work), kind)
