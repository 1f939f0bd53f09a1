"""Personal data by base rules and a semi-Markov conditional random field.

The rules (e-mail, IP, card, phone) are exact scans in linear time. The field finds what they miss, such as written-out
e-mail addresses or phone numbers without a country code. It reads windows around digits and ``@``: a window is cut into
tokens, every run of at most ``LONGEST`` tokens is a candidate segment, and features of the whole segment (digits, groups,
separators, checksum, neighbours) score it per type against "nothing" (score 0). Dynamic programming over the ends of
bounded segments picks boundaries and types together; training follows the gradient of the likelihood, with expectations
from the same recursion forward and backward. It learns from windows of the corpus as the rules label them, from their
rewritten entities, and from made-up entities and look-alikes (dates, versions, amounts, wrong checksums).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.tables import sample_bar

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24  # tokens of a segment at most
AROUND = 40  # characters of a window on either side of a trigger
MARGIN = 1.5  # log odds against "nothing" from which a segment is told
DOCUMENTS = 20_000  # documents whose windows may be learned from, about
WINDOWS = 300  # windows that are learned from at most
CHUNK = 2048  # ends whose candidates are scored at once

# The characters and shapes of the base rules.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]+|[(\[] ?at ?[)\]]|\bat [A-Za-z0-9-]+ dot\b")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|.", re.DOTALL)
LETTER, DIGIT, SPACE, DOT, DASH, OPEN, CLOSE, PLUS, AT, OTHER = range(10)
_CLASS = {".": DOT, "-": DASH, "(": OPEN, "[": OPEN, ")": CLOSE, "]": CLOSE, "+": PLUS, "@": AT, " ": SPACE, "\t": SPACE}

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(x) for x in digits[-1::-2]) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by kind, then start. Each rule goes over a text once, however long its runs are."""
    found: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        hit = _DOMAIN.match(text, at + 1) if size else None
        low = hit.end() if hit else at + 1
        if hit:
            found.append((0, at - size, low))
        at = text.find("@", low)
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".") if chain.end() - chain.start() >= 7 else ()
        begin = chain.start()
        for i in range(0, len(parts) - 3, 4):
            end = begin + sum(map(len, parts[i : i + 4])) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts[i : i + 4]):
                found.append((1, begin, end))
            begin = end + 1
    for hit in _CARD.finditer(text):
        digits = hit[0].replace(" ", "").replace("-", "") if hit.end() - hit.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *hit.span()))
    for hit in _PHONE.finditer(text):
        if 8 <= sum(x.isdigit() for x in hit[0]) <= 15:
            found.append((3, *hit.span()))
    return found


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers that the field reads; those that overlap are one."""
    begin = end = -1
    for hit in _TRIGGER.finditer(text):
        if hit.start() - AROUND > end:
            if end >= 0:
                yield begin, end
            begin = max(0, hit.start() - AROUND)
        end = min(len(text), hit.end() + AROUND)
    if end >= 0:
        yield begin, end


class Tokens:
    """Tokens of a window with running counts, from which the features of any run of tokens follow."""

    def __init__(self, text: str, begin: int = 0, end: int | None = None):
        found = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, begin, len(text) if end is None else end)]
        self.start = np.array([x[0] for x in found], np.int64)
        self.end = np.array([x[1] for x in found], np.int64)
        self.kind = np.array([
            DIGIT if "0" <= x[0] <= "9" else LETTER if len(x) > 1 and x[0] not in " \t" or x.isalpha() else _CLASS.get(x[0], OTHER) for _, _, x in found], np.int64)
        n = len(found)
        words = [x for _, _, x in found]
        digit = self.kind == DIGIT
        size = np.where(digit, self.end - self.start, 0)
        wide = np.array([d and (len(x) > 3 or int(x) > 255) for d, x in zip(digit.tolist(), words, strict=True)], bool)
        marks = [self.kind == k for k in range(10)]
        marks += [np.array([x.lower() == w for x in words], bool) for w in ("at", "dot")]
        marks += [size, wide, size == 4, size == 3, size > 19]
        self.count = np.zeros((n + 1, len(marks)), np.int64)
        self.count[1:] = np.cumsum(np.stack(marks, 1), 0) if n else 0
        values = np.array([ord(c) - 48 for d, x in zip(digit.tolist(), words, strict=True) if d for c in x], np.int64)
        twice = np.where(values > 4, 2 * values - 9, 2 * values)
        even = np.arange(len(values)) % 2 == 0
        self.sums = np.zeros((2, len(values) + 1), np.int64)  # checksums that take even or odd digits as they are
        self.sums[0, 1:] = np.cumsum(np.where(even, values, twice))
        self.sums[1, 1:] = np.cumsum(np.where(even, twice, values))
        self.size = size

    def __len__(self) -> int:
        return len(self.kind)

    def segments(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and end (exclusive) of candidates that end in ``low + 1 .. high``, by end."""
        ends = np.arange(low + 1, high + 1)
        ends = ends[np.isin(self.kind[ends - 1], (LETTER, DIGIT))]
        first = ends[:, None] - 1 - np.arange(LONGEST)
        last = np.broadcast_to(ends[:, None], first.shape)
        some = first >= 0
        first, last = first[some], last[some]
        some = np.isin(self.kind[first], (LETTER, DIGIT, PLUS, OPEN))
        first, last = first[some], last[some]
        n = self.count[last] - self.count[first]
        some = ((n[:, 12] >= 4) & (n[:, 12] <= 32) & (n[:, 16] == 0) | (n[:, AT] + n[:, 10] > 0) & (last - first >= 3)) & (n[:, OTHER] <= 2)
        return first[some], last[some]

    def features(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """0/1 features of whole segments."""
        n = self.count[last] - self.count[first]
        digits, groups = n[:, 12], n[:, DIGIT]
        begin, end = self.count[first, 12], self.count[last, 12]
        plain = (end - 1) % 2  # the last digit counts as it is
        good = (self.sums[plain, end] - self.sums[plain, begin]) % 10 == 0
        tail = self.kind[last - 1]
        head = self.kind[first]
        before = np.where(first > 0, self.kind[np.maximum(first - 1, 0)], SPACE)
        after = np.where(last < len(self), self.kind[np.minimum(last, len(self) - 1)], SPACE)
        then = np.where(last + 1 < len(self), self.kind[np.minimum(last + 1, len(self) - 1)], SPACE)
        joined = np.isin(after, (DOT, DASH, AT)) & np.isin(then, (LETTER, DIGIT))
        ago = np.where(first > 1, self.kind[np.maximum(first - 2, 0)], SPACE)
        hooked = np.isin(before, (DOT, DASH, AT)) & np.isin(ago, (LETTER, DIGIT))
        end_size = self.size[last - 1]
        columns = [np.ones(len(first), bool)]
        columns += [(digits >= p) & (digits <= q) for p, q in ((0, 0), (1, 3), (4, 6), (7, 7), (8, 9), (10, 11), (12, 15), (16, 19), (20, 32))]
        columns += [groups == k for k in range(5)] + [groups > 4]
        columns += [n[:, AT] == 1, n[:, AT] > 1, n[:, 10] == 1, n[:, 11] > 0, (n[:, AT] + n[:, 10] == 1) & (n[:, DOT] + n[:, 11] > 0)]
        columns += [n[:, DOT] == 0, n[:, DOT] == 3, n[:, DASH] > 0, n[:, SPACE] == 0, n[:, SPACE] > 4, n[:, OPEN] != n[:, CLOSE], n[:, OPEN] > 1]
        columns += [head == k for k in (LETTER, DIGIT, PLUS, OPEN)] + [tail == LETTER, n[:, PLUS] > (head == PLUS)]
        columns += [n[:, LETTER] == 0, n[:, OTHER] > 0, (digits >= 13) & good, (digits >= 13) & ~good]
        columns += [(groups == 4) & (n[:, 13] == 0), (groups == 4) & (n[:, 13] == 0) & (n[:, DOT] >= 3), (groups == 4) & (n[:, 14] == 4)]
        columns += [(n[:, 15] >= 1) & (n[:, 14] == 1) & (end_size == 4) & (digits <= 11), (n[:, 15] >= 2) & (end_size == 4) & (digits <= 11)]
        columns += [(digits == 0) & (n[:, LETTER] == 2), last - first == 1, last - first <= 4, last - first >= 16]
        columns += [before == k for k in (LETTER, DIGIT, AT, PLUS, DASH, DOT, OTHER)] + [after == k for k in (LETTER, DIGIT, AT, DASH, DOT, OTHER)]
        wide = np.where(tail == LETTER, self.end[last - 1] - self.start[last - 1], 0)
        columns += [(wide > 1) & (wide < 4), wide > 3] + [n[:, LETTER] == k for k in (1, 3, 4, 5)] + [n[:, LETTER] > 5]
        columns += [joined, hooked, (before == SPACE) & (after == SPACE), (head == OPEN) & (n[:, CLOSE] == 1)]
        return np.stack(columns, 1).astype(np.float64)


def n_features() -> int:
    some = Tokens("1 2")
    return some.features(np.array([0]), np.array([1])).shape[1]


def best_segments(tokens: Tokens, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(kind, first, end, score)`` of the segments in the best segmentation, by the maximum over bounded segments."""
    best = np.zeros(len(tokens) + 1)
    back: dict[int, tuple[int, int, float]] = {}
    for low in range(0, len(tokens), CHUNK):
        high = min(low + CHUNK, len(tokens))
        first, last = tokens.segments(low, high)
        score = tokens.features(first, last) @ weights.T if len(first) else np.zeros((0, len(weights)))
        kind = score.argmax(1) if len(first) else np.zeros(0, np.int64)
        score = score.max(1) if len(first) else np.zeros(0)
        edge = np.searchsorted(last, np.arange(low + 1, high + 2))
        for j in range(low + 1, high + 1):
            best[j] = best[j - 1]
            p, q = edge[j - low - 1], edge[j - low]
            if p < q:
                total = best[first[p:q]] + score[p:q]
                k = int(total.argmax())
                if total[k] > best[j]:
                    best[j] = total[k]
                    back[j] = (int(kind[p + k]), int(first[p + k]), float(score[p + k]))
    found, j = [], len(tokens)
    while j > 0:
        if j in back:
            kind, i, score = back[j]
            found.append((kind, i, j, score))
            j = i
        else:
            j -= 1
    return found[::-1]


def likelihood(first: np.ndarray, last: np.ndarray, score: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations of ``n`` tokens, and the probability of each candidate and kind."""
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    edge = np.searchsorted(last, np.arange(1, n + 2))
    for j in range(1, n + 1):
        p, q = edge[j - 1], edge[j]
        ahead[j] = ahead[j - 1] if p == q else _log_sum(np.append((ahead[first[p:q], None] + score[p:q]).ravel(), ahead[j - 1]))
    order = np.argsort(first, kind="stable")
    edge = np.searchsorted(first[order], np.arange(0, n + 1))
    for i in range(n - 1, -1, -1):
        mine = order[edge[i] : edge[i + 1]]
        behind[i] = behind[i + 1] if not len(mine) else _log_sum(np.append((behind[last[mine], None] + score[mine]).ravel(), behind[i + 1]))
    return float(ahead[n]), np.exp(np.minimum(ahead[first, None] + score + behind[last, None] - ahead[n], 0))


def _log_sum(x: np.ndarray) -> float:
    high = x.max()
    return float(high + np.log(np.exp(x - high).sum()))


@dataclass
class Example:
    """Candidates of a window, their features, and the true (candidate, kind) pairs."""

    first: np.ndarray
    last: np.ndarray
    features: np.ndarray
    true: list[tuple[int, int]]
    n: int


def example(text: str, gold: Sequence[Span]) -> Example | None:
    """None where a gold span is no run of tokens that can be a candidate."""
    tokens = Tokens(text)
    first, last = tokens.segments(0, len(tokens))
    place = {(int(tokens.start[i]), int(tokens.end[j - 1])): at for at, (i, j) in enumerate(zip(first.tolist(), last.tolist(), strict=True))}
    true = [(place.get((p, q), -1), kind) for kind, p, q in gold]
    if not len(first) or any(at < 0 for at, _ in true):
        return None
    return Example(first, last, tokens.features(first, last), true, len(tokens))


def gradient(weights: np.ndarray, some: Example) -> tuple[float, np.ndarray]:
    """Log-likelihood of an example and its gradient."""
    score = some.features @ weights.T
    total, chance = likelihood(some.first, some.last, score, some.n)
    up = -chance.T @ some.features
    value = -total
    for at, kind in some.true:
        value += score[at, kind]
        up[kind] += some.features[at]
    return value, up


def train(examples: Sequence[Example], epochs: int = 9, rate: float = 0.4, ridge: float = 0.0002, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    weights = np.zeros((len(KINDS), n_features()))
    weights[:, 0] = -3
    seen = np.full(weights.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for begin in range(0, len(order), 16):
            step = sum((gradient(weights, examples[i])[1] for i in order[begin : begin + 16]), -ridge * 16 * weights)
            seen += step**2
            weights += rate * step / np.sqrt(seen)
    return weights


def made_entity(kind: int, rng: np.random.Generator) -> str:
    """An entity as the rules know it, or rewritten as people write it to evade or by habit."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(3, 9))))
    form = int(rng.integers(0, 4))
    if kind == 0:
        name = w() + [".", "_", "", ""][int(rng.integers(0, 4))] + (w() if rng.random() < 0.4 else d(2))
        if name.endswith("_"):
            name += w()
        host, top = w() + (d(1) if rng.random() < 0.3 else ""), ["com", "org", "net", "de", "fr"][int(rng.integers(0, 5))]
        return [f"{name}@{host}.{top}", f"{w()} at {w()} dot {top}", f"{w()}(at){w()}.{top}", f"{w()} [at] {w()} [dot] {top}"][form]
    if kind == 1:
        a, b, c, e = (str(int(x)) for x in rng.integers(0, 256, 4))
        return [f"{a}.{b}.{c}.{e}", f"{a}.{b}.{c}.{e}", f"{a}[.]{b}[.]{c}[.]{e}", f"{a}(.){b}(.){c}(.){e}"][form]
    if kind == 2:
        number = "4" + d(14)
        number += next(str(x) for x in range(10) if luhn(number + str(x)))
        cut = [number[i : i + 4] for i in range(0, 16, 4)]
        return [number, "-".join(cut), ".".join(cut), "  ".join(cut)][form]
    area, one, two = str(int(rng.integers(200, 1000))), str(int(rng.integers(200, 1000))), d(4)
    return [f"+1 ({area}) {one}-{two}", f"({area}) {one}-{two}", f"{area}-{one}-{two}", f"1 ({area}) {one}-{two}"][form]


def made_other(rng: np.random.Generator) -> str:
    """Text with digits or markers that is no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    wrong = "4" + d(15)
    if luhn(wrong):
        wrong = wrong[:-1] + str((int(wrong[-1]) + 1) % 10)
    cut = [wrong[i : i + 4] for i in range(0, 16, 4)]
    forms = [
        f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}",
        f"{rng.integers(0, 24):02}:{rng.integers(0, 60):02}:{rng.integers(0, 60):02}", f"{rng.integers(0, 9)}.{d(6)}", f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 9)}",
        f"{rng.integers(1, 999)},{d(3)},{d(3)}.{d(2)}", d(int(rng.integers(4, 16))), wrong, " ".join(cut), "-".join(cut), rng.bytes(12).hex(), "$" + d(5) + ".00",
        f"pages {d(3)}-{d(3)}", f"{rng.integers(256, 999)}.{d(3)}.{d(3)}.{rng.integers(300, 999)}", f"{d(4)} {d(4)} {d(2)}", "look at this dot here", "@home today", "a@b",
        f"{d(2)} {d(2)} {d(3)} {d(2)} {d(3)}", f"#{d(4)}-{d(5)}", f"{d(5)}-{d(4)}", f"{d(8)}T{d(6)}", f"0x{rng.bytes(4).hex()}", f"{d(1)} {d(1)} {d(1)} {d(1)} {d(1)} {d(1)}",
    ]
    return str(forms[int(rng.integers(0, len(forms)))])


def examples(contexts: Sequence[str], seed: int = 5, made: int = 480) -> list[Example]:
    """What the field learns from: contexts as the rules label them, and contexts with made-up entities or look-alikes."""
    rng = np.random.default_rng(seed)
    found = [example(text, base_spans(text)) for text in contexts]
    plain = [re.sub(r"[0-9@]+", " ", x) for x in contexts] or ["some words, and others. Here they end"]
    for n in range(made):
        text = plain[n % len(plain)]
        gaps = [m.start() for m in re.finditer(" ", text)] or [len(text)]
        at = gaps[int(rng.integers(0, len(gaps)))]
        kind = int(rng.integers(-3, len(KINDS)))
        entity = made_entity(kind, rng) if kind >= 0 else made_other(rng)
        end = ["", "", "", ".", ",", "!!", "&&&"][int(rng.integers(0, 7))]
        whole = f"{text[:at]} {entity}{end}{text[at:]}"
        found.append(example(whole, [(kind, at + 1, at + 1 + len(entity))] if kind >= 0 else []))
    return [x for x in found if x is not None]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, kept: int = WINDOWS) -> np.ndarray:
    """Weights of the field, from at most ``kept`` short windows of about ``documents`` documents, picked by hashes."""
    total = docs.count()
    chosen = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    chosen = chosen.filter(F.col("h") <= F.lit(sample_bar(min(1.0, documents / max(total, 1)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[p:q] for x in batch.column(0).to_pylist() if x for p, q in windows(x) if q - p <= 8 * AROUND]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["text"])

    got = chosen.select("text").mapInArrow(work, "text string").distinct()
    rows = got.select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(kept).collect()
    return train(examples([r["text"] for r in rows]))


def found_in(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans of the field that touch none of them."""
    base = base_spans(text)
    taken = sorted((p, q) for _, p, q in base)
    more: list[Span] = []
    at = 0
    for begin, end in windows(text):
        tokens = Tokens(text, begin, end)
        for kind, i, j, score in best_segments(tokens, weights):
            p, q = int(tokens.start[i]), int(tokens.end[j - 1])
            while at < len(taken) and taken[at][1] <= p:
                at += 1
            clear = all(y <= p or x >= q for x, y in taken[max(at - 4, 0) : at + 4]) and (at >= len(taken) or taken[at][0] >= q)
            if score >= MARGIN and clear:
                more.append((kind, p, q))
    return base, sorted(more)


def scan(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``base`` and ``more``, arrays of structs ``kind, start, end`` (code points, end
    exclusive) by kind as in ``KINDS``, then start.

    A null or empty text has none. Windows are read one after the other, so a very long text needs little beside itself.
    Rows are independent of each other; other columns are not read. An empty table gives no rows.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, base array<struct<kind:string,start:bigint,end:bigint>>, more array<struct<kind:string,start:bigint,end:bigint>>"

    def listed(found: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": p, "end": q} for k, p, q in x] for x in found], spans)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = [found_in(x.as_py() or "", weights) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), listed([x for x, _ in found]), listed([x for _, x in found])], ["id", "base", "more"])

    return own.mapInArrow(work, kind).withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def all_spans(base: str = "base", more: str = "more") -> Column:
    """Both arrays as one, by kind as listed, then start."""
    both = F.concat(base, more)
    return F.concat(*[F.array_sort(of_kind(both, k)) for k in KINDS])
