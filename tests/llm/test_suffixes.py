import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probeline.llm import suffixes
from probeline.llm.queries import QUERIES


def brute(texts):
    """(n_bytes, n_removed, spans, hash of the rest) per text, from every 200-byte string."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    found = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        spans = [tuple(x) for x in edge.reshape(-1, 2).tolist()]
        rest = bytes(x for x, y in zip(b, gone, strict=False) if not y)
        found.append((len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return found


def found_for(spark, texts, partitions=6):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    rows = {r["doc_id"]: r for r in suffixes.repeats(docs).collect()}
    return [(r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in (rows[i] for i in range(len(texts)))]


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8)))) for _ in range(n))


def corpus(seed):
    rng = np.random.default_rng(seed)
    passage, line = prose(rng, 80), prose(rng, 30)
    texts = [prose(rng, int(rng.integers(0, 200))) for _ in range(12)]
    for i in range(10):
        cut = int(rng.integers(0, 60))
        texts.append(texts[i][: 3 * cut] + passage[cut : len(passage) - int(rng.integers(0, 90))] + texts[i][3 * cut :])
    texts += [texts[1], texts[1], texts[2] + "x", "\n".join([line] * 4), "a" * 700, "ab" * 300 + "c", "-" * 199, passage, None, "", "é" * 99 + "x"]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_every_byte_as_by_brute_force(spark, seed, monkeypatch):
    texts = corpus(seed)
    assert found_for(spark, texts) == brute(texts)


def test_runs_that_cross_buckets(spark, monkeypatch):
    texts = corpus(3)
    monkeypatch.setattr(suffixes, "BUCKET", 5)
    monkeypatch.setattr(suffixes, "LISTED", 0)
    assert found_for(spark, texts) == brute(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=150), st.binary(min_size=1, max_size=12))
def test_multikey_order(texts, head):
    texts = texts + [head * 3 + x for x in texts]
    order = suffixes.multikey_order(texts)
    assert sorted(order.tolist()) == list(range(len(texts)))
    assert [texts[i] for i in order] == sorted(texts)


def test_empty_null_ids_and_repeated_rows(spark):
    kind = "text string, doc_id long, spans string, name string"
    assert suffixes.repeats(spark.createDataFrame([], kind)).count() == 0
    rng = np.random.default_rng(9)
    one, two = prose(rng, 90), prose(rng, 90)
    docs = spark.createDataFrame([(one, 1, "", ""), (one, 1, "", ""), (two, None, "", ""), (two[:300] + "!", 5, "", "")], kind)
    found = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.repeats(docs).collect())
    assert found == [(0, 300), (1, len(one.encode())), (1, len(one.encode())), (5, 300)] if two[:300].isascii() else found


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_suffixes"](spark, sf_dir).collect()}
    wanted = brute([r["text"] for r in rows])
    assert found == {r["doc_id"]: (n, gone, len(spans), kept) for r, (n, gone, spans, kept) in zip(rows, wanted, strict=True)}


def test_tasks_hand_memory_back():
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, work, kind):
            return work

    for step in (suffixes._anchor_keys, suffixes._suffixes, suffixes._buckets, suffixes._removed):
        assert step(Rows()).__qualname__.startswith("tidy")
