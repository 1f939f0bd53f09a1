import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probeline.llm import pii
from probeline.llm.queries import QUERIES

# The contract's expressions as they stand; quadratic on long runs, so for short texts only.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: [int(x) for x in m[0] if x in "0123456789"]

    def checks(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0

    return (
        [(0, *m.span()) for m in EMAIL.finditer(text)]
        + [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        + [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checks(digits(m))]
        + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    )


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-_+ 0123456789()é\n", max_size=60) | st.lists(st.sampled_from(
    ["a.b@c.de", "@", "1.2.3.4", "256.1.1.1", ".", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", "é", "x_", "-", "00.007.1.255"]), max_size=8).map("".join))
def test_base_rules(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "a@" * 500_000, "1." * 500_000, "+1" * 500_000, "1 " * 500_000, "a." * 500_000 + "@"])
def test_base_rules_take_long_runs(text):
    begin = time.time()
    pii.base_spans(text)
    assert time.time() - begin < 10


@pytest.fixture(scope="module")
def weights():
    contexts = [f"Ein Satz ohne viel, {n} und mehr. And so on it goes {n * n}, there." for n in range(20)]
    return pii.train(pii.examples(contexts))


def test_finds_what_the_rules_miss_and_leaves_look_alikes(weights):
    rng = np.random.default_rng(77)
    asked, found, wrong = [0] * 4, [0] * 4, 0
    for n in range(400):
        entity, other = pii.made_entity(n % 4, rng), pii.made_other(rng)
        base, more = pii.found_in(f"here it is {entity} and so on", weights)
        asked[n % 4] += 1
        found[n % 4] += (n % 4, 11, 11 + len(entity)) in base + more
        wrong += bool(pii.found_in(f"here it is {other} and so on", weights)[1])
    assert all(f >= 0.6 * a for f, a in zip(found, asked, strict=True)) and sum(found) >= 0.85 * sum(asked)
    assert wrong <= 8
    assert pii.found_in("clean words only, no numbers at all " * 50, weights) == ([], [])


def segmentations(first, last, n):
    """All sets of disjoint candidates, with a kind each."""
    def walk(at):
        if at >= n:
            yield ()
            return
        for rest in walk(at + 1):
            yield rest
        for c, (i, j) in enumerate(zip(first, last, strict=True)):
            if i == at:
                for rest in walk(j):
                    for kind in range(len(pii.KINDS)):
                        yield ((c, kind), *rest)

    return walk(0)


@pytest.mark.parametrize("text", ["12345 6789", "a@b.co 1.2.3.4", "(1234) 56", "+1 2345-678"])
def test_recursions_against_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    weights = rng.normal(0, 0.7, (len(pii.KINDS), pii.n_features()))
    tokens = pii.Tokens(text)
    first, last = tokens.segments(0, len(tokens))
    score = tokens.features(first, last) @ weights.T
    every = list(itertools.islice(segmentations(first.tolist(), last.tolist(), len(tokens)), 300_000))
    assert len(every) < 300_000
    value = np.array([sum(score[c, k] for c, k in x) for x in every])
    total, chance = pii.likelihood(first, last, score, len(tokens))
    assert np.isclose(total, np.log(np.exp(value).sum()))
    mass = np.zeros_like(chance)
    for x, v in zip(every, value, strict=True):
        for c, k in x:
            mass[c, k] += np.exp(v - total)
    assert np.allclose(mass, chance)
    assert np.isclose(sum(x[3] for x in pii.best_segments(tokens, weights)), value.max())


def test_gradient():
    text = "call +1 (555) 555-1234 now"
    some = pii.example(text, pii.base_spans(text))
    weights = np.random.default_rng(1).normal(0, 0.3, (len(pii.KINDS), pii.n_features()))
    _, up = pii.gradient(weights, some)
    for k, f in [(0, 0), (3, 0), (3, 5), (2, 20), (3, 30)]:
        step = np.zeros_like(weights)
        step[k, f] = 1e-5
        slope = (pii.gradient(weights + step, some)[0] - pii.gradient(weights - step, some)[0]) / 2e-5
        assert np.isclose(slope, up[k, f], atol=1e-5)


def test_windows_in_chunks(weights, monkeypatch):
    rng = np.random.default_rng(4)
    text = " x ".join(pii.made_entity(n % 4, rng) for n in range(60))
    whole = pii.best_segments(pii.Tokens(text), weights)
    monkeypatch.setattr(pii, "CHUNK", 7)
    assert [x[:3] for x in pii.best_segments(pii.Tokens(text), weights)] == [x[:3] for x in whole] and len(whole) > 30


def test_scan_takes_odd_rows(spark, weights):
    rows = [(1, "mail a.b@c.de 1.2.3.4", 0, 1), (1, "mail a.b@c.de 1.2.3.4", 0, 1), (None, None, 0, 1), (2, "", 0, 1), (3, "word " * 100_000 + "+1 (555) 555-1234", 0, 1),
            (4, "ß" * 5 + " 4111 1111 1111 1111", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int, kind int")
    got = pii.scan(docs, weights).collect()
    found = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["base"]]) for r in got), key=lambda x: x[0])
    one = [("email", 5, 13), ("ip", 14, 21)]
    assert found == [(0, []), (1, one), (1, one), (2, []), (3, [("phone", 500_000, 500_017)]), (4, [("card", 6, 25)])]
    assert pii.scan(docs.limit(0), weights).count() == 0
    assert pii.learn(docs.limit(0)).shape == weights.shape


def test_query_against_the_plain_expressions(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op11_pii"](spark, sf_dir).collect():
        base = plain(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{p}:{q}" for k, p, q in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {(pii.KINDS[k], str(p), str(q)) for k, p, q in base} <= {tuple(x) for x in spans}
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
