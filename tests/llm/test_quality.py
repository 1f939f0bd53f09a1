import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_words import words
from probeline.llm import quality


def counts(text):
    text = text or ""
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    under = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under))


def texts():
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice([f"w{i}" for i in range(9)], int(n))) for n in rng.integers(0, 90, 30)]
    line = "a b c d e f g h i"
    return [*base, None, "", " \n\t ", "\n".join([line] * 5), line + " x " + line, "### %% é&é\n\n x\nx\n x", "z " * 50_000, "one\rtwo\x0bthree\u3000four"]


def test_counts_as_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts())], "doc_id long, text string, n_words int, _w string")
    found = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.features(docs).collect()}
    assert found == {i: counts(t) for i, t in enumerate(texts())}


def test_exact_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.1), (49, 50, 0.5), (12, 4000, 0.005), (0, 400_000, 0.005), (1900, 400_000, 0.005)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).collect()[0][0]
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        assert got == pytest.approx(sum(map(math.exp, logs)), rel=1e-6, abs=1e-300)


def test_cutoffs_limit_false_rejection(spark):
    rng = np.random.default_rng(5)
    n = 6000
    symbols = np.where(rng.random(n) < 0.002, 60, rng.integers(0, 4, n))
    rows = [("en" if i < 5900 else "rare", int(s), 1000, 200, 10, 0, 0) for i, s in enumerate(symbols)]
    good = spark.createDataFrame(rows, "stratum string, n_symbols long, word_chars long, n_words long, n_lines long, n_dup_lines long, n_repeat_words long")
    found = {r["stratum"]: r for r in quality.proven_cutoffs(good, "stratum", 0.01, 0.05).collect()}
    assert found["en"]["symbols"] == 5  # 0.2 % are above; a stricter cutoff would reject far more than 1 %
    assert found["rare"]["symbols"] is None  # 100 texts cannot prove 1 %


def test_judge_rejects_junk_and_keeps_clean(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(2600):
        text = " ".join(rng.choice(vocabulary, 40))
        junk = i % 13 == 0
        rows.append((i, text + " ##%%&&**" * 6 if junk else text, "en"))
        labels.append((i, int(not junk)))
    rows += [(9001, "too short", "en"), (9002, None, None), (9003, "a b c d e f g h " * 10, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(found[i]["kept"] == (i % 13 != 0) for i in range(2600))
    assert not any(found[i]["kept"] for i in (9001, 9002, 9003)) and found[9003]["base_failed"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 30 + "x", None), (None, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.judge(docs, labels).count() == 2
