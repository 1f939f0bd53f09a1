import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probeline.llm import phrases


def brute(rows, support, top, scale=2_000_000):
    freq, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    freq.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, count in freq.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        longest = Counter()
        for p, a in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longest[p[i : i + n]] = max(longest[p[i : i + n]], a)
        kept = []
        for p, a in often.items():
            if longest[p] and 100 * longest[p] >= 80 * a:
                continue
            cuts = [(scale * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    names = ["The", "of", "é", "x", "new", "york", "city", "in", "don't", "a-b", "ß"]
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 40))
        words = [names[min(int(x), len(names) - 1)] for x in rng.geometric(0.3, size) - 1]
        ends = rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "!?", "\r\n"], size)
        rows.append(("".join(w + e for w, e in zip(words, ends, strict=True)) + " new york city" * (i % 3), [None, "en", "fr", "und"][i % 4]))
    return rows + [(None, "en"), ("", None), (" . ,", "xx"), ("w" * 200_000 + " end", "en")] + [("same old words here", "en")] * 50


@pytest.mark.parametrize("support, top", [(5, 1000), (30, 7)])
def test_against_counting_all_phrases(spark, support, top):
    rows = made(3)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, key int, word string").repartition(5)
    found = phrases.collocations(docs, support=support, top=top)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, support, top)


def test_a_hot_pair_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GATHERED", 500)
    rng = np.random.default_rng(5)
    rows = [(" ".join(["hot pair " + " ".join(f"w{x}" for x in rng.integers(0, 9, 2)) for _ in range(20)]), "en") for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    sizes = []
    original = phrases.written

    def spied(df, label):
        out = original(df, label)
        if label == "partitions":
            sizes.append(out.filter("not all").count())
        return out

    monkeypatch.setattr(phrases, "written", spied)
    found = sorted(tuple(r) for r in phrases.collocations(docs, top=50).collect())
    assert found == brute(rows, 30, 50) and sizes[0] > 0


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3), st.integers(0, 3), st.integers(0, 2), st.integers(1, 3)), max_size=150), st.integers(1, 6))
def test_multikey_counts(rows, support):
    grid = np.array([r[:4] for r in rows], np.uint64).reshape(-1, 4)
    for d in range(1, 4):
        grid[grid[:, d - 1] == 0, d:] = 0
    weight = np.array([r[4] for r in rows], np.int64)
    for known in (1, 3):
        count = Counter()
        for g, n in zip(grid.tolist(), weight.tolist(), strict=True):
            for d in range(2, 5):
                if g[d - 1]:
                    count[tuple(g[:d])] += n
        found = {tuple(grid[r, :d].tolist()): n for r, d, n in phrases.multikey_counts(grid, weight, support, known)}
        assert {p: n for p, n in count.items() if n >= support or len(p) < known} == found
