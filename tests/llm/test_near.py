import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from probeline.llm import near
from probeline.llm.components import components
from probeline.llm import textbytes as tb


def shingle_set(text, k=5):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(texts, percent=80):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def texts_with_copies(seed=3, families=12):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [str(x) for x in rng.choice(vocabulary, 60)]
    texts, name = [], 0
    for f in range(families):
        base = [str(x) for x in rng.choice(vocabulary, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary)).upper()
            if f % 3 == 0:
                words += passage
            texts.append((name, (" ", "\n", "\t ")[name % 3].join(words)))
            name += 1
    return texts


def test_shingles_match_words():
    texts = ["", None, "one two", "A b  c\td\ne f", "é ü  ö x y z  ", " ", "a b c d e", "a b c d e f g a b c d e f g"]
    found = dict(near.text_sets(pa.array(texts), 5))
    assert [len(found[i]) for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]
    again = dict(near.text_sets(pa.array(["a B c d e F"]), 5))
    assert again[0].tolist() == found[3].tolist()


def test_blocks_do_not_change_hashes():
    texts = [" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(40)]
    one = [tb.word_hashes(d, tb.words(d, a)[0]).tolist() for _, d, a in tb.blocks(pa.array(texts))]
    many = [tb.word_hashes(d, tb.words(d, a)[0]).tolist() for _, d, a in tb.blocks(pa.array(texts), 64)]
    assert sum(one, []) == sum(many, [])


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_linked_sets_share_a_signature(data):
    percent = data.draw(st.sampled_from([70, 80, 90]))
    size = data.draw(st.integers(1, 60))
    pool = tb.mix(np.arange(1, 400, dtype=np.uint64))
    a = set(data.draw(st.permutations(range(90)))[:size])
    change = data.draw(st.integers(0, max(1, size // 4)))
    b = (set(sorted(a)[change:]) | set(range(100, 100 + data.draw(st.integers(0, change + 1))))) or {1}
    heavy = sorted(data.draw(st.sets(st.integers(0, 120))))
    names = np.sort(pool[heavy] >> np.uint64(16)) if heavy else np.empty(0, np.uint64)
    counts = np.arange(17, 17 + len(names))
    if 100 * len(a & b) >= percent * len(a | b):
        starts = near.levels(percent)
        one, two = (near.prefix(np.sort(pool[sorted(x)]), names, counts, percent, starts) for x in (a, b))
        assert {x for found in one for x in found.tolist()} & {x for found in two for x in found.tolist()}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000), min_size=1, max_size=400), st.sets(st.integers(0, 3000), min_size=1, max_size=400))
def test_sketches_never_overstate_the_difference(a, b):
    one, two = (tb.mix(np.array(sorted(x), np.uint64)) for x in (a, b))
    x, y = near.sketch(one), near.sketch(two)
    x, y = (near.folded(np.frombuffer(z, np.uint8)[None], min(len(x), len(y))) for z in (x, y))
    assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_levels_keep_partners_close():
    for percent in (50, 80, 95):
        starts = near.levels(percent, 3000)
        level = lambda n: int(np.searchsorted(starts, n, "right"))
        assert all(level(n * 100 // percent) - level(n) <= 1 for n in range(1, 2000))


@pytest.mark.parametrize(("rare", "block"), [(1, 512), (16, 512), (16, 3), (1, 2)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, rare, block):
    texts = [*texts_with_copies(), (900, None), (901, ""), (902, " \n "), (903, "same words"), (904, "SAME  words")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, cls string").repartition(5)
    monkeypatch.setattr(near.frequent, "__defaults__", (rare, near.HEAVY))
    monkeypatch.setattr(near.crossing, "__defaults__", (block,))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.groups(docs).collect()}
    assert found == brute(texts)
    assert len(set(found.values())) < len(texts)


def test_bar_rises_when_too_many_tokens_are_frequent(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h" if i % 2 else "a b c d e f g h i j k") for i in range(40)], "doc_id long, text string").repartition(8)
    names, counts = near.frequent(docs, "text", 5, rare=1, most=5)
    assert len(names) <= 5 and (counts > 2).all()


def test_empty_null_and_repeated_rows(spark):
    kind = "text string, doc_id long, n_shingles int, component_id int"
    assert near.groups(spark.createDataFrame([], kind)).count() == 0
    docs = spark.createDataFrame([("a b c d e f", 4, 1, 1), ("a b c d e f", 4, 1, 1), ("A b c d e f", None, 1, 1), ("z", None, 1, 1), ("z", 9, 1, 1)], kind)
    found = sorted((r[0] is None, r[0], r[1], r[2]) for r in near.groups(docs).collect() if r[0] is not None)
    assert found == [(False, 4, 2, 4), (False, 4, 2, 4), (False, 9, 1, 9)]
    kept = near.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(4, "a b c d e f"), (9, "z")]


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short one")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near.groups(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    one = " ".join(f"a{i}" for i in range(40))
    rows = [
        (0, one, 1), (1, one + " more", 2), (1, "something else altogether here now", 3),  # an id on a copy and on another text
        (2, "x1 x2 x3 x4 x5 x6", 4), (2, "X1 x2 x3  x4 x5 x6", 5), (2, "y1 y2 y3 y4 y5 y6", 6), (3, "y1 y2 y3 y4 y5 y6", 7),
        (None, "x1 x2 x3 x4 x5 x6", 8), (None, "lone words without an id", 9), (None, "lone words without an id", 10),
        (5, "", 11), (5, "", 12), (5, " ", 13), (6, None, 14), (None, None, 15), (None, None, 16), (7, "", 17),
    ]
    docs = spark.createDataFrame([(*r, [r[2]], 0) for r in rows], "doc_id long, text string, cls int, row array<int>, _c int")
    got = near.distinct_documents(docs)
    assert got.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"], r["cls"]) for r in got.collect()), key=lambda r: r[2])
    kept = [r[2] for r in found]
    assert 1 in kept and 2 not in kept and 3 in kept
    assert sum(x in kept for x in (4, 5, 8)) == 1 and 6 in kept and 7 not in kept
    assert sum(x in kept for x in (9, 10)) == 1
    assert sum(x in kept for x in (11, 12)) == 1 and {13, 14, 17} <= set(kept) and sum(x in kept for x in (15, 16)) == 1
    assert len(kept) == 10


def test_components_in_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(-5, i) for i in range(2000, 2100)]
    edges += [(None, 3), (4, None), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    wanted = {x: top(x) for x in up}
    for small in (0, 40, 1 << 18):
        assert {r["node"]: r["component"] for r in components(df, small=small).collect()} == wanted
    assert components(df.limit(0)).count() == 0
