import zlib

import numpy as np
import pyarrow as pa
import pytest

from probeline.llm import language, toxicity
from probeline.llm.queries import QUERIES
from probeline.llm.tables import sample_bar


def corpus(n=900, seed=2):
    rng = np.random.default_rng(seed)
    stock = {"en": [f"the{i}" for i in range(300)], "de": [f"und{i}" for i in range(300)]}
    bad = {"en": ["scoundrel", "rogue"], "de": ["halunke"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = [str(x) for x in rng.choice(stock[lang], int(rng.integers(5, 80)))]
        toxic = i % 5 == 0
        if toxic:
            text[int(rng.integers(len(text)))] = str(rng.choice(bad[lang])).upper() + "!"
        rows.append((i, " ".join(text), lang, int(toxic)))
    return rows


def test_classifier_learns_words():
    rows = corpus()
    model = toxicity.fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    fresh = corpus(seed=77)
    found = model.scores(pa.array([r[1] for r in fresh]), model.prepared()) >= 0.5
    assert np.mean(found == np.array([r[3] for r in fresh])) > 0.97


def small_language(seed):
    """``corpus`` beside a language of 300 texts, whose 75 toxic ones share out a list of twelve words."""
    rng = np.random.default_rng(seed)
    rows = corpus(2400, seed)
    for i in range(300):
        text = [f"et{x}" for x in rng.integers(0, 300, int(rng.integers(5, 80)))]
        if i % 4 == 0:
            text[int(rng.integers(len(text)))] = f"faquin{i // 4 % 12}"
        rows.append((3000 + i, " ".join(text), "fr", int(i % 4 == 0)))
    return rows


def test_toxic_words_of_a_small_language():
    rows, fresh = small_language(5), small_language(6)
    model = toxicity.fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    found = model.scores(pa.array([r[1] for r in fresh]), model.prepared()) >= 0.5
    marks, langs = np.array([r[3] for r in fresh]) == 1, np.array([r[2] for r in fresh])
    for lang, least in (("en", 0.9), ("de", 0.9), ("fr", 0.7)):
        assert found[marks & (langs == lang)].mean() > least and found[~marks & (langs == lang)].mean() < 0.03, lang


def test_known_buckets_by_language_and_label(monkeypatch):
    kinds = np.array([[1, 2], [-1, -1], [3, 2], [4, 4], [5, -1]])
    texts = [np.array([0, 1])] * 3 + [np.array([2, 2])] * 2 + [np.array([3])] * 95
    groups = [("fr", 1)] * 3 + [("fr", 0)] * 2 + [("en", 0)] * 95
    assert toxicity.known_buckets(kinds, texts, groups).tolist() == [1, 2, 4]
    monkeypatch.setattr(toxicity, "ROWS", 3)
    texts, groups = texts + [np.array([4])] * 50, groups + [("en", 0)] * 50  # in more texts, in a smaller share
    assert toxicity.known_buckets(kinds, texts, groups).tolist() == [1, 2]


def plain_logit(model, text):
    """The forward pass of one text word by word."""
    words = [x for _, x, _ in toxicity.padded(pa.array([text]))][0]
    vectors = [sum(model.table[model.rows[b]] for b in word) for word in words]
    best = []
    for kernel in model.filters:
        for f in range(toxicity.FILTERS):
            sums = [
                sum(float(vectors[i + j] @ kernel[j][:, f]) for j in range(len(kernel)) if i + j < len(words))
                for i in range(len(words) - toxicity.PAD)]
            best.append(max([0.0, *sums]))
    return float(np.array(best) @ model.weights + model.bias)


def test_logits_against_a_plain_forward_pass():
    rows = corpus(150)
    model = toxicity.fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], epochs=2)
    for _, text, _, _ in rows[:12]:
        words, at = [(x, y) for _, x, y in toxicity.padded(pa.array([text]))][0]
        found = model.logits(model.rows[words].astype(np.int64), at, model.prepared())[0]
        assert np.isclose(found, plain_logit(model, text), atol=1e-4)


def test_words_that_were_not_seen_share_beginnings():
    rng = np.random.default_rng(8)
    ends = [f"{a}{b}{c}" for a in "abcde" for b in "xyz" for c in "klm"]
    made = lambda some, n: [
        (" ".join([f"w{x}" for x in rng.integers(0, 200, 30)] + [f"zorgel{some[i % len(some)]}"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(n)]
    rows, fresh = made(ends[:30], 400), made(ends[30:], 100)
    model = toxicity.fit([r[0] for r in rows], [r[1] for r in rows], ["xx"] * len(rows))
    found = model.scores(pa.array([r[0] for r in fresh]), model.prepared()) >= 0.5
    assert np.mean(found == np.array([r[1] for r in fresh])) > 0.9


def test_texts_are_learned_up_to_a_number_of_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["some words"] * 50), pa.array([0, 1] * 25), pa.array(["x"] * 50)], ["text", "mark", "lang"])
    assert len(toxicity.sample(iter([batch] * 40), 1000).texts) == 100


def test_scores_do_not_depend_on_blocks():
    rows = corpus(200)
    model = toxicity.fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], epochs=1)
    texts = [r[1] for r in rows] + ["", None, "one", "word " * 400_000]
    whole = model.scores(pa.array(texts), model.prepared())
    single = [model.scores(pa.array([t], pa.string()), model.prepared())[0] for t in texts]
    assert np.allclose(whole, single, atol=1e-5) and ((whole >= 0) & (whole <= 1)).all()


@pytest.mark.parametrize("marks", [[], [0] * 10, [1] * 10])
def test_without_both_labels(marks):
    model = toxicity.fit(["some text"] * len(marks), marks, [None] * len(marks))
    found = model.scores(pa.array(["x", "", None]), model.prepared())
    assert (found >= 0.5).tolist() == [bool(marks and marks[0])] * 3


def test_learn_and_score_tables(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, lang, 1.5) for i, t, lang, _ in rows], "doc_id long, text string, lang string, score double").repartition(4)
    labels = spark.createDataFrame([(i, toxic) for i, _, _, toxic in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, rows=300)
    out = toxicity.score(docs.union(docs.limit(1)), model, keep=["lang", "text"])
    assert out.columns == ["doc_id", "lang", "text", "score", "predicted"] and out.count() == 401
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(docs.limit(0), labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, nothing).collect()} == {0}


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, sf_dir).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [(found[i]["predicted"], m) for i, m in marks.items() if found[i]["held_out"]]
    assert np.mean([p == m for p, m in held]) > 0.95
    assert np.mean([p for p, m in held if m]) > 0.7 and np.mean([p for p, m in held if not m]) < 0.03


def test_folded_text_and_counts():
    points, at = language.folded(["Ab, c1\n\nDé", None, "", "İ ß"])
    parts = ["".join(map(chr, points[at[i] : at[i + 1]])) for i in range(4)]
    assert parts[0] == " ab c dé " and parts[1].strip() == "" and parts[3] == "  ß " or parts[3] == " ß "
    gram, n = language.counted(np.array([32, 97, 98, 97, 98, 32], np.uint32))
    assert n.sum() == 4 + 5 + 4 and len(gram) == 2 + 4 + 4 - 0


def test_nearest_profile():
    texts = {"en": "the cat and the dog and the house " * 5, "es": "el gato y el perro y la casa " * 5}
    known = {}
    for lang, text in texts.items():
        points, _ = language.folded([text])
        known[lang] = language.top(*language.counted(points), language.RANKS)
    rank = language.Ranker(known)
    for lang, text in (("en", "the dog"), ("es", "la casa y el gato")):
        assert rank(*language.counted(language.folded([text])[0]))[0] == lang
    assert rank(*language.counted(language.folded(["123 !"])[0])) == ("und", 0.0)
    assert language.Ranker({})(*language.counted(language.folded(["abc"])[0])) == ("und", 0.0)


def test_identify_table(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "el gato y la casa", "es"), (3, None, "en"), (None, "", None), (5, "???", None), (6, "the " * 200_000, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    known = language.profiles(docs)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, known).collect()}
    assert {i: x for i, (x, _) in found.items()} == {1: "en", 2: "es", 3: "und", None: "und", 5: "und", 6: "en"}
    assert all(0 <= s <= 1 for _, s in found.values())
    assert language.profiles(docs.limit(0)) == {} and language.identify(docs.limit(0), known).count() == 0


@pytest.mark.parametrize("share", [0.0, 1e-12, 3e-7, 0.6, 1.0, 7.0])
def test_sample_bar(share):
    bar = sample_bar(share)
    assert -(1 << 63) <= bar < 1 << 63 and (bar + (1 << 63)) / (1 << 64) == pytest.approx(min(share, 1.0))


def test_samples_are_never_empty(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    known = language.profiles(docs, fitted=1e-5)  # as of 10 million times as many labelled texts
    assert set(known) == {"en", "de"} and all(len(x) for x in known.values())
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, rows=1e-5)
    assert model.weights.any()  # a text of either label was learned


def test_every_language_has_a_profile(spark):
    stems = [a + b + c for a in "bcdfgk" for b in "aeiou" for c in "lmnrst"] + [a + b + c for a in "pqvwxz" for b in "aeiou" for c in "lmnrst"]
    rows = [(i, f"{x}{x} {x} {x}{x[::-1]}", f"l{i:03}") for i, x in enumerate(stems)]  # 360 languages
    docs = spark.createDataFrame([*rows, *[(1000 + i, t, lang) for i, t, lang in rows[:210]]], "doc_id long, text string, lang string")
    known = language.profiles(docs)
    assert set(known) == {r[2] for r in rows}
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, known).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def test_distances_are_those_of_all_ranks():
    rng = np.random.default_rng(8)
    known = {f"l{i}": rng.permutation(900)[: int(rng.integers(0, language.RANKS + 1))] for i in range(30)}
    rank = language.Ranker(known)
    for _ in range(40):
        gram = rng.permutation(1000)[: int(rng.integers(1, 400))]
        count = rng.integers(1, 9, len(gram))
        own = language.top(gram, count, language.OWN).tolist()
        place = {lang: {g: r for r, g in enumerate(x.tolist())} for lang, x in known.items()}
        far = {lang: sum(abs(p[g] - i) if g in p else language.RANKS for i, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(far), key=far.get)
        assert rank(gram, count) == (best, 1 - far[best] / (language.RANKS * len(own)))


def test_thresholds_are_for_the_largest_languages(monkeypatch):
    rows = corpus()
    texts = [r[1] for r in rows] + [" ".join(f"a{i}x{j}" for j in range(20)) for i in range(8) for _ in range(20)]
    marks = [r[3] for r in rows] + [i % 2 for i in range(160)]
    langs = [r[2] for r in rows] + [f"a{i}" for i in range(8) for _ in range(20)]
    monkeypatch.setattr(toxicity, "LANGUAGES", 2)
    model = toxicity.fit(texts, marks, langs, epochs=1)
    spoken = lambda text: [model.spoken(model.rows[w].astype(np.int64), at)[0] for _, w, at in toxicity.padded(pa.array([text]))][0]
    assert [spoken(x) for x in ("und1 und2 und3", "the1 the2 the3", texts[-1], "unheard", "")] == [0, 1, 2, 2, 2]
    assert len(model.limits) == 3


def test_held_out_language(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    found = QUERIES["op6_language"](spark, sf_dir).collect()
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"]]
    assert len(found) == len(langs) and np.mean(held) > 0.98


def test_letters_that_become_several():
    assert language.letter(ord("İ")) == ord("i") and language.letter(ord("1")) == language.BLANK and language.letter(ord("É")) == ord("é")


def test_all_labelled_texts_are_learned_in_parts(spark):
    rows = [(i, None if i == 7 else f"{text} zeldzaam{i % 200}", lang if i % 11 else None, toxic) for i, text, lang, toxic in corpus(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, rows=40)  # 600 texts go to 4 parts
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[3] for r in rows]), pa.array([r[2] for r in rows])], ["text", "mark", "lang"])
    known = toxicity.sample(iter([batch]), 1 << 30)
    assert model.buckets.tolist() == toxicity.known_buckets(known.kinds, known.texts, list(zip(known.langs, known.toxic.tolist()))).tolist()
    whole = toxicity.Model(model.buckets, model.table, model.filters, model.weights, model.bias)
    toxicity._languages(whole, known)
    assert np.allclose(model.languages, whole.languages, atol=1e-5) and len(model.limits) == len(whole.limits)
    fresh = corpus(seed=77)
    found = model.scores(pa.array([r[1] for r in fresh]), model.prepared()) >= 0.5
    assert np.mean(found == np.array([r[3] for r in fresh])) > 0.95


def test_parts_without_both_labels(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c", "en") for i in range(80)], "doc_id long, text string, lang string")
    for mark in (0, 1):
        labels = docs.selectExpr("doc_id", f"{mark} toxic")
        model = toxicity.learn(docs, labels, rows=32)
        assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {mark}


def test_more_bytes_than_one_task_learns_from_are_dealt(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, most=4000)
    words = {w for r in rows if r[3] for w in r[1].split() if not w.islower()}
    held = [toxicity.Model.rows.func(model)[b] for _, x, _ in toxicity.padded(pa.array(sorted(words))) for b in x[x[:, 0] >= 0, 0]]
    assert len(held) == len(words) and all(held)


def test_counted_logits_have_the_limits_of_single_ones():
    rng = np.random.default_rng(4)
    logit, toxic = np.round(rng.normal(0, 2, 500), 1), (rng.random(500) < 0.3).astype(float)
    toxic[logit > 1] = 1
    kinds, which = np.unique(logit, return_inverse=True)
    single = toxicity._best_limit(logit, toxic, 1 - toxic)
    assert toxicity._best_limit(kinds, np.bincount(which, toxic), np.bincount(which, 1 - toxic)) == single


def test_weights_move_by_changes_side_by_side():
    model = toxicity._begun(np.arange(5), 10, 4, np.random.default_rng(1))
    seen = toxicity._unmoved(model)
    was = toxicity._flat(model, seen)
    toxicity._move(model, seen, np.ones_like(was))
    n = 6 * toxicity.SIZE + sum(x.size for x in model.filters) + len(model.weights) + 1  # what follows fills the last row
    assert np.allclose(toxicity._flat(model, seen)[:, : toxicity.SIZE].ravel()[:n], was[:, : toxicity.SIZE].ravel()[:n] + 1)
    assert np.isclose(model.bias, 1) and np.allclose(seen.weights, 1) and [x.shape for x in model.filters] == [x.shape for x in seen.filters]
