import numpy as np
import pytest

from conftest_words import words
from probeline.llm import mixing
from probeline.llm.queries import QUERIES


def test_targets():
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, None: 0}) == {"a": 0.0, None: 0.0}
    assert mixing.targets({"b": 10, "a": 10, None: 10}) == {"a": 5.0, "b": 10.0, None: 15.0}
    assert mixing.targets({"a": 1000, "b": 1, "c": 1000}) == {"a": (2001 - 3) / 4, "b": 3.0, "c": (2001 - 3) * 3 / 4}
    assert sum(mixing.targets({"a": 1, "b": 1, "c": 100, "d": 7}).values()) == pytest.approx(109)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    one, two = (mixing.permuted(np.arange(n), n, key) for key in ("a", "b"))
    assert sorted(one.tolist()) == list(range(n))
    assert n < 10 or one.tolist() != two.tolist()


def corpus(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        source = ("web", "web", "web", "book", None, "tiny")[int(rng.integers(0, 6)) if i % 50 else 5] if i < 390 else "web"
        n = int(rng.integers(0, 400)) if source != "tiny" else 40
        rows.append((i, " ".join(f"w{j}" for j in range(n)) if i % 37 else None, source, n, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string").repartition(7), rows


def test_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 64)
    docs, rows = corpus(spark)
    found = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes, taken = {}, {}
    for i, text, source, *_ in rows:
        n = len(words(text))
        assert found[i]["size"] == n and 0 <= found[i]["taken"] <= 3 * n
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + found[i]["taken"]
    goal = mixing.targets(sizes)
    for i, _, source, *_ in rows:
        assert (found[i]["source_size"], found[i]["target"]) == (sizes[source], pytest.approx(goal[source]))
    assert all(abs(taken[s] - goal[s]) <= max(0.03 * goal[s], 400) for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {i: r["taken"] for i, r in found.items()}


def test_small_sources_reach_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 64)
    small = {f"s{i:02}": (1, 10, 40)[i % 3] for i in range(30)}
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(n), x) for i, (x, n) in enumerate(small.items())] + [(100 + i, text(200), "web") for i in range(100)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    for r in found:
        if r["doc_id"] < 100:  # all are below the share of their weight, so three times their size is the target
            assert r["target"] == 3 * r["size"] and r["taken"] == pytest.approx(r["target"], rel=0.05)
    assert sum(r["taken"] for r in found) == pytest.approx(20_000 + sum(small.values()), rel=0.01)


@pytest.mark.parametrize("sizes", [{"a": 7}, {"a": 1000, "b": 1, None: 10}, {f"s{i}": 1 + i % 5 for i in range(400)}, {"hot": 90_000, "t": 40, "u": 10, "v": 1}])
def test_slots_add_up(spark, monkeypatch, sizes):
    monkeypatch.setattr(mixing, "SHARD", 64)
    goal = mixing.targets(sizes)
    found = mixing.slots(spark, sizes, goal).groupBy("shard", "source").count().collect()
    shards, taken = {}, dict.fromkeys(sizes, 0)
    for r in found:
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["count"]
        taken[r["source"]] += r["count"]
    assert all(n == 64 for shard, n in shards.items() if shard != max(shards)) and sorted(shards) == list(range(len(shards)))
    for x, size in sizes.items():
        blocks = -(-size // mixing.width_of(size))
        assert abs(taken[x] - goal[x] * blocks / size) < 1 + 1e-6 and taken[x] <= mixing.REPEATS * blocks


def test_rounded_keeps_sums():
    share = np.tile([0.5, 1.0, 1.5], 1000)
    found = mixing.rounded(share, 3)
    assert (np.abs(found - share) < 1).all() and abs(found.sum() - 3000) < 2 and 400 < found[::3].sum() < 600


def test_documents_hold_the_taken_words(spark):
    docs, rows = corpus(spark)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs, size_col="size")
    assert out.columns == docs.columns
    total = dict.fromkeys(taken, 0)
    texts = {r[0]: words(r[1]) for r in rows}
    for r in out.collect():
        mine = words(r["text"])
        total[r["doc_id"]] += len(mine)
        whole = iter(texts[r["doc_id"]])
        assert mine and all(w in whole for w in mine) and r["size"] == len(r["text"])
    assert total == taken


def test_empty_repeated_and_null_rows(spark):
    kind = "source string, text string, doc_id long"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], kind)).count() == 0
    docs = spark.createDataFrame([("a", "one two three", 1), ("a", "one two three", 1), (None, None, None), (None, "x y", None)], kind)
    found = mixing.mix(docs).collect()
    assert len(found) == 4 and sorted(r["size"] for r in found) == [0, 2, 3, 3]
    assert sum(len(words(r["text"])) for r in mixing.mixed_documents(docs).collect()) == sum(r["taken"] for r in found)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in QUERIES["op1_mixing"](spark, sf_dir).collect()}
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    goal = mixing.targets(sizes)
    for r in docs:
        mine = found[r["doc_id"]]
        assert (mine["size"], mine["source_size"], mine["target"]) == (len(words(r["text"])), sizes[r["source"]], pytest.approx(goal[r["source"]]))
        assert mine["taken"] <= 3 * mine["size"]
    assert sum(r["taken"] for r in found.values()) == pytest.approx(sum(goal.values()), rel=0.01)


def test_taken_against_a_plain_walk(spark, monkeypatch):
    """Every slot lays its block's words out one by one; the counts of a document's words are what the query returns."""
    monkeypatch.setattr(mixing, "SHARD", 64)
    docs, _ = corpus(spark)
    where, sizes, goal, filled = mixing.plan(docs, "doc_id", "text", "source", (1, 2, 3), 0)
    times = {x: np.zeros(n, np.int64) for x, n in sizes.items()}
    rounds = {}
    for r in filled.collect():
        width = mixing.width_of(sizes[r["source"]])
        times[r["source"]][r["block"] * width : (r["block"] + 1) * width] += 1
        rounds.setdefault((r["source"], r["round"]), []).append(r["block"])
    for (source, turn), blocks in rounds.items():
        many = -(-sizes[source] // mixing.width_of(sizes[source]))
        assert len(set(blocks)) == len(blocks) and (turn == 0 or len(rounds[source, turn - 1]) == many)
    wanted = {r["_id"]: int(times[r["source"]][r["start"] : r["start"] + r["size"]].sum()) for r in where.collect()}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()} == wanted
