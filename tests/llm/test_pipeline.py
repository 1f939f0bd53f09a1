import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from conftest_words import words
from probeline.llm import mixing, secrets, tokens
from probeline.llm.tables import written
from test_near import brute

SF_DIR = "/root/testdata/sf0.001"


def masked(text):
    spans = sorted(
        (m.start(), m.end()) for rule in secrets.BASE + secrets.MORE for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least
    )
    out, at = [], 0
    for i, (start, end) in enumerate(spans):
        if start >= at or i == 0:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF_DIR), name))
    assert all(t.columns == columns for t in tables[:-1])
    before, clean, alone, hidden, mix, ids = ([r.asDict() for r in t.collect()] for t in tables)
    assert {r["doc_id"] for r in clean} < {r["doc_id"] for r in before} and len(clean) > 0.8 * len(before)

    groups = brute([(r["doc_id"], r["text"]) for r in clean])
    assert sorted(r["doc_id"] for r in alone) == sorted({place for _, place in groups.values()})

    texts = {r["doc_id"]: r["text"] for r in alone}
    assert {r["doc_id"]: r["text"] for r in hidden} == {i: masked(t) for i, t in texts.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in hidden)

    sizes, taken = {}, {}
    for r in hidden:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mix:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    goal = mixing.targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= max(0.05 * goal[s], 200) for s in goal)

    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for r in mix:
        packed = np.array(reference.encode_ordinary(r["text"]), "<u4").tobytes()
        wanted.append((r["doc_id"], len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert sorted(wanted) == sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in ids)


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert "ids_sha256" in found.columns and found.count() > 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), f"empty-{name}")
        assert docs.count() == 0
