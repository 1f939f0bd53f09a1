import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from probeline.llm import tokens
from probeline.llm.queries import QUERIES

RANKS = tokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(texts):
    encode = tokens.Encoder(tokens.Merger(RANKS), public_tokenizers.PATTERN)
    return [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]


@pytest.mark.parametrize(
    "text",
    ["", "a", "a" * 5000, "ab" * 3001, " \t\n\r\x0b\x0c  x  ", "x" + " " * 999, "<|endoftext|>", "日本語" * 50, "👩‍👩‍👧" * 20, "I'm WE'LL 's", "\x1c\x85\u3000  x", "\x00\x01"],
)
def test_as_the_library_does(text):
    assert ids([text]) == [REFERENCE.encode_ordinary(text)]


def test_random_texts():
    rng = random.Random(5)
    ranges = [(32, 127), (160, 0x500), (0x3000, 0xD000), (0x10000, 0x20000)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(300))) for _ in range(200)]
    assert ids(texts) == [REFERENCE.encode_ordinary(x) for x in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    encode = tokens.Encoder(tokens.Merger(RANKS), public_tokenizers.PATTERN)
    for text in ("some words here and there", "other words here"):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_round_trip_nulls_repeats_and_clashes(spark):
    rows = [(1, "one two", 5, "x"), (1, "one two", 5, "x"), (None, None, None, None), (3, "", 1, "y"), (4, "long " * 100_000, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    found = tokens.decode(tokens.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in found) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert tokens.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_bpe"](spark, sf_dir).collect()}
    wanted = {}
    for i, text in texts.items():
        codes = REFERENCE.encode_ordinary(text)
        packed = np.array(codes, "<u4").tobytes()
        wanted[i] = (len(codes), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert found == wanted
