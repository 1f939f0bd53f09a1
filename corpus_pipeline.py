"""A training-data pipeline in five stages: documents in, token ids out.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeline.llm import mixing, near, secrets, tokens, toxicity
from probeline.llm.queries import held_out, table
from probeline.llm.tables import written

VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in short batches, unless the session sets its own: texts are long rows, and workers of
    earlier stages may still hold memory."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic; it learns from the labels outside the held-out fold."""
    short_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    scored = toxicity.score(docs, model, keep=[c for c in docs.columns if c != "doc_id"])
    return scored.filter("predicted = 0").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that the n-gram Jaccard join links."""
    return near.distinct_documents(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every found secret by a mark."""
    return secrets.redacted(docs, size_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the words that the mix of sources takes: a row per document and round of its source."""
    return mixing.mixed_documents(docs, size_col="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the bytes they decode to."""
    ranks = tokens.read_ranks(public_tokenizers.path(VOCABULARY))
    found = tokens.decode(tokens.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("jaccard", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("tokens", encoded),
]

#: SQL cannot state the classifier, the mix or the tokens; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
