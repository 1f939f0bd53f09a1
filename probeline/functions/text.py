"""Column forms of labels, tags, tails and path parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The run-id pattern in console text, the dataset prefix left out of labels, the procedures
# that need a vector count, and the order of the tag keys.
UUID_PATTERN = r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
LABEL_PREFIX = "cohere-"
COUNTED_PROCEDURES = ("bulk-ingest-data", "vector-search")
TAG_KEYS = (
    "dataset", "engine", "num_vectors", "dimension", "space_type", "query_k", "ef_search", "search_clients",
    "method_name",
)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_uuid(c: Column | str) -> Column:
    """The first run id in a console text, null when there is none."""
    return F.nullif(F.regexp_extract(_column(c), f"({UUID_PATTERN})", 1), F.lit(""))


def text_tail(c: Column | str, n: int = 5000) -> Column:
    """P10: the last ``n`` characters, '' for null."""
    return F.right(F.coalesce(_column(c), F.lit("")), F.lit(n))


def user_tags(values: Mapping[str, Column]) -> Column:
    """``key:value`` pairs joined by commas in a fixed key order, nulls left out."""
    pairs = [
        F.when(values[k].isNotNull(), F.concat(F.lit(f"{k}:"), values[k].cast("string"))) for k in TAG_KEYS if k in values
    ]
    return F.concat_ws(",", *pairs)


def step_label(dataset: Column, corpus_size: Column, procedure: Column, query_k: Column) -> Column:
    """Short dataset, size and procedure, with ``-k<query_k>`` when set. A missing size leaves an empty part."""
    short = F.regexp_replace(dataset, f"^{LABEL_PREFIX}", "")
    base = F.concat_ws("-", short, F.coalesce(corpus_size, F.lit("")), procedure)
    k = F.coalesce(query_k.cast("string"), F.lit(""))
    return F.when(k != "", F.concat(base, F.lit("-k"), k)).otherwise(base)


def sweep_name(path: Column | str) -> Column:
    """The ``sweep-…`` segment that ends a result path, null when the last segment is another one."""
    return F.nullif(F.regexp_extract(_column(path), r"(?:^|/)(sweep-[^/]*)/?$", 1), F.lit(""))
