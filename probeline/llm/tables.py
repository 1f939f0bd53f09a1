"""Working tables and lineage cuts in the shared folder, and small helpers that several operators use."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.session import parallelism as partitions
from probeline.session import scratch_path, shared_dir

WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed into the shared checkpoint folder, so that no lost executor can undo it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sample_bar(share: float) -> int:
    """The 64-bit hash up to which ``share`` of all hashes lie; a sample takes what is not above."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def hand_back() -> None:
    """Give memory that a task has freed back to the system: its worker may wait for the next task for long, beside others.
    Does nothing where the C library has no way to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over the batches of a task, with its memory given back at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        hand_back()

    return tidied


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


__all__ = ["LOWER", "UPPER", "WORD_BREAK", "cut", "hand_back", "partitions", "sample_bar", "text_of", "tidy", "word_list", "written"]
