"""Fixed-width vector files as a data source (S1–S3): a record is a 4-byte header with the width, then ``width`` values.

The reader plans byte ranges from file lengths alone; a task seeks to its range and turns blocks of records into Arrow
batches, so there is no object per record and no pass to count. The id of a vector is its position over all files, hence a
filter on the id becomes a shorter list of ranges: a prefix reads only its own bytes.

The writer lets each task write a file of its own below ``_staging``. When all have ended, the files are ordered by their
first id, moved to their names, and listed in a manifest that is put in place last; readers see what the manifest lists. A
task or job that fails leaves the manifest as it was; its files are removed, and what a task that outlives its job puts
there later is never listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20  # bytes of a range at most, about
READ_BYTES = 4 << 20  # bytes that are decoded at once
MANIFEST = "_manifest.json"
KINDS = {"float": ("<f4", pa.float32()), "int": ("<i4", pa.int32())}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path names, and the path within it. A local path is taken as it stands, odd characters included."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if "://" not in path else fs.FileSystem.from_uri(path)


def data_files(path: str) -> list[tuple[str, int]]:
    """Files and lengths in order: those of the manifest, else all visible ones by name, or the one file itself."""
    store, root = located(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = manifest(path)
    if names is None:
        found = store.get_file_info(fs.FileSelector(root))
        return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return [(x.path, x.size) for x in store.get_file_info([f"{root}/{n}" for n in names])]


def manifest(path: str) -> list[str] | None:
    """File names in order; None without a manifest."""
    store, root = located(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{MANIFEST}") as stream:
        return json.loads(stream.read())["files"]


@dataclass
class Range(InputPartition):
    """``count`` records of a file from record ``skip`` on; the first has the id ``first``."""

    path: str
    skip: int
    count: int
    first: int


def ranges(files: Sequence[tuple[str, int]], record: int, low: int, high: int | None, size: int = RANGE_BYTES) -> list[Range]:
    """Ranges that hold the ids from ``low`` up to ``high`` (exclusive)."""
    step, found, base = max(1, size // record), [], 0
    for path, length in files:
        if length % record:
            raise ValueError(f"{path} has {length} bytes, not a multiple of the record's {record}")
        end = base + length // record
        begin, stop = max(low, base), end if high is None else min(high, end)
        found += [Range(path, at - base, min(step, stop - at), at) for at in range(begin, stop, step)]
        base = end
    return found


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])
        self.kind, self.id, self.values = options.get("kind", "float"), options.get("id", "vec_id"), options.get("values", "embedding")
        self.record, self.low, self.high = 4 + 4 * self.width, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the id; other filters stay with Spark."""
        for f in filters:
            name = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if name != (self.id,) or not isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual, EqualTo, In, IsNotNull)):
                yield f
            elif isinstance(f, In):
                known = [x for x in f.value if x is not None]
                self._narrow(min(known, default=0), max(known, default=-1) + 1)
                yield f
            elif not isinstance(f, IsNotNull):
                low = value if isinstance(f, (GreaterThanOrEqual, EqualTo)) else value + 1 if isinstance(f, GreaterThan) else None
                high = value if isinstance(f, LessThan) else value + 1 if isinstance(f, (LessThanOrEqual, EqualTo)) else None
                self._narrow(low, high)

    def _narrow(self, low: int | None, high: int | None) -> None:
        self.low = self.low if low is None else max(self.low, low)
        self.high = self.high if high is None else high if self.high is None else min(self.high, high)

    def partitions(self) -> Sequence[InputPartition]:
        return ranges(data_files(self.path), self.record, self.low, self.high)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = located(self.path)
        number, arrow = KINDS[self.kind]
        layout = np.dtype([("header", "<i4"), ("values", number, (self.width,))])
        step = max(1, READ_BYTES // self.record)
        with store.open_input_file(partition.path) as stream:
            stream.seek(partition.skip * self.record)
            for begin in range(0, partition.count, step):
                found = np.frombuffer(stream.read(min(step, partition.count - begin) * self.record), layout)
                if (found["header"] != self.width).any():
                    raise ValueError(f"record header differs from the expected width {self.width}")
                ids = np.arange(len(found), dtype=np.int64) + partition.first + begin
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * self.width)
                values = pa.ListArray.from_arrays(ends, pa.array(found["values"].reshape(-1), arrow))
                yield pa.RecordBatch.from_arrays([pa.array(ids), values], names=[self.id, self.values])


@dataclass
class Written(WriterCommitMessage):
    """A staged file, its first id and its number of records; no file where a task had no rows."""

    name: str
    first: int
    count: int


class Writer(DataSourceArrowWriter):
    """Rows (id, values) that come in order of the id, and in ranges of it, become files in that order."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.width, self.kind, self.overwrite = options["path"], int(options["width"]), options.get("kind", "float"), overwrite
        self.job = uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{located(self.path)[1]}/_staging/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = located(self.path)
        name, first, count, last, stream = uuid.uuid4().hex, 0, 0, None, None
        number, _ = KINDS[self.kind]
        layout = np.dtype([("header", "<i4"), ("values", number, (self.width,))])
        for batch in iterator:
            ids, values = batch.column(0), batch.column(1)
            if not batch.num_rows:
                continue
            if ids.null_count or values.null_count or values.flatten().null_count or (np.diff(values.offsets.to_numpy()) != self.width).any():
                raise ValueError(f"every row needs an id and {self.width} values; leave others out before")
            order = ids.to_numpy()
            if (np.diff(order) <= 0).any() or (last is not None and order[0] <= last):
                raise ValueError("rows have to come in order of distinct ids")
            if stream is None:
                store.create_dir(self._staging(), recursive=True)
                stream, first = store.open_output_stream(f"{self._staging()}/{name}"), int(order[0])
            rows = np.empty(batch.num_rows, layout)
            rows["header"] = self.width
            rows["values"] = values.flatten().to_numpy().reshape(-1, self.width)
            stream.write(rows.tobytes())
            count, last = count + len(rows), order[-1]
        if stream is not None:
            stream.close()
        return Written(name, first, count)

    def commit(self, messages: list[Written | None]) -> None:
        """Runs once, after all tasks: the manifest is what makes their files part of the data."""
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        names = [] if self.overwrite else manifest(self.path) or []
        for m in sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first):
            names.append(f"part-{self.job}-{len(names):06d}")
            store.move(f"{self._staging()}/{m.name}", f"{root}/{names[-1]}")
        with store.open_output_stream(f"{root}/_next-{self.job}") as stream:
            stream.write(json.dumps({"files": names, "width": self.width, "kind": self.kind}).encode())
        store.move(f"{root}/_next-{self.job}", f"{root}/{MANIFEST}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _ = located(self.path)
        if store.get_file_info(self._staging()).type == fs.FileType.Directory:
            store.delete_dir(self._staging())


class VectorFiles(DataSource):
    """``spark.read.format("vectorfile")``; options ``width``, ``kind`` (float or int), ``id`` and ``values`` (column names)."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        kind = self.options.get("kind", "float")
        return f"{self.options.get('id', 'vec_id')} bigint, {self.options.get('values', 'embedding')} array<{kind}>"

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)
