"""Ordered computations inside a key, without putting a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts a key in a single task, so a key that owns a third of the rows
sets the run time of the job. A timeline counts the rows per key first. Keys of more than ``ROWS_PER_SLICE`` rows are
hot: the order column is cut at quantiles of their rows, into as many slices as those rows need, so that a ``(key,
slice)`` group holds at most about ``ROWS_PER_SLICE`` rows; all other keys are one slice. Window functions run inside
the slices; what crosses a slice border (the last row, a running total) is one small row per slice of a hot key that is
joined back. The large side is shuffled once, by ``(key, slice)``. That shuffle is asked for explicitly: rows that
arrive partitioned by the key alone would satisfy the window as they are, hot key included. Without hot keys all this
is a plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
ROWS_PER_SLICE = 1_000_000
_AT = "_slice_at"
_HOT = "_hot_key"


def _sort_number(df: DataFrame, name: str) -> Column:
    """The order column as a double (timestamps as microseconds, exact below 2^53)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def slice_bounds(df: DataFrame, order: str, slices: int) -> list[float]:
    """Quantiles of ``order``: one column-pruned aggregate that returns at most ``slices - 1`` numbers."""
    if slices <= 1:
        return []
    shares = [i / slices for i in range(1, slices)]
    accuracy = min(2**31 - 1, max(10_000, 10 * slices))
    found = df.select(_sort_number(df, order).alias(_AT)).agg(F.percentile_approx(_AT, shares, accuracy).alias("q")).first()
    return sorted(set(found["q"] or []))


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int) -> pa.Table:
    """Keys of more than ``rows`` rows with their counts ``n``; there are fewer of them than ``count / rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows).toArrow()


class Timeline:
    """Rows of ``df`` ordered by ``order`` within ``keys``.

    ``order[0]`` must be a number or a timestamp of many values; the remaining columns break ties. By default only hot
    keys are cut, into as many slices as their rows need. ``slices`` sets the number for all keys, ``bounds`` the cut
    points. A null key is an error.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        slices: int | None = None,
        bounds: Sequence[float] | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        hot = None
        if bounds is None and slices is not None:
            bounds = slice_bounds(df, self.order[0], slices)
        elif bounds is None:
            found = hot_keys(df, self.keys, ROWS_PER_SLICE)
            bounds = []
            if found.num_rows:
                hot = df.sparkSession.createDataFrame(found.select(self.keys)).withColumn(_HOT, F.lit(True))
                needed = math.ceil(sum(found.column("n").to_pylist()) / ROWS_PER_SLICE)
                bounds = slice_bounds(df.join(F.broadcast(hot.drop(_HOT)), self.keys, "left_semi"), self.order[0], needed)
        self.cut, self.placed = bool(bounds), False
        present = {
            k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"timeline key {k} is null"))).otherwise(F.col(k))
            for k in self.keys
        }
        if not self.cut:
            self.df = df.withColumns(present)
            return
        cuts = Bucketizer(
            splits=[float("-inf"), *bounds, float("inf")], inputCol=_AT, outputCol=SLICE, handleInvalid="keep"
        )
        df = cuts.transform(df.withColumn(_AT, _sort_number(df, self.order[0]))).drop(_AT)
        place = F.coalesce(F.col(SLICE).cast("int"), F.lit(-1))
        if hot is not None:
            df = df.join(F.broadcast(hot), self.keys, "left")
            place = F.when(F.col(_HOT), place).otherwise(F.lit(0))
        self.df = df.withColumns({SLICE: place, **present}).drop(_HOT)

    def _with(self, df: DataFrame) -> Timeline:
        out = object.__new__(Timeline)
        out.keys, out.order, out.cut, out.placed, out.df = self.keys, self.order, self.cut, self.placed, df
        return out

    def _place(self) -> DataFrame:
        """The rows partitioned by (key, slice)."""
        return self.df if self.placed else self.df.repartition(*self._group)

    @property
    def _group(self) -> list[str]:
        return [*self.keys, SLICE] if self.cut else self.keys

    @property
    def _local(self):
        return Window.partitionBy(*self._group).orderBy(*self.order)

    @property
    def _across(self):
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def map(self, fn) -> Timeline:
        """Apply a row-wise DataFrame function (``withColumn`` and the like)."""
        return self._with(fn(self.df))

    def previous(self, columns: Mapping[str, str], number: str | None = None, total: str | None = None) -> Timeline:
        """Add ``{new: source}`` columns holding the previous row's value.

        ``number`` names a column for the 1-based row number, ``total`` one for the row count of the key.
        """
        local = self._local
        if not self.cut:
            added = {name: F.lag(source).over(local) for name, source in columns.items()}
            if number:
                added[number] = F.row_number().over(local).cast("long")
            if total:
                added[total] = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
            return self._with(self.df.withColumns(added))
        sources = sorted(set(columns.values()))
        across = self._across
        aggs = [F.count(F.lit(1)).alias("_n")]
        carried = [*self.keys, SLICE]
        added = {}
        if sources:
            aggs.append(F.max_by(F.struct(*sources), F.struct(*self.order)).alias("_tail"))
            carried.append(F.lag("_tail").over(across).alias("_carry"))
            added["_lag"] = F.lag(F.struct(*sources)).over(local)
        if number:
            before = across.rowsBetween(Window.unboundedPreceding, -1)
            carried.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
            added["_rn"] = F.row_number().over(local)
        if total:
            carried.append(F.sum("_n").over(Window.partitionBy(*self.keys)).alias("_total"))
        border = self.df.groupBy(*self._group).agg(*aggs).select(*carried)
        df = self._rejoin(self._place().withColumns(added), border)
        final = {name: F.coalesce("_lag", "_carry")[source] for name, source in columns.items()}
        if number:
            final[number] = (F.col("_before") + F.col("_rn")).cast("long")
        if total:
            final[total] = F.col("_total")
        working = [c for c in ("_lag", "_carry", "_before", "_rn", "_total") if c not in final]
        return self._placed(df.withColumns(final).drop(*working))

    def running(self, outputs: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> Timeline:
        """Add running ``sum`` / ``max`` / ``min`` columns, up to the row itself or (exclusive) to the row before."""
        fold = {"sum": F.sum, "max": F.max, "min": F.min}
        local = self._local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        here = {name: fold[how](column).over(local) for name, (how, column) in outputs.items()}
        if not self.cut:
            return self._with(self.df.withColumns(here))
        before = self._across.rowsBetween(Window.unboundedPreceding, -1)
        border = self.df.groupBy(*self._group).agg(
            *[fold[how](column).alias(f"_{name}_t") for name, (how, column) in outputs.items()]
        )
        border = border.select(
            *self._group,
            *[fold[how](f"_{name}_t").over(before).alias(f"_{name}_c") for name, (how, _) in outputs.items()],
        )
        df = self._rejoin(self._place().withColumns(here), border)
        both = {}
        for name, (how, _) in outputs.items():
            own, carry = F.col(name), F.col(f"_{name}_c")
            if how == "sum":
                both[name] = F.coalesce(own + carry, own, carry)
            else:
                both[name] = (F.greatest if how == "max" else F.least)(own, carry)
        return self._placed(df.withColumns(both).drop(*[f"_{name}_c" for name in outputs]))

    def _placed(self, df: DataFrame) -> Timeline:
        out = self._with(df)
        out.placed = True
        return out

    def _rejoin(self, df: DataFrame, border: DataFrame) -> DataFrame:
        renamed = border.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self._group)],
            *[c for c in border.columns if c not in self._group],
        )
        match = F.lit(True)
        for i, k in enumerate(self._group):
            match = match & (df[k] == renamed[f"_k{i}"])
        return df.join(renamed, match, "left").drop(*[f"_k{i}" for i in range(len(self._group))])

    def run_positions(self, value: str, position: str = "run_pos", initial: DataFrame | None = None) -> Timeline:
        """Add the 1-based position of each row inside its run of equal ``value`` (gaps and islands).

        ``initial`` carries the run that was open when earlier data ended: keys, ``value`` and its length ``position``.
        A key's first run here goes on from there if the value is the same.
        """
        numbered = self.previous({"_pv": value}, number="_no")
        same = F.col(value).eqNullSafe(F.col("_pv")) & (F.col("_no") > 1)
        started = numbered.running({"_start": ("max", F.when(~same, F.col("_no")))})
        place = F.col("_no") - F.col("_start") + 1
        if initial is not None:
            opened = initial.select(*self.keys, F.struct(F.col(value).alias("v"), F.col(position).alias("n")).alias("_open"))
            started = started.map(lambda d: d.join(opened, self.keys, "left"))
            goes_on = (F.col("_start") == 1) & F.col("_open").isNotNull() & F.col(value).eqNullSafe(F.col("_open")["v"])
            place = place + F.when(goes_on, F.col("_open")["n"]).otherwise(F.lit(0))
        return started.map(
            lambda d: d.withColumn(position, place.cast("bigint")).drop("_pv", "_no", "_start", "_open")
        )

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, slices: int | None = None) -> DataFrame:
    """``row_number`` within ``keys`` that survives a hot key."""
    return Timeline(df, keys, order, slices).previous({}, number=name).result()


def chunked_lists(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], chunk_rows: int = 1000,
    items: str = "items", slices: int | None = None,
) -> DataFrame:
    """Ordered lists of ``fields`` per key, cut into numbered chunks of at most ``chunk_rows`` items.

    Chunk 0, 1, 2 … concatenated are the full list, and no task ever gathers more than a chunk.
    """
    rows = numbered(df, keys, order, "_rn", slices)
    rows = rows.withColumn("chunk", F.floor((F.col("_rn") - 1) / F.lit(chunk_rows)).cast("long"))
    packed = rows.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("_rn", *fields))).alias("_items")
    )
    return packed.select(
        *keys, "chunk", F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(items)
    )
