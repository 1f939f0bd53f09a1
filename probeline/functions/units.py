"""Column forms of quantity, size, time and status text.

Text that cannot be read gives null, except where a fallback value is part of the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INT = r"^\s*[+-]?[0-9]+\s*$"

# The count taken for a size text that cannot be read, and the two readiness states.
DEFAULT_COUNT = 1_000_000
READY_STATES = ("green", "yellow")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: Column) -> Column:
    """Plain decimal text as DOUBLE, anything else null."""
    return F.when(c.rlike(_FLOAT), F.trim(c).try_cast("double"))


def as_long(c: Column) -> Column:
    """Plain integer text as LONG, anything else null."""
    return F.when(c.rlike(_INT), F.trim(c).try_cast("bigint"))


def _head(c: Column, drop: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - F.lit(drop))


def _cut(c: Column) -> Column:
    """Truncation toward zero to LONG."""
    return c.try_cast("bigint")


def corpus_to_count(c: Column | str, strict: bool = False) -> Column:
    """``1m`` → 1000000, ``1.5k`` → 1500; unreadable text counts as a million.

    ``strict`` is P1b: only ``<digits>m`` or ``<digits>k`` is accepted and the rest is null, for the caller to reject.
    """
    c = _column(c).cast("string")
    if strict:
        digits = _head(c, 1).try_cast("bigint")
        return F.when(c.rlike(r"^[0-9]+m$"), digits * 1_000_000).when(c.rlike(r"^[0-9]+k$"), digits * 1_000)
    text = F.lower(F.trim(c))
    scaled = lambda unit: _cut(as_double(_head(text, 1)) * F.lit(float(unit)))
    value = (
        F.when(text.endswith("b"), scaled(1_000_000_000))
        .when(text.endswith("m"), scaled(1_000_000))
        .when(text.endswith("k"), scaled(1_000))
        .otherwise(as_long(text))
    )
    return F.coalesce(value, F.lit(DEFAULT_COUNT).cast("bigint"))


def count_to_corpus(c: Column | str) -> Column:
    """50000 → ``50k``; halves go to the even neighbour (2500000 → ``2m``)."""
    c = _column(c)
    short = lambda unit, mark: F.concat(
        F.bround(c / F.lit(float(unit)), 0).cast("bigint").cast("string"), F.lit(mark)
    )
    return (
        F.when(c >= 1_000_000_000, short(1_000_000_000, "b"))
        .when(c >= 1_000_000, short(1_000_000, "m"))
        .when(c >= 1_000, short(1_000, "k"))
        .otherwise(c.cast("string"))
    )


def cpu_cores(c: Column | str) -> Column:
    """``188m`` → 0.188, ``2`` → 2.0, empty → 0."""
    c = _column(c)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0))
        .when(c.endswith("m"), as_double(_head(c, 1)) / 1000.0)
        .when(c.endswith("n"), as_double(_head(c, 1)) / 1000000000.0)
        .otherwise(as_double(c))
    )


def cpu_millicores(c: Column | str) -> Column:
    """Integer millicores; nano values floor, plain cores truncate."""
    c = _column(c)
    return (
        F.when(c.endswith("m"), as_long(_head(c, 1)))
        .when(c.endswith("n"), F.floor(as_long(_head(c, 1)) / F.lit(1000000)).cast("bigint"))
        .otherwise(_cut(as_double(c) * 1000.0))
    )


def mem_mib(c: Column | str) -> Column:
    """P5: MiB as DOUBLE. A bare number is returned unscaled (kept on purpose, see P6)."""
    c = _column(c)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0))
        .when(c.endswith("Ki"), as_double(_head(c, 2)) / 1024.0)
        .when(c.endswith("Mi"), as_double(_head(c, 2)))
        .when(c.endswith("Gi"), as_double(_head(c, 2)) * 1024.0)
        .otherwise(as_double(c))
    )


def mem_kib(c: Column | str) -> Column:
    """KiB as LONG. A bare number contributes nothing (kept on purpose, see P5)."""
    c = _column(c)
    return (
        F.when(c.endswith("Ki"), as_long(_head(c, 2)))
        .when(c.endswith("Mi"), as_long(_head(c, 2)) * 1024)
        .when(c.endswith("Gi"), as_long(_head(c, 2)) * 1024 * 1024)
        .otherwise(F.lit(0).cast("bigint"))
    )


def run_ts(c: Column | str) -> Column:
    """The first 15 characters of a run id as a UTC time in any session, null when they are not one."""
    text = F.substring(_column(c), 1, 15)
    part = lambda start, size: F.substring(text, start, size).try_cast("int")
    fields = [part(1, 4), part(5, 2), part(7, 2), part(10, 2), part(12, 2), part(14, 2).cast("decimal(8,6)")]
    whole = text.rlike(r"^[0-9]{8}-[0-9]{4}[0-5][0-9]$")
    return F.when(whole, F.try_make_timestamp(*fields, F.lit("UTC")))


def is_ready(c: Column | str) -> Column:
    """A cluster answers requests in these two states."""
    return F.coalesce(_column(c).isin(*READY_STATES), F.lit(False))


def record_bytes(dimension: Column | int) -> Column:
    """Width of a fixed-width vector record: a 4-byte header and 4 bytes per component."""
    d = dimension if isinstance(dimension, Column) else F.lit(dimension)
    return F.lit(4).cast("bigint") + d.cast("bigint") * 4


def expected_bytes(count: Column, dimension: Column | int) -> Column:
    """File size of ``count`` vectors."""
    return count.cast("bigint") * record_bytes(dimension)


def byte_range(count: Column, dimension: Column | int) -> Column:
    """The byte range text that covers ``count`` vectors."""
    return F.concat(F.lit("0-"), (expected_bytes(count, dimension) - 1).cast("string"))


def range_bytes(c: Column | str) -> Column:
    """``start-end`` text to a size; null when there is no readable range."""
    parts = F.split(_column(c), "-")
    size = as_long(parts.getItem(1)) - as_long(parts.getItem(0)) + 1
    return F.when(F.size(parts) == 2, size)


def run_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds between two times, half a second rounds up."""
    micros = F.unix_micros(_column(end).cast("timestamp")) - F.unix_micros(_column(start).cast("timestamp"))
    return F.floor(micros / 1_000_000.0 + 0.5).cast("bigint")


def run_duration(start: Column | str, end: Column | str) -> Column:
    """``Xm Ys``; a missing or zero duration shows ``N/A``."""
    s = run_seconds(start, end)
    shown = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))
    return F.when(F.coalesce(s, F.lit(0)) != 0, shown).otherwise(F.lit("N/A"))


def sweep_status(exit_code: Column | str, cancelled: Column | str) -> Column:
    """Cancelled by flag or by exit code −9, else completed on 0, else failed."""
    code = _column(exit_code)
    return (
        F.when(F.coalesce(_column(cancelled), F.lit(False)) | F.coalesce(code == -9, F.lit(False)), F.lit("cancelled"))
        .when(code == 0, F.lit("completed"))
        .otherwise(F.lit("failed"))
    )
