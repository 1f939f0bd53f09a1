"""Vector scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three metric names and whether a higher value is better.
HIGHER_IS_BETTER = {"innerproduct": True, "cosinesimil": True, "l2": False}


def check_space(space_type: str) -> str:
    if space_type not in HIGHER_IS_BETTER:
        raise ValueError(f"unknown space type {space_type!r}; use one of {sorted(HIGHER_IS_BETTER)}")
    return space_type


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def score(a: Column, b: Column, space_type: str) -> Column:
    """Inner product or cosine (higher is better) or L2 distance (lower is better), in DOUBLE."""
    check_space(space_type)
    if space_type == "innerproduct":
        return _dot(a, b)
    if space_type == "cosinesimil":
        return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(_total(gaps))
