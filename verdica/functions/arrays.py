"""Array expressions that bind their inputs once, so lambdas don't recompute them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def item(values: Column, index: Column | int) -> Column:
    """Zero-based element, null outside."""
    return F.get(values, F.lit(index) if isinstance(index, int) else index)


def argmax(values: Column) -> Column:
    """Zero-based place of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def doubles(values: Column) -> Column:
    return values.cast("array<double>")
