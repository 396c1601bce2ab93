"""Deterministic order and draws from digests: the same on any number of partitions and in any engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: str | int, *parts: Column) -> Column:
    """A row's place in a seeded shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def uniform(seed: str | int, *parts: Column) -> Column:
    """A draw from [0, 1) with 52 bits."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def pick(draw: Column, weighted: list[tuple[object, float]]) -> Column:
    """Categorical draw by cumulative weights; the last value takes what is left."""
    acc, out = 0.0, None
    for value, weight in weighted[:-1]:
        acc += weight
        out = F.when(draw < acc, F.lit(value)) if out is None else out.when(draw < acc, F.lit(value))
    last = F.lit(weighted[-1][0])
    return last if out is None else out.otherwise(last)


def choose(draw: Column, values: Column) -> Column:
    """An element of an array by a uniform draw."""
    return F.get(values, F.floor(draw * F.size(values)).cast("int"))


def shuffled(values: Column, seed: str | int, *parts: Column) -> Column:
    """Array elements in the order of digests of seed, parts and the element's place."""
    keyed = F.transform(values, lambda x, i: F.struct(order_key(seed, *parts, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def uniform_sql(*parts: str) -> str:
    """The same draw in the oracle's dialect; parts are SQL expressions or quoted literals."""
    return f"(('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0)"


def order_sql(*parts: str) -> str:
    return f"sha256(concat_ws(':', {', '.join(parts)}))"
