"""Teacher scores over two option orders: permutations, their inverse, means and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import argmax
from ..functions.hashing import order_key


def identity(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def shuffled_order(n: Column, seed: str | int, key: Column) -> Column:
    """A permutation by digests that differs from the given order: an identical one is turned by one place."""
    perm = F.transform(F.array_sort(F.transform(identity(n), lambda i: F.struct(order_key(seed, key, i).alias("h"), i.alias("i")))), lambda s: s["i"])
    return F.when(perm == identity(n), F.transform(identity(n), lambda i: (i + 1) % n)).otherwise(perm)


def orders(kind: Column, n: Column, seed: str | int, key: Column) -> Column:
    """The orders a question is scored under; yes/no questions keep the given one."""
    return F.when(kind == "noul", F.array(identity(n))).otherwise(F.array(identity(n), shuffled_order(n, seed, key)))


def reordered(options: Column, perm: Column) -> Column:
    """New place j holds option perm[j]; raises if perm is no permutation."""
    ok = F.array_sort(perm) == identity(F.size(options))
    return F.when(ok, F.transform(perm, lambda i: F.get(options, i))).otherwise(F.raise_error(F.lit("not a permutation")))


def to_given_order(probs: Column, perm: Column) -> Column:
    return F.transform(identity(F.size(perm)), lambda i: F.get(probs, F.array_position(perm, i) - 1))


def combined(per_order: Column) -> tuple[Column, Column]:
    """Mean distribution, and whether all orders have the same top option."""
    n = F.size(per_order)
    mean = F.transform(F.get(per_order, F.lit(0)), lambda _, i: F.aggregate(per_order, F.lit(0.0), lambda a, p: a + F.get(p, i)) / n)
    return mean, F.size(F.array_distinct(F.transform(per_order, argmax))) == 1


def teacher_rows(reads: DataFrame, keys: list[str]) -> DataFrame:
    """From one row an order (keys, order, perm, logits): label, probs, agree, per_order."""
    each = reads.withColumn("p", to_given_order(P.softmax(F.col("logits")), F.col("perm")))
    grouped = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "p"))), lambda s: s["p"]).alias("per_order"))
    mean, agree = combined(F.col("per_order"))
    out = grouped.withColumns({"probs": mean, "agree": agree})
    return out.select(*keys, argmax(F.col("probs")).alias("label"), "probs", "agree", "per_order")


def majority(picks: Column) -> Column:
    """The most frequent pick, the first of equals."""
    distinct = F.array_distinct(picks)
    counts = F.transform(distinct, lambda x: F.size(F.filter(picks, lambda y: y == x)))
    return F.get(distinct, argmax(counts))
