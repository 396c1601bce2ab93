"""Accuracy, log loss, Brier score, calibration error, AUROC and reliability bins as aggregates.

Input: a table with ``probs`` (array of doubles, of any length) and ``label`` (zero-based), grouped by any columns.
Every measure is a sum over rows, so partial aggregation leaves little to exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import argmax
from .sampling import ranged

BINS = 15


def checked(df: DataFrame) -> DataFrame:
    """Raises when a row's probabilities or label are out of range, a sum is off, or there are no rows."""
    n = F.size("probs")
    bad = F.col("probs").isNull() | F.col("label").isNull() | (n < 2) | ~F.forall("probs", lambda p: ~F.isnan(p) & p.between(-P.TOLERANCE, 1 + P.TOLERANCE)) | ~F.col("label").between(0, n - 1)
    rows, wrong = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0))).first()
    if not rows:
        raise ValueError("no rows")
    if wrong:
        raise ValueError(f"{wrong} rows with invalid probabilities or labels")
    return df


def measures(probs: Column, label: Column) -> dict[str, Column]:
    return {
        "n": F.count(F.lit(1)),
        "accuracy": F.avg(P.correct(probs, label)),
        "nll": F.avg(P.nll(probs, label)),
        "brier": F.avg(P.brier(probs, label)),
    }


def summarize(df: DataFrame, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """n, accuracy, nll, brier and ece for each group."""
    by = by or []
    base = df.groupBy(*by).agg(*[c.alias(k) for k, c in measures(F.col("probs"), F.col("label")).items()])
    e = ece(df, by, bins)
    if not by:
        return base.crossJoin(e)
    return base.join(e, by)


def binned(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Adds ``bin`` (of the top probability), ``conf`` and ``hit``."""
    conf = F.array_max("probs")
    return df.withColumns({"conf": conf, "hit": P.correct(F.col("probs"), F.col("label")), "bin": F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")})


def reliability(df: DataFrame, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """All bins of each group: bin, low, high, n, confidence, accuracy (null where empty)."""
    by = by or []
    found = binned(df, bins).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("confidence"), F.avg("hit").alias("accuracy"))
    spine = (df.select(*by).distinct() if by else df.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = [(F.col("bin") / F.lit(bins)).alias("low"), ((F.col("bin") + 1) / F.lit(bins)).alias("high")]
    return spine.join(found, [*by, "bin"], "left").select(*by, "bin", *edges, F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def ece(df: DataFrame, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    by = by or []
    parts = binned(df, bins).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"), F.abs(F.avg("hit") - F.avg("conf")).alias("gap"))
    return parts.groupBy(*by).agg((F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"))


def auroc(df: DataFrame, score: str = "score", label: str = "label", weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with average ranks for ties; null where one class is missing.

    Equal scores are summed first, so the running total runs over distinct scores. It needs an order over a group;
    range-partitioned totals keep groups of any size out of a single task.
    """
    by = by or []
    w = F.lit(1.0) if weight is None else weight
    sums = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(w).alias("_all"), F.sum(w * F.col(label)).alias("_pos"))
    before = running(sums, "_all", "_s", by)
    ranked = before.groupBy(*by).agg(F.sum(F.col("_pos") * (F.col("_before") + (F.col("_all") + 1) / 2)).alias("r"), F.sum("_pos").alias("p"), F.sum(F.col("_all") - F.col("_pos")).alias("q"))
    return ranked.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auroc"))


def running(df: DataFrame, value: str, order: str, by: list[str], buckets: int = 256) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over smaller ``order`` in the group.

    Two levels: totals of ranges of the order, cut at percentiles so that they hold like numbers of rows wherever these lie, then
    running totals inside a range.
    """
    dealt = ranged(df, order, buckets)
    totals = dealt.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", F.coalesce(F.sum("_sum").over(outer), F.lit(0.0)).alias("_start"))
    inner = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0.0)))
    return inside.join(starts, [*by, "_range"]).withColumn("_before", F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_range")


def score_measures(probs: Column, label: Column) -> dict[str, Column]:
    """Mean absolute error of the expected level, and exact hits."""
    return {"mae": F.avg(F.abs(P.expected_level(probs) - label)), "exact": F.avg(P.correct(probs, label))}


def grouped(df: DataFrame, yes_no: tuple[str, ...] = ("nli", "reading", "judgement", "ovr", "candidate")) -> DataFrame:
    """Measures over all rows, by family and by source in one pass; ``all_yes_no`` says where an AUROC has meaning."""
    m = measures(F.col("probs"), F.col("label"))
    flag = F.min(F.col("family").isin(*yes_no).cast("int")).cast("boolean")
    keyed = df.withColumn("_g", F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("family").alias("kind"), F.col("family").alias("name")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")))))
    return keyed.groupBy("_g").agg(*[c.alias(k) for k, c in m.items()], flag.alias("all_yes_no")).select("_g.kind", "_g.name", *m, "all_yes_no")


def agreement(df: DataFrame, a: str, b: str) -> Column:
    """Share of rows with the same top place."""
    return F.avg((argmax(F.col(a)) == argmax(F.col(b))).cast("int"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
