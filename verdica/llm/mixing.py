"""Mixing sources to target weights by weighted fair queueing.

Targets. Sources in order of code points, null last, weigh 5, 2, 1, repeating, and share the words of all documents.
No source gets more than three times its words: the shares are min(3 * size, level * weight) with the one level that
spends everything, which is where resharing the excess by weight ends.

Queue. A source's documents stand in the order of a seeded digest of their id; the source is read up to three times
in that order. A copy's virtual finish time is the words of its source up to its end, divided by the source's target.
All copies are ordered by finish time and taken while the running total of words stays within the budget.

Neither order is ever formed in one task. Words are summed by (source, digest range) first, so a running total inside
a range starts from the sum of the ranges before. The cut is found by two passes of sums over ranges of
finish time; only the few copies of one narrow range are then ordered one by one.

Defined results: null and blank texts have size 0 and are taken 0 times; a source of size 0 has target 0; rows that
repeat an id follow each other in the queue; texts of any length are taken whole; an empty table gives an empty result; extra columns
don't matter to ``mixed`` and stay in ``mix``. Where the cut falls between rows that repeat id, source and size, ``mix`` gives each
of them the larger number of copies: a few words more than the budget, so that equal rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, native_words, staged_narrow

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Documents of one (source, digest range), about, and ranges of finish time in one pass of sums.
RANGE_ROWS = 2000
TIME_RANGES = 1 << 12


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size), one row per source: adds ``rank``, ``weight`` and ``target``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", rank.alias("rank"), weight.cast("long").alias("weight"))
    # by size per weight, sources fill up one after the other; each prefix taken as full gives the others a level
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spent = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * EPOCHS
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - spent).cast("double") / left
    full = F.col("source_size") * EPOCHS <= level * F.col("weight")
    levels = ranked.withColumns({"_level": level, "_full": full})
    # behind the first source that does not fill up the assumed levels only fall, so the largest is the level
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)
    target = F.when(F.col("_full") | common.isNull(), (F.col("source_size") * EPOCHS).cast("double")).otherwise(common * F.col("weight"))
    return levels.select("source", "source_size", "rank", "weight", F.when(F.sum("source_size").over(whole) > 0, target).otherwise(F.lit(0.0)).alias("target"))


def _order_key(key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(SEED), F.coalesce(key.cast("string"), F.lit(""))), 256)


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken."""
    sized = staged_narrow(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(native_words(F.col(text))).cast("long").alias("size"), _order_key(F.col(key)).alias("at")),
        scanned=True,
    )
    n = sized.count()
    ranges = 1 << max(6, (n // RANGE_ROWS).bit_length())
    spot = F.shiftright(F.conv(F.substring("at", 1, 8), 16, 10).cast("long"), 32 - (ranges.bit_length() - 1)).cast("int")
    sized = sized.withColumn("range", spot)
    sums = staged_narrow(sized.groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    start = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    named = targets.select(F.col("source").alias("_s"), "source_size", "rank", "target")
    starts = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"), start.alias("start")).join(named, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    run = Window.partitionBy("source", "range").orderBy("at", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("inside", F.sum("size").over(run))
    queue = staged_narrow(
        queued.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).select(
            "key", "source", "size", "at", "source_size", "rank", "target", (F.col("start") + F.col("inside")).alias("end")
        )
    )
    cut = _cut(queue)
    return queue.select("key", "source", "size", "source_size", "target", _taken(cut).alias("taken"))


def _copies(queue: DataFrame) -> DataFrame:
    """The copies of documents with words, with their finish times."""
    epochs = F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch")
    live = queue.where("size > 0 AND target > 0").select("key", "size", "at", "rank", "end", "source_size", "target", epochs)
    return live.withColumn("time", _time(F.col("epoch")))


def _time(epoch: Column) -> Column:
    return (F.col("source_size") * epoch + F.col("end")).cast("double") / F.col("target")


_PLACE = ("time", "rank", "end", "at", "key")


def _cut(queue: DataFrame) -> dict | None:
    """The last copy that the budget covers, by place in the global order; None if none is.

    Each pass narrows the ranges of time by TIME_RANGES sums, the most that reaches the driver.
    """
    copies = _copies(queue)
    whole = copies.agg(F.sum(F.when(F.col("epoch") == 0, F.col("size"))), F.max("time")).first()
    if not whole[0]:
        return None
    low, high, before, budget = 0.0, float(whole[1]), 0, int(whole[0])
    for _ in range(2):
        width = (high - low) / TIME_RANGES
        if width <= 0:
            break
        part = F.least(F.greatest(F.floor((F.col("time") - low) / width), F.lit(0)), F.lit(TIME_RANGES - 1)).cast("int")
        within = copies.where((F.col("time") >= low) & (F.col("time") <= high)).withColumn("part", part)
        sums = sorted((r["part"], r["words"], r["least"], r["most"]) for r in within.groupBy("part").agg(F.sum("size").alias("words"), F.min("time").alias("least"), F.max("time").alias("most")).collect())
        for _, words, least, most in sums:
            if before + words > budget:
                low, high = least, most
                break
            before += words
        else:
            return {"time": float("inf")}
    last = copies.where((F.col("time") >= low) & (F.col("time") <= high))
    order = [F.col(c) for c in _PLACE]
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + before
    place = F.struct(*order)
    found = last.select(place.alias("place"), total.alias("total")).where(F.col("total") <= budget).agg(F.max("place").alias("p")).first()["p"]
    return found.asDict() if found is not None else {"time": low, "rank": -1, "end": -1, "at": "", "key": None}


def _taken(cut: dict | None) -> Column:
    """Words taken of a document: its size for each copy at or before the cut."""
    if cut is None:
        return F.lit(0).cast("long")
    if cut["time"] == float("inf"):
        return F.when(F.col("target") > 0, F.col("size") * EPOCHS).otherwise(F.lit(0)).cast("long")
    copies = F.lit(0)
    for epoch in range(EPOCHS):
        time = _time(F.lit(epoch))
        early = time < F.lit(cut["time"])
        rank, end, at = F.lit(cut["rank"]), F.lit(cut["end"]), F.lit(cut["at"])
        here = (F.col("rank") == rank) & ((F.col("end") < end) | ((F.col("end") == end) & (F.col("at") <= at)))
        tie = (time == F.lit(cut["time"])) & ((F.col("rank") < rank) | here)
        copies = copies + F.when(early | tie, F.lit(1)).otherwise(F.lit(0))
    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * copies).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with its own columns."""
    k, s, w, n, copy = (fresh(docs, f"_mix_{c}") for c in ("key", "source", "size", "n", "copy"))
    copies = F.max((F.col("taken") / F.col("size")).cast("int"))
    taken = mixed(docs, key, source, text).where("taken > 0").groupBy(F.col("key").alias(k), F.col("source").alias(s), F.col("size").alias(w)).agg(copies.alias(n))
    size = F.size(native_words(F.col(text))).cast("long")
    joined = docs.join(taken, F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (size == F.col(w)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
