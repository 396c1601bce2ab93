"""Paired significance, bootstrap intervals, early exit, stop rules and schedules."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .sampling import blocks

#: Resamples of an interval.
REPS = 10_000
#: Rows and resamples that are drawn at a time, and rows of a slice.
PIECE_ROWS, PIECE_REPS, SLICE_ROWS, LEAST_SLICES = 256, 500, 50_000, 12
#: Poisson(1): the k-th edge is the chance of k or fewer, in 32 bits.
_EDGES = np.array([int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.uint32)


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two hit columns, and the exact two-sided binomial probability."""
    counts = rows.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    return counts.withColumn("p_value", exact_binomial(F.col("only_a"), F.col("only_b")))


def exact_binomial(x: Column, y: Column) -> Column:
    """Twice the chance of min(x, y) heads or fewer in x + y tosses, at most 1: each term from the one before, by logarithms."""
    n, k = x + y, F.least(x, y)
    first = n * F.lit(-math.log(2))

    def add(acc: Column, i: Column) -> Column:
        log_term = acc["log_term"] + F.log((n - i + 1).cast("double") / i)
        return F.struct(log_term.alias("log_term"), (acc["total"] + F.exp(log_term)).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(terms, F.struct(first.alias("log_term"), F.exp(first).alias("total")), add)["total"])


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference of two columns with its standard error."""
    d = F.col(a) - F.col(b)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("diff"), (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("std_error"))


def poisson_weights(rows: np.ndarray, first: int, n: int) -> np.ndarray:
    """How often each row is drawn in resamples first, first + 1, ...: Poisson(1) counts, a line of ``n`` for each row's digest.

    A count depends on the row's digest and the number of the resample alone, so no resample needs all row numbers.
    A mixed word gives the draws of two resamples, thus ``first`` and ``n`` are even.
    """
    steps = np.arange(first // 2 + 1, (first + n) // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = rows[:, None] + steps
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))).view(np.uint32)
    counts = np.zeros(u.shape, np.uint8)
    for edge in _EDGES[:5]:
        counts += u >= edge
    rare = np.nonzero(u >= _EDGES[5])
    counts[rare] = np.searchsorted(_EDGES, u[rare], side="right")
    return counts


def draws_sql(rows: str, key: str, columns: str, reps: int = REPS, seed: int = 0) -> str:
    """The same counts in the oracle's dialect: a query of columns, rep and w (how often the row is drawn), without rows not drawn."""
    wrap = "(({})::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    shifted = lambda x, n: f"xor({x}, {x} >> {n})"
    times = lambda x, c: wrap.format(f"({x})::UHUGEINT * {c}::UHUGEINT")
    w = " + ".join(f"(u >= {edge})::INT" for edge in _EDGES.tolist())
    return f"""SELECT * FROM (SELECT {columns}, rep, {w} AS w FROM (
        SELECT {columns}, unnest([2 * step - 2, 2 * step - 1]) AS rep, unnest([x & 4294967295, x >> 32]) AS u FROM (
        SELECT * EXCLUDE (x), {shifted('x', 31)} AS x FROM (SELECT * EXCLUDE (x), {times(shifted('x', 27), 0x94D049BB133111EB)} AS x FROM (
        SELECT * EXCLUDE (x), {times(shifted('x', 30), 0xBF58476D1CE4E5B9)} AS x FROM (
        SELECT *, {wrap.format(f"('0x' || substr(sha256(concat_ws(':', '{seed}', {key})), 1, 15))::UBIGINT::UHUGEINT + step::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT")} AS x
        FROM {rows}, range(1, {reps // 2 + 1}) AS r(step)))))) ) WHERE w > 0"""


def _drawn(rows: DataFrame, key: str, seed: int, *columns: Column) -> DataFrame:
    """The digest that a row's draws come from, as ``_row``, and further columns."""
    digest = F.conv(F.substring(order_key(seed, F.col(key)), 1, 15), 16, 10).cast("long")
    return rows.select(digest.alias("_row"), *columns)


def _pieces(batches: Iterable[pa.RecordBatch], reps: int) -> Iterator[tuple[list[np.ndarray], int, np.ndarray]]:
    """The columns of a few rows at a time, and their counts in blocks of resamples."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for at in range(0, batch.num_rows, PIECE_ROWS):
            piece = [c[at : at + PIECE_ROWS] for c in columns]
            for first in range(0, reps, PIECE_REPS):
                n = min(PIECE_REPS, reps - first)
                yield piece[1:], first, poisson_weights(piece[0].view(np.uint64), first, n + n % 2)[:, :n].astype(np.float64)


def bootstrap_mean(rows: DataFrame, value: str, key: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """mean, low and high of a percentile 95 % interval. Sums by resample are combined before the exchange."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((2, reps)), False
        for (values,), first, w in _pieces(batches, reps):
            some = True
            total[:, first : first + w.shape[1]] += np.stack([values, np.ones(len(values))]) @ w
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["rep", "s", "w"])

    drawn = _drawn(rows.where(F.col(value).isNotNull()), key, seed, F.col(value).cast("double").alias("_value"))
    means = drawn.mapInArrow(sums, "rep int, s double, w double").groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b) & ~(np.isnan(a) & np.isnan(b))


class _Slice:
    """Sums of a slice of the order by score, for a block of resamples: positives, negatives, pairs in order.

    Its first and its last score stay apart from those between, since they may go on in other slices.
    """

    def __init__(self, n: int):
        self.first: tuple[float, np.ndarray] | None = None
        self.last: tuple[float, np.ndarray] | None = None
        self.inner = np.zeros((3, n))

    def add(self, scores: np.ndarray, labels: np.ndarray, w: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, _differ(scores[1:], scores[:-1])))
        pos = w * labels[:, None]
        both = np.stack([pos, w - pos])
        if len(starts) < len(scores):
            both = np.add.reduceat(both, starts, axis=1)
        scores = scores[starts]
        if self.last is not None:
            if _differ(scores[0], self.last[0]):
                scores, both = np.append(self.last[0], scores), np.concatenate([self.last[1][:, None], both], axis=1)
            else:
                both[:, 0] += self.last[1]
        self.last = scores[-1], both[:, -1].copy()
        closed = both[:, :-1]
        if self.first is None and closed.shape[1]:
            self.first, closed = (scores[0], closed[:, 0].copy()), closed[:, 1:]
        p, q = closed
        self.inner[2] += np.einsum("ij,ij->j", p, np.cumsum(q, axis=0) - q / 2) + p.sum(0) * self.inner[1]
        self.inner[:2] += closed.sum(1)

    def rows(self) -> Iterator[tuple[float, bool, np.ndarray]]:
        """(score, whether the sums are of this score or of those above it in the slice, sums)."""
        if self.first is not None:
            yield self.first[0], True, np.append(self.first[1], np.zeros((1, self.inner.shape[1])), axis=0)
            yield self.first[0], False, self.inner
        if self.last is not None:
            yield self.last[0], True, np.append(self.last[1], np.zeros((1, self.inner.shape[1])), axis=0)


def bootstrap_auroc(rows: DataFrame, score: str, label: str, key: str, reps: int = REPS, seed: int = 0) -> DataFrame:
    """Weighted AUROC of each resample: interval of 95 %.

    Rows are dealt into slices of the order by score, equal scores by digest. A slice sends three rows for a block of
    resamples, so what is exchanged doesn't grow with the rows times the resamples.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Slice] = {}
        for (scores, labels), first, w in _pieces(batches, reps):
            blocks.setdefault(first, _Slice(w.shape[1])).add(scores, labels, w)
        found = [(first, s, tie, sums.tobytes()) for first, x in blocks.items() for s, tie, sums in x.rows()]
        if found:
            kinds = (pa.int32(), pa.float64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["first", "s", "tie", "sums"])

    def joined(table: pa.Table) -> pa.Table:
        s, above = table.column("s").to_numpy(), ~table.column("tie").to_numpy()
        sums = np.stack([np.frombuffer(x.as_py()).reshape(3, -1) for x in table.column("sums")])
        order = np.lexsort((above, s))
        s, above, sums = s[order], above[order], sums[order]
        starts = np.flatnonzero(np.append(True, _differ(s[1:], s[:-1]) | (above[1:] != above[:-1])))
        p, q, u = np.add.reduceat(sums, starts, axis=0).transpose(1, 0, 2)
        u = np.where(above[starts, None], u, p * q / 2) + p * (np.cumsum(q, axis=0) - q)
        pairs = p.sum(0) * q.sum(0)
        return pa.table({"auroc": pa.array(u.sum(0) / np.where(pairs > 0, pairs, 1.0), mask=pairs <= 0)})

    # as in an ascending sort, rows without score come first; rows without label count as negative
    drawn = _drawn(rows, key, seed, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_score"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_label"))
    n = max(LEAST_SLICES, rows.count() // SLICE_ROWS + 1)
    dealt = drawn.repartitionByRange(n, "_score", "_row").sortWithinPartitions("_score")
    each = dealt.mapInArrow(slices, "first int, s double, tie boolean, sums binary").groupBy("first").applyInArrow(joined, "auroc double")
    return each.agg(F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def tau_grid(rows: DataFrame) -> DataFrame:
    """For tau = 0, 0.01, ..., 1: accuracy when decisions of confidence tau or more leave after the first cycle, and
    their share. Rows have conf, hit_first, hit_final.

    Rows are counted by the last grid point that lets them leave; running sums over 102 groups do the rest, so rows
    are never multiplied by the grid.
    """
    step = F.least(F.floor(F.col("conf") * 100 + 1e-9), F.lit(100)).cast("int")
    groups = rows.groupBy(step.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit_first").alias("a"), F.sum("hit_final").alias("b"))
    spine = rows.sparkSession.range(101).select(F.col("id").cast("int").alias("g"))
    filled = spine.join(groups, "g", "left").fillna(0)
    leave, stay, whole = Window.orderBy("g").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    hits = F.sum("a").over(leave) + F.coalesce(F.sum("b").over(stay), F.lit(0))
    return filled.select((F.col("g") / F.lit(100)).alias("tau"), (hits / F.sum("n").over(whole)).alias("accuracy"), (F.sum("n").over(leave) / F.sum("n").over(whole)).alias("exit_share"), (F.sum("b").over(whole) / F.sum("n").over(whole)).alias("final_accuracy"))


def chosen_tau(rows: DataFrame, slack: float = 0.01) -> DataFrame:
    """The least tau whose accuracy is within ``slack`` of the final one; null for never."""
    ok = F.col("accuracy") >= F.col("final_accuracy") - F.lit(slack + 1e-9)
    return tau_grid(rows).agg(F.min(F.when(ok, F.col("tau"))).alias("tau"))


def gated(first: Column, final: Column, conf: Column, tau: Column | float) -> Column:
    return F.when(conf >= tau, first).otherwise(final)


def stop_rules(log: DataFrame, step: str = "step", loss: str = "loss", window: int = 50, start: int = 150, by: list[str] | None = None, block: int = 50_000) -> DataFrame:
    """Adds ``bad_pair`` (two non-finite losses in a row) and ``above_first`` (trailing mean above the first window's), of each run if ``by`` is given.

    Means are compared to nine digits, so that equal ones aren't told apart by the order in which they were summed.
    A log of any length is dealt in blocks that overlap by a window.
    """
    by = by or []
    value = F.col(loss)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    ok = blocks(log.withColumn("_ok", finite), step, window, by, block)
    first = ok.where(~F.col("_halo") & F.col("_ok") & (F.col("_place") < window)).groupBy(*by).agg(F.avg(loss).alias("first_mean"))
    w = Window.partitionBy(*by, "_block").orderBy(step)
    trailing = F.avg(F.when(F.col("_ok"), value)).over(w.rowsBetween(-(window - 1), 0))
    out = ok.withColumns({"trailing": trailing, "bad_pair": ~F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(True))}).where(~F.col("_halo"))
    out = out.join(first, by, "left") if by else out.join(F.broadcast(first), how="left", on=F.lit(True))  # one row
    return out.withColumn("above_first", (F.col("_place") + 1 >= start) & (F.round("trailing", 9) > F.round("first_mean", 9))).drop("_ok", "_place", "_block", "_halo")


def rises(log: DataFrame, step: str, value: str, by: list[str] | None = None, block: int = 50_000) -> DataFrame:
    """Adds ``stop``: the third of three strictly rising evaluations."""
    by = by or []
    w = Window.partitionBy(*by, "_block").orderBy(step)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    out = blocks(log, step, 2, by, block).withColumn("stop", F.coalesce((two < one) & (one < F.col(value)), F.lit(False)))
    return out.where(~F.col("_halo")).drop("_place", "_block", "_halo")


def learning_rate(step: Column, total: int, peak: float, warmup: int, floor: float = 0.1) -> Column:
    """Step counts from one: linear warm-up, then a cosine down to ``floor`` times the peak."""
    up = F.lit(peak) * step / F.lit(max(warmup, 1))
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(max(total - warmup, 1)))
    down = F.lit(peak) * (F.lit(floor) + F.lit(1 - floor) * F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * progress)))
    return F.when(step <= warmup, up).otherwise(down)
