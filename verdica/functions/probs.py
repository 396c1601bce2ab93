"""Probabilities from logits, and answer shaping, as column expressions. Works on rows of differing length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import argmax, item, let, total

#: Probabilities are clipped here before a logarithm; sums and ranges of probabilities may be off by the tolerance.
EPS, TOLERANCE = 1e-12, 1e-6
#: Digits of answers.
DIGITS = 6


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Max-shifted; the temperature is finite and above zero."""
    t = F.lit(temperature) if isinstance(temperature, int | float) else temperature
    return let(F.struct(logits.alias("z"), F.array_max(logits).alias("m"), t.cast("double").alias("t")), lambda s: let(F.transform(s["z"], lambda x: F.exp((x - s["m"]) / s["t"])), lambda e: let(F.struct(e.alias("e"), total(e).alias("n")), lambda q: F.transform(q["e"], lambda x: x / q["n"]))))


def logsumexp(logits: Column) -> Column:
    return let(F.struct(logits.alias("z"), F.array_max(logits).alias("m")), lambda s: s["m"] + F.log(F.aggregate(s["z"], F.lit(0.0), lambda a, x: a + F.exp(x - s["m"]))))


def log_softmax(logits: Column) -> Column:
    return let(F.struct(logits.alias("z"), logsumexp(logits).alias("n")), lambda s: F.transform(s["z"], lambda x: x - s["n"]))


def sigmoid(x: Column) -> Column:
    return F.lit(0.5) * (F.tanh(F.lit(0.5) * x) + 1.0)


def noul_probs(logits: Column, a: Column | float = 1.0, b: Column | float = 0.0) -> Column:
    """[P(false), P(true)] from (true, false) logits."""
    p = sigmoid(_lit(a) * (item(logits, 0) - item(logits, 1)) + _lit(b))
    return let(p, lambda q: F.array(F.lit(1.0) - q, q))


def _lit(x: Column | float) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else x


def nll(probs: Column, label: Column) -> Column:
    return -F.log(F.greatest(item(probs, label), F.lit(EPS)))


def brier(probs: Column, label: Column) -> Column:
    return F.aggregate(F.transform(probs, lambda p, k: F.pow(p - F.when(k == label, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def correct(probs: Column, label: Column) -> Column:
    return (argmax(probs) == label).cast("int")


def expected_level(probs: Column) -> Column:
    return total(F.transform(probs, lambda p, k: p * k))


def confidence(probs: Column) -> Column:
    """Scaled excess of the top probability over an even share, within [0, 1]."""
    n = F.size(probs)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n * F.array_max(probs) - 1) / (n - 1)))


def valid(probs: Column, length: Column | None = None, tolerance: float = 1e-4) -> Column:
    """Whether an array is a distribution of the length asked for."""
    ok = F.forall(probs, lambda p: ~F.isnan(p) & (p >= 0) & (p <= 1)) & (F.abs(total(probs) - 1) <= tolerance)
    return ok & (F.size(probs) == length) if length is not None else ok


def soft_cross_entropy(logits: Column, n: Column, label: Column, target: Column) -> Column:
    """Cross-entropy over the first n letters, against a soft target where there is one."""
    return let(log_softmax(F.slice(logits, F.lit(1), n)), lambda lp: F.when(target.isNull(), -item(lp, label)).otherwise(-total(F.zip_with(target, lp, lambda t, x: t * x))))


def choice_answer(names: Column, probs: Column) -> Column:
    """First option wins ties; numbers rounded."""
    return F.struct(
        item(names, argmax(probs)).alias("choice"),
        F.transform(F.arrays_zip(names.alias("name"), probs.alias("p")), lambda x: F.struct(x["name"].alias("name"), F.round(x["p"], DIGITS).alias("p"))).alias("probabilities"),
        F.round(confidence(probs), DIGITS).alias("confidence"),
    )


def score_answer(levels: Column, probs: Column) -> Column:
    return F.struct(F.round(expected_level(probs), DIGITS).alias("score"), levels.alias("legend"), F.round(confidence(probs), DIGITS).alias("confidence"), F.transform(probs, lambda p: F.round(p, DIGITS)).alias("probabilities"))


def noul_answer(p: Column) -> Column:
    return F.struct(F.round(p, DIGITS).alias("noul"))


def merge_shortlist(log_p1: Column, kept: Column, log_p2: Column) -> Column:
    """Stage-1 log probabilities with the kept options' mass dealt anew by stage 2. kept: zero-based places in order."""
    mass = logsumexp(F.transform(kept, lambda j: item(log_p1, j)))
    return let(F.struct(log_p1.alias("p"), kept.alias("k"), log_p2.alias("q"), mass.alias("m")), lambda s: F.transform(s["p"], lambda x, j: F.coalesce(item(s["q"], F.array_position(s["k"], j) - 1) + s["m"], x)))


def shortlist(log_p: Column, k: int) -> Column:
    """Places of the k best, best first by value and then place, returned in their own order."""
    ranked = F.array_sort(F.transform(log_p, lambda x, j: F.struct((-x).alias("x"), j.alias("j"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda s: s["j"]))
