"""Row selection by role and family: reasons to drop, class quotas, true shares, manifests."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.text import has_control_text, token_proxy

# True shares by family and source, and limits.
NLI_TRUE, READING_TRUE, OVR_TRUE, CANDIDATE_TRUE, XFER_CANDIDATE_TRUE = 0.475, 0.5, 0.30, 0.25, 1 / 3
JUDGEMENT_TRUE = {"paws": 0.45, "tweet_offensive": 0.35, "tweet_hate": 0.42, "tweet_irony": 0.50}
XFER = {"hwu64", "rte", "multirc", "app_reviews"}
MAX_TOKENS, PARAGRAPH_ROWS = 512, 2
DROP_REASONS = ["held_out_text_overlap", "not_mined", "text_in_training_corpus", "held_out_for_dev", "used_by_sibling_source", "duplicate_text", "cannot_phrase", "control_token_text", "over_512_tokens"]


def split_even(n: int, keys: list[Any]) -> dict[Any, int]:
    return {k: n // len(keys) + (i < n % len(keys)) for i, k in enumerate(sorted(keys))}


def class_quotas(source: str, family: str, n: int) -> dict[str, int] | None:
    """Rows of each class a family takes; None where classes come as they are."""
    if family == "nli" and source != "rte":
        true = round(n * NLI_TRUE)
        false = {"scitail": ["neutral"]}.get(source, ["neutral", "contradiction"])
        return {"entailment": true, **split_even(n - true, false)}
    if (family == "reading" and source != "multirc") or family == "judgement":
        true = round(n * (READING_TRUE if family == "reading" else JUDGEMENT_TRUE[source]))
        return {"true": true, "false": n - true}
    if family == "score" and source in ("civil_comments", "app_reviews"):
        return {str(k): v for k, v in split_even(n, list(range(4 if source == "civil_comments" else 5))).items()}
    return None


def positive_rate(source: str, family: str) -> float | None:
    return {"ovr": OVR_TRUE, "candidate": XFER_CANDIDATE_TRUE if source in XFER else CANDIDATE_TRUE}.get(family)


def first_reason(**conditions: Column) -> Column:
    """The name of the first condition that holds, in the order given."""
    return F.coalesce(*[F.when(v, F.lit(k)) for k, v in conditions.items()])


def length_reason(text: Column, limit: int = MAX_TOKENS) -> Column:
    return first_reason(control_token_text=has_control_text(text), over_512_tokens=token_proxy(text) > limit)


def limited(rows: DataFrame, limit: str, order: Column, most: int = PARAGRAPH_ROWS) -> DataFrame:
    """At most ``most`` rows of each limit key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(limit).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def select_rows(items: DataFrame, quotas: DataFrame, seed: str, group: list[str]) -> DataFrame:
    """Set form of selection: dedupe by content key in seeded order, then class quotas. Adds ``drop_reason`` (null: taken).

    items: id, cls, key and group columns; quotas: group columns, cls, quota. Differs from the sequential form where a
    repeated text's first row fails its quota: that text is then not taken for another class.
    """
    order = order_key(seed, F.col("id"))
    first = F.row_number().over(Window.partitionBy(*group, "key").orderBy(order, "id"))
    marked = items.withColumn("_dup", first > 1)
    rank = F.row_number().over(Window.partitionBy(*group, "cls", "_dup").orderBy(order, "id"))
    ranked = marked.withColumn("_rank", rank).join(F.broadcast(quotas), [*group, "cls"], "left")
    reason = first_reason(duplicate_text=F.col("_dup"), quota_full=F.col("_rank") > F.coalesce("quota", F.lit(0)))
    return ranked.withColumn("drop_reason", F.coalesce(F.col("skip_reason"), reason) if "skip_reason" in items.columns else reason).drop("_dup", "_rank", "quota")


def select_greedy(items: DataFrame, quotas: dict[str, int], seed: str, group: str) -> DataFrame:
    """Sequential form, exact: rows in seeded order; one is taken if its key is free and its class has room. Adds ``taken``.

    What can matter is bounded by the quotas, not by the source. Of a class only first rows of a key can be taken, and each
    of these is, unless the class is full or another class has taken the key. Other classes take no more keys than their
    quotas, so a class is full before as many of its keys have come as all quotas sum to. Those first keys of each class
    are found by ranks; the loop runs over them alone, one task a group.
    """
    most = sum(max(n, 0) for n in quotas.values())
    firsts = items.where(F.col("cls").isin([c for c, n in quotas.items() if n > 0])).select("id", "cls", "key", group, order_key(seed, F.col("id")).alias("_o"))
    firsts = firsts.groupBy(group, "cls", "key").agg(F.min(F.struct("_o", "id")).alias("_first")).select(group, "cls", "key", "_first.*")
    rank = F.row_number().over(Window.partitionBy(group, "cls").orderBy("_o", "id"))
    near = firsts.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, used, taken = dict(quotas), set(), []
        ordered = frame.sort_values(["_o", "id"])
        for cls, k in zip(ordered["cls"], ordered["key"], strict=True):
            ok = k not in used and left[cls] > 0
            if ok:
                used.add(k)
                left[cls] -= 1
            taken.append(ok)
        return pd.DataFrame({"_group": ordered[group], "_id": ordered["id"]})[taken]

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    chosen = near.groupBy(group).applyInPandas(run, f"_group {kinds[group]}, _id {kinds['id']}")
    joined = items.join(chosen, F.col(group).eqNullSafe(F.col("_group")) & (F.col("id") == F.col("_id")), "left")
    return joined.withColumn("taken", F.col("_id").isNotNull()).drop("_group", "_id")


def summary(rows: DataFrame) -> DataFrame:
    """Counts over source and family with totals, and true shares of yes/no families."""
    yes_no = F.col("family").isin("nli", "reading", "judgement", "ovr", "candidate")
    return rows.rollup("source", "family").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(yes_no, F.col("label"))), 4).alias("positive_rate")
    )


def manifest(rows: DataFrame, dropped: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Small tables: counts, option counts, gold places, drops by reason, and shortfalls against wanted (source, family, n)."""
    have = rows.groupBy("source", "family").agg(F.count(F.lit(1)).alias("n"))
    return {
        "counts": summary(rows),
        "option_counts": rows.where(F.col("family").isin("choice", "candidate")).groupBy("family", F.size("question.options").alias("options")).count(),
        "gold_position": rows.where("family = 'choice'").groupBy("label").count(),
        "drops": dropped.groupBy("role", "source", "drop_reason").count(),
        "shortfall": wanted.join(have.withColumnRenamed("n", "have"), ["source", "family"], "left").select("source", "family", (F.col("n") - F.coalesce("have", F.lit(0))).alias("missing")).where("missing > 0"),
    }


def train_order(rows: DataFrame, seed: str) -> DataFrame:
    """Global seeded shuffle: a range-partitioned sort by digest."""
    return rows.orderBy(order_key(f"{seed}:train-order", F.col("id")), "id")
