"""Teacher scoring of choice and score rows over two option orders, and its resumable file form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prompts, scoring, teacher
from ..sources.rows import resumable_append


def teacher_scores(questions: DataFrame, backend: scoring.Backend, seed: str = "0") -> DataFrame:
    """request_id, label, probs, agree, per_order. Yes/no rows are read in the given order only."""
    n = F.when(F.col("type") == "noul", F.lit(2)).otherwise(F.size("options"))
    each = questions.select("*", F.posexplode(teacher.orders(F.col("type"), n, seed, F.col("request_id"))).alias("order", "perm"))
    each = each.withColumn("options", F.when(F.col("type") != "noul", F.transform("perm", lambda i: F.get(F.col("options"), i))))
    read = scoring.run_backend(prompts.with_prompt(each), backend, ["request_id", "order", "perm"])
    return teacher.teacher_rows(read, ["request_id"])


def score_file(questions: DataFrame, backend: scoring.Backend, path: str, seed: str = "0") -> int:
    """Scores the rows that ``path`` lacks and appends them; returns how many."""
    return resumable_append(questions, path, lambda rows: teacher_scores(rows, backend, seed), "request_id")


def candidate_margins(pairs: DataFrame, backend: scoring.Backend, keys: list[str], asked: str = "Which intent does the message have?") -> DataFrame:
    """Adds ``margin``, yes over no, to pairs of a text and a label (keys, text, label_name, place): a prompt a pair."""
    option = F.struct(F.col("label_name").alias("name"), F.lit(None).cast("string").alias("descr"))
    rows = pairs.select(*keys, "label_name", "place", F.col("text").alias("state"), F.lit(asked).alias("instructions"), option.alias("option"))
    read = scoring.run_backend(prompts.with_candidate_prompt(rows), backend, [*keys, "label_name", "place"])
    margins = read.select(*keys, "label_name", (F.get("logits", F.lit(0)) - F.get("logits", F.lit(1))).alias("margin"))
    return pairs.join(margins, [*keys, "label_name"])


def mined_negatives(rows: DataFrame, labels: DataFrame, backend: scoring.Backend, keep: int = 15) -> DataFrame:
    """id, gold_rank and the ``keep`` best wrong labels of rows (id, text, label) over a label list (name, place)."""
    pairs = rows.select("id", "text", F.col("label").alias("gold")).crossJoin(labels.select(F.col("name").alias("label_name"), "place"))  # a prompt a label is the job
    return scoring.mined(candidate_margins(pairs, backend, ["id"]), ["id", "gold"], F.col("label_name") == F.col("gold"), keep=keep).select("id", "gold_rank", "wrong")


def mining_summary(found: DataFrame) -> DataFrame:
    """Rows mined, and how often the gold label ranks first or among ten."""
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold_rank") == 0).cast("int")).alias("top1"), F.avg((F.col("gold_rank") < 10).cast("int")).alias("top10"))
