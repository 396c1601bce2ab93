"""Requests to answers: validate, score, calibrate, shape, regroup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from ..operators import schema, scoring
from ..operators.calibrate import Calibrator


def answer_rows(questions: DataFrame, raw: DataFrame, cal: Calibrator) -> DataFrame:
    """One row a question with its answer as JSON."""
    rows = questions.join(raw, ["request_id", "ord"])
    probs = cal.probs(F.col("type"), F.col("logits"), F.col("stage"))
    rows = rows.withColumn("probs", probs)
    names = F.transform("options", lambda o: o["name"])
    choice, score, noul = P.choice_answer(names, F.col("probs")), P.score_answer(names, F.col("probs")), P.noul_answer(F.get("probs", F.lit(1)))
    shaped = F.when(F.col("type") == "choice", F.to_json(choice)).when(F.col("type") == "score", F.to_json(score)).otherwise(F.to_json(noul))
    return rows.select("request_id", "ord", "qid", "model", shaped.alias("answer"), "prompt_tokens", "truncated")


def responses(answers: DataFrame) -> DataFrame:
    """One row a request: answers in the order of its questions, tokens read, whether a state was cut."""
    grouped = answers.groupBy("request_id").agg(F.first("model").alias("model"), F.array_sort(F.collect_list(F.struct("ord", "qid", "answer"))).alias("a"), F.sum("prompt_tokens").alias("input_tokens"), F.max("truncated").alias("truncated"))
    # joined as text: a map would lose the order of questions
    name = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    body = F.concat(F.lit("{"), F.array_join(F.transform("a", lambda x: F.concat(name(x["qid"]), F.lit(":"), x["answer"])), ","), F.lit("}"))
    return grouped.select("request_id", "model", body.alias("answers"), "input_tokens", F.lit(0).alias("output_tokens"), "truncated")


def answer(bodies: DataFrame, backend: scoring.Backend = scoring.lexical_backend, cal: Calibrator | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, dead letters) of request bodies (request_id, body)."""
    good, bad = schema.split(schema.parsed(bodies))
    raw = scoring.score(good, backend)
    return responses(answer_rows(good, raw, cal or Calibrator())), bad
