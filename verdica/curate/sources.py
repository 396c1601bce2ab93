"""The source registry and the row mappers: each source's columns become (id, source, fields, class, keys) or a reason to skip.

Datasets are public ones, read from Parquet folders; facts (columns, label order, quotas) are settings, wordings our own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .labels import named

NLI = ["entailment", "neutral", "contradiction"]


@dataclass(frozen=True)
class Source:
    name: str
    columns: tuple[str, ...]
    quotas: dict[str, int] = field(default_factory=dict)
    dev: int = 0
    group: str | None = None


# Columns read, rows by family and held-out rows of each source.
SOURCES = {
    s.name: s
    for s in (
        Source("mnli", ("premise", "hypothesis", "label"), {"nli": 10_000}, 84),
        Source("anli", ("premise", "hypothesis", "label"), {"nli": 6_000}, 84),
        Source("wanli", ("premise", "hypothesis", "gold"), {"nli": 3_000}, 83),
        Source("vitaminc", ("evidence", "claim", "label"), {"nli": 3_000}, 83),
        Source("scitail", ("premise", "hypothesis", "label"), {"nli": 2_000}, 83),
        Source("squad_v2", ("context", "question", "answers"), {"reading": 3_500}, 83),
        Source("pubmedqa", ("question", "context", "final_decision"), {"reading": 2_500}, 83),
        Source("qnli", ("question", "sentence", "label"), {"reading": 2_000}, 83),
        Source("paws", ("sentence1", "sentence2", "label"), {"judgement": 2_000}, 83),
        Source("tweet_offensive", ("text", "label"), {"judgement": 667}, 28),
        Source("tweet_hate", ("text", "label"), {"judgement": 667}, 28),
        Source("tweet_irony", ("text", "label"), {"judgement": 666}, 27),
        Source("yahoo", ("question_title", "question_content", "topic"), {"choice": 4_000, "ovr": 3_000, "candidate": 500}, 84),
        Source("newsgroups", ("text", "label_text"), {"choice": 3_000, "ovr": 2_500}, 84),
        Source("dbpedia", ("title", "content", "label"), {"choice": 3_000, "ovr": 1_500, "candidate": 500}, 84),
        Source("clinc", ("text", "intent"), {"choice": 6_000, "ovr": 1_500, "candidate": 2_500}, 84),
        Source("massive_intent", ("id", "text", "label_text"), {"choice": 4_000, "candidate": 2_500}, 84, "massive"),
        Source("massive_scenario", ("id", "text", "label_text"), {"choice": 2_000, "ovr": 1_000}, 83, "massive"),
        Source("trec", ("text", "label_coarse_text", "label_text"), {"choice": 2_000, "ovr": 1_000}, 83),
        Source("go_emotions", ("text", "labels"), {"choice": 2_000, "ovr": 1_500}, 83),
        Source("emotion", ("text", "label"), {"choice": 2_000}, 83),
        Source("dailydialog", ("utterances", "acts"), {"ovr": 2_000}, 83),
        Source("amazon_reviews", ("text", "label"), {"score": 6_000}, 84),
        Source("stsb", ("sentence1", "sentence2", "score"), {"score": 3_000}, 83),
        Source("tweet_sentiment", ("text", "label"), {"score": 1_500}, 83),
        Source("civil_comments", ("text", "toxicity"), {"score": 1_500}, 83),
        Source("ledgar", ("text", "label"), {"candidate": 7_000, "choice": 3_000}, 100),
        Source("fewrel", ("relation", "tokens", "head", "tail", "names"), {"candidate": 7_000, "choice": 3_000}, 100),
        Source("hwu64", ("text", "label"), {"choice": 150, "candidate": 150}),
        Source("rte", ("premise", "hypothesis", "label"), {"nli": 277}),
        Source("multirc", ("paragraph", "question", "answer", "label"), {"reading": 250}),
        Source("app_reviews", ("review", "star"), {"score": 250}),
    )
}


def load(spark: SparkSession, source: str, path: str, split: str | None = None, revision: str | None = None) -> DataFrame:
    """A source's Parquet files, its columns only; missing ones are an error.

    ``revision`` names a folder below ``path`` that pins what was fetched; of a split either the folder of its name or the
    files that begin with its name and a hyphen are read, whichever is there.
    """
    root = "/".join([path.rstrip("/"), *([revision] if revision else [])])
    if split is None:
        rows = spark.read.parquet(root)
    else:
        files = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"{{{split},{split}-*.parquet}}"))
        if not found:
            raise ValueError(f"{source}: no split {split} in {root}")
        rows = spark.read.parquet(*[f.getPath().toString() for f in found])
    missing = [c for c in SOURCES[source].columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{source}: columns {missing} are missing")
    return rows.select(*SOURCES[source].columns)


def stsb_level(score: Column) -> Column:
    return F.floor(F.round(5 * score, 4) + 0.5).cast("int")


def civil_level(toxicity: Column) -> Column:
    e = 1e-6
    return F.when(toxicity <= e, 0).when(toxicity <= 0.3 + e, 1).when(toxicity <= 0.7 + e, 2).otherwise(3)


def _class(label: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.when(label >= 0, label.cast("int")))


def _mention(tokens: Column, entity: Column) -> Column:
    """Tokens of an entity's first mention; null where a place lies outside."""
    span = F.get(entity["indices"], F.lit(0))
    ok = (F.size(span) > 0) & F.forall(span, lambda i: (i >= 0) & (i < F.size(tokens)))
    return F.when(ok, F.array_join(F.transform(span, lambda i: F.get(tokens, i)), " "))


def _mapped(texts: dict[str, Column], cls: Column, skip: Column | None = None, extra: dict[str, Column] | None = None, least: int = 1, short: str = "empty_text", last: Column | None = None) -> dict[str, Column]:
    """Cleaned texts, class, key and the first reason to skip: ``skip``, no class, a text under ``least`` characters, ``last``."""
    cleaned = {k: T.clean(v.cast("string")) for k, v in texts.items()}
    lacking = F.coalesce(*[F.when(F.length(F.coalesce(v, F.lit(""))) < least, F.lit(short)) for v in cleaned.values()])
    reason = F.coalesce(*[x for x in (skip, F.when(cls.isNull(), F.lit("unlabelled")), lacking, last) if x is not None])
    return {**cleaned, "cls": cls.cast("string"), "skip_reason": reason, "keys": F.array(T.key(*cleaned.values())), **(extra or {})}


c = F.col


def _plain(name: str) -> Column:
    """A text with written line breaks (backslash and n) as blanks."""
    return T.clean(F.replace(c(name).cast("string"), F.lit("\\n"), F.lit(" ")))


def _upper_share(x: Column) -> Column:
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return F.try_divide(F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")), letters)


#: Source -> columns of a mapped row.
MAPPERS: dict[str, Callable[[], dict[str, Column]]] = {
    **{n: (lambda: _mapped({"premise": c("premise"), "hypothesis": c("hypothesis")}, _class(c("label"), NLI))) for n in ("mnli", "anli")},
    "wanli": lambda: _mapped({"premise": c("premise"), "hypothesis": c("hypothesis")}, F.when(c("gold").isin(NLI), c("gold"))),
    "vitaminc": lambda: _mapped({"premise": c("evidence"), "hypothesis": c("claim")}, F.when(c("label") == "SUPPORTS", "entailment").when(c("label") == "REFUTES", "contradiction").when(c("label") == "NOT ENOUGH INFO", "neutral")),
    "scitail": lambda: _mapped({"premise": c("premise"), "hypothesis": c("hypothesis")}, F.when(c("label") == "entails", "entailment").when(c("label") == "neutral", "neutral")),
    "rte": lambda: _mapped({"premise": c("premise"), "hypothesis": c("hypothesis")}, _class(c("label"), ["entailment", "not_entailment"])),
    "squad_v2": lambda: _mapped({"passage": c("context"), "question": c("question")}, (F.size(c("answers.text")) > 0).cast("string")),
    "pubmedqa": lambda: _mapped({"passage": F.array_join(F.transform(c("context.contexts"), T.clean), " "), "question": c("question")}, F.when(c("final_decision").isin("yes", "no"), (c("final_decision") == "yes").cast("string")), last=F.when(_upper_share(T.clean(c("question"))) > 0.5, "malformed_question")),
    "qnli": lambda: _mapped({"passage": c("sentence"), "question": c("question")}, F.when(c("label").isin(0, 1), (c("label") == 0).cast("string"))),
    "multirc": lambda: _mapped({"passage": c("paragraph"), "question": c("question"), "answer": c("answer")}, F.when(c("label").isin(0, 1), (c("label") == 1).cast("string")), extra={"limit": T.key(c("paragraph"))}),
    "paws": lambda: _mapped({"a": c("sentence1"), "b": c("sentence2")}, F.when(c("label").isin(0, 1), (c("label") == 1).cast("string"))),
    **{n: (lambda: _mapped({"text": T.unescape(c("text"))}, F.when(c("label").isin(0, 1), (c("label") == 1).cast("string")))) for n in ("tweet_offensive", "tweet_hate", "tweet_irony")},
    "yahoo": lambda: _mapped({"text": F.concat_ws("\n", _plain("question_title"), F.nullif(_plain("question_content"), F.lit("")))}, F.when(c("topic") >= 0, c("topic"))),
    "newsgroups": lambda: _mapped({"text": F.left(T.clean(c("text")), F.lit(1200))}, c("label_text"), least=20),
    "dbpedia": lambda: _mapped({"text": c("content")}, F.when(c("label") >= 0, c("label")), extra={"title": T.clean(c("title"))}),
    "clinc": lambda: _mapped({"text": c("text")}, F.when(c("intent") >= 0, c("intent"))),
    **{n: (lambda: _mapped({"text": c("text")}, c("label_text"), extra={"keys": F.array(F.concat(F.lit("id:"), c("id").cast("string")), T.key(c("text")))})) for n in ("massive_intent", "massive_scenario")},
    "trec": lambda: _mapped({"text": c("text")}, F.when(c("label_text").isNotNull(), c("label_coarse_text")), extra={"fine": c("label_text")}),
    "go_emotions": lambda: _mapped({"text": c("text")}, F.when((F.size("labels") > 0) & F.forall("labels", lambda x: x >= 0), F.array_join(c("labels").cast("array<string>"), ","))),
    "emotion": lambda: _mapped({"text": c("text")}, F.when(c("label") >= 0, c("label"))),
    "amazon_reviews": lambda: _mapped({"text": c("text")}, F.when(c("label").between(0, 4), c("label"))),
    "tweet_sentiment": lambda: _mapped({"text": T.unescape(c("text"))}, F.when(c("label").between(0, 2), c("label"))),
    "civil_comments": lambda: _mapped({"text": c("text")}, F.when(c("toxicity").between(0, 1), civil_level(c("toxicity")))),
    "stsb": lambda: _mapped({"a": c("sentence1"), "b": c("sentence2")}, F.when(c("score").between(0, 1), stsb_level(c("score")))),
    "app_reviews": lambda: _mapped({"text": c("review")}, F.when(c("star").between(1, 5), c("star") - 1), least=40, short="too_short"),
    "ledgar": lambda: _mapped({"text": c("text")}, F.when(c("label") >= 0, c("label"))),
    "hwu64": lambda: _mapped({"text": c("text")}, c("label")),
    "fewrel": lambda: _mapped({"text": F.array_join("tokens", " "), "head": _mention(c("tokens"), c("head")), "tail": _mention(c("tokens"), c("tail"))}, c("relation")),
}


def normalised(source: str, rows: DataFrame, key: str = "row", labels: DataFrame | None = None) -> DataFrame:
    """source, row id, cleaned texts, cls (named by a label table, see ``labels.named``), keys and skip_reason. dailydialog takes one utterance a dialogue first."""
    return named(source, _mapped_rows(source, rows, key), labels)


def _mapped_rows(source: str, rows: DataFrame, key: str) -> DataFrame:
    if source == "dailydialog":
        from ..functions.hashing import uniform

        at = F.floor(uniform("dialogue", F.col(key)) * F.size("utterances")).cast("int")
        uneven = F.when((F.size("utterances") < 1) | (F.size("utterances") != F.size("acts")), "empty_text").alias("uneven")
        rows = rows.select(key, F.get("utterances", at).alias("text"), F.get("acts", at).alias("act"), uneven)
        return rows.select(F.lit(source).alias("source"), key, *[v.alias(k) for k, v in _mapped({"text": c("text")}, F.when(c("uneven").isNull() & (c("act") >= 0), c("act")), c("uneven"), least=2).items()])
    return rows.select(F.lit(source).alias("source"), key, *[v.alias(k) for k, v in MAPPERS[source]().items()])


def dialogue_acts(rows: DataFrame) -> DataFrame:
    """Share of utterances that end in a question mark, by act: a check that acts stand in the assumed order."""
    each = rows.select(F.explode(F.arrays_zip("utterances", "acts")).alias("z")).select(F.col("z.acts").alias("act"), T.strip(F.col("z.utterances")).endswith("?").cast("int").alias("q"))
    return each.groupBy("act").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("question_share"))


def acts_as_assumed(shares: DataFrame, question_act: int = 2) -> bool:
    rows = {r["act"]: r["question_share"] for r in shares.collect()}
    return rows.get(question_act, 0) >= 0.8 and all(v < 0.5 for k, v in rows.items() if k != question_act)
