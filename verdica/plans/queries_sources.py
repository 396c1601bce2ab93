"""One query a source: the documents in that source's columns through its mapper, beside the source's rules in SQL.

Inputs are SQL that both engines read alike, so each is written once; arrays and structures are given for Spark, and their
outcome by the rules for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..curate import labels as L
from ..curate import sources as S
from ..functions import hashing as H
from .catalog import query, table

T = "coalesce(text, '')"
#: Blank in one document of eleven.
SECOND = f"CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE split_part({T}, ' ', 2) END"
FIRST = f"split_part({T}, ' ', 1)"
MARK = "chr(92)"


def clean(x: str) -> str:
    return f"trim(replace({x}, chr(0), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def pick(names: list[str], place: str) -> str:
    """The name at a place from 0; null outside."""
    return f"CASE WHEN ({place}) >= 0 THEN [{', '.join(repr(n) for n in names)}][({place}) + 1] END"


def number(modulus: int, less: int = 1) -> str:
    return f"CAST(doc_id % {modulus} AS INT) - {less}"


def names_of(source: str) -> list[str]:
    return [r[3] for r in L.label_rows() if r[0] == source]


@dataclass(frozen=True)
class Case:
    """columns: of the source, in SQL. cls: what the rules make of them, null where unlabelled. texts: cleaned; the first is shown."""

    columns: dict[str, str]
    cls: str
    texts: tuple[str, ...]
    least: int = 1
    short: str = "empty_text"
    first: str = "text"
    before: str | None = None
    excluded: str | None = None
    last: str | None = None
    labels: str | None = None


def pair(a: str, b: str, label: str, sql: str, cls: str, first: str) -> Case:
    return Case({a: T, b: SECOND, label: sql}, cls, (T, SECOND), first=first)


def true_false(label: str, yes: int = 1) -> str:
    return f"CASE WHEN {label} IN (0, 1) THEN CASE WHEN {label} = {yes} THEN 'true' ELSE 'false' END END"


def some(*values: str) -> str:
    """One of the values, or null, by document."""
    return "CASE doc_id % " + str(len(values) + 1) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_UTTERANCE = f"CAST(floor({H.uniform_sql(chr(39) + 'dialogue' + chr(39), 'doc_id')} * 3) AS INT)"
_TWEET = f"'it' || {MARK} || 'u2019s ' || {T}"
_TWEET_TEXT = f"'it’s ' || {T}"
_TITLE = f"{FIRST} || {MARK} || 'n' || {SECOND}"
_CONTENT = f"CASE WHEN doc_id % 3 = 0 THEN {MARK} || 'n' ELSE {T} END"
_YAHOO = " || ".join((clean(f"replace({_TITLE}, {MARK} || 'n', ' ')"), f"CASE WHEN {clean(f'replace({_CONTENT}, {MARK} || {chr(39)}n{chr(39)}, {chr(39)} {chr(39)})')} = '' THEN '' ELSE chr(10) || {clean(f'replace({_CONTENT}, {MARK} || {chr(39)}n{chr(39)}, {chr(39)} {chr(39)})')} END"))
_GO = ["CAST(doc_id % 30 AS INT) - 1", "CAST(doc_id % 28 AS INT)"]
_SHOUTED = "CASE WHEN doc_id % 7 = 1 THEN upper({0}) ELSE {0} END".format(f"split_part({T}, ' ', 3)")
_TOXICITY = "CAST(doc_id % 23 AS DOUBLE) / 20"
_SCORE = "CAST(doc_id % 21 AS DOUBLE) / 18"
_ACTS = ["CAST(doc_id % 6 AS INT)", "2", "4"]

CASES: dict[str, Case] = {
    **{n: pair("premise", "hypothesis", "label", number(5), pick(S.NLI, number(5)), "premise") for n in ("mnli", "anli")},
    "wanli": pair("premise", "hypothesis", "gold", some("neutral", "entailment", "contradiction", "other"), f"nullif({some('neutral', 'entailment', 'contradiction', 'other')}, 'other')", "premise"),
    "vitaminc": pair("evidence", "claim", "label", some("SUPPORTS", "REFUTES", "NOT ENOUGH INFO", "?"), "CASE doc_id % 5 WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'neutral' END", "premise"),
    "scitail": pair("premise", "hypothesis", "label", some("entails", "neutral", "contradicts"), "CASE doc_id % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' END", "premise"),
    "rte": pair("premise", "hypothesis", "label", number(4), pick(["entailment", "not_entailment"], number(4)), "premise"),
    "squad_v2": Case({"context": T, "question": SECOND, "answers": "named_struct('text', filter(array('x'), x -> doc_id % 2 = 0))"}, "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END", (T, SECOND), first="passage"),
    "pubmedqa": Case(
        {"question": _SHOUTED, "context": f"named_struct('contexts', array({T}, 'Second part. '))", "final_decision": some("yes", "no", "maybe")},
        "CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END",
        (f"{clean(T)} || ' Second part.'", _SHOUTED), first="passage",
        last=f"length(regexp_replace({_SHOUTED}, '[^\\p{{Lu}}]', '', 'g')) * 2 > length(regexp_replace({_SHOUTED}, '[^\\p{{L}}]', '', 'g'))",
    ),
    "qnli": Case({"question": SECOND, "sentence": T, "label": number(4)}, true_false(f"({number(4)})", 0), (T, SECOND), first="passage"),
    "multirc": Case({"paragraph": T, "question": FIRST, "answer": SECOND, "label": number(4)}, true_false(f"({number(4)})"), (T, FIRST, SECOND), first="passage"),
    "paws": pair("sentence1", "sentence2", "label", number(4), true_false(f"({number(4)})"), "a"),
    **{n: Case({"text": _TWEET, "label": number(4)}, true_false(f"({number(4)})"), (_TWEET_TEXT,)) for n in ("tweet_offensive", "tweet_hate", "tweet_irony")},
    "yahoo": Case({"question_title": _TITLE, "question_content": _CONTENT, "topic": number(12)}, pick(names_of("yahoo"), number(12)), (_YAHOO,)),
    "newsgroups": Case({"text": f"left({T}, doc_id % 1500)", "label_text": some("sci.space", "rec.autos", "alt.unknown")}, "CASE doc_id % 4 WHEN 0 THEN 'space' WHEN 1 THEN 'cars' END", (f"left({clean(f'left({T}, doc_id % 1500)')}, 1200)",), least=20),
    "dbpedia": Case({"title": FIRST, "content": T, "label": number(16)}, pick(names_of("dbpedia"), number(16)), (T,)),
    "clinc": Case({"text": f"CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE {T} END", "intent": number(155)}, pick(names_of("clinc"), number(155)), (f"CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE {T} END",), excluded=f"list_contains({[x.replace('_', ' ') for x in L.CLINC_EXCLUDED]}, {pick(names_of('clinc'), number(155))})"),
    "massive_intent": Case({"id": "CAST(doc_id AS STRING)", "text": T, "label_text": some("alarm_set", "play_music")}, some("alarm_set", "play_music"), (T,)),
    "massive_scenario": Case({"id": "CAST(doc_id AS STRING)", "text": T, "label_text": some("datetime", "iot", "nothing known")}, "CASE doc_id % 4 WHEN 0 THEN 'date and time' WHEN 1 THEN 'smart home' END", (T,)),
    "trec": Case({"text": T, "label_coarse_text": some("entities", "human beings", "others"), "label_text": "CASE WHEN doc_id % 7 > 0 THEN 'fine' END"}, "CASE WHEN doc_id % 7 > 0 THEN CASE doc_id % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'person' END END", (T,)),
    "go_emotions": Case({"text": T, "labels": f"filter(array({_GO[0]}, {_GO[1]}), x -> doc_id % 9 > 0)"}, f"CASE WHEN doc_id % 9 > 0 AND {_GO[0]} BETWEEN 0 AND 27 THEN {pick(names_of('go_emotions'), _GO[0])} || ',' || {pick(names_of('go_emotions'), _GO[1])} END", (T,)),
    "emotion": Case({"text": T, "label": number(8)}, pick(names_of("emotion"), number(8)), (T,)),
    "dailydialog": Case(
        {"utterances": f"array({FIRST}, {SECOND}, {T})", "acts": f"slice(array({', '.join(_ACTS)}), 1, IF(doc_id % 13 = 0, 2, 3))"},
        f"CASE WHEN doc_id % 13 > 0 THEN CASE [{', '.join(_ACTS)}][{_UTTERANCE} + 1] WHEN 1 THEN 'inform' WHEN 2 THEN 'question' WHEN 3 THEN 'directive' WHEN 4 THEN 'commissive' END END",
        (f"[{FIRST}, {SECOND}, {T}][{_UTTERANCE} + 1]",), least=2, before="CASE WHEN doc_id % 13 = 0 THEN 'empty_text' END",
    ),
    "amazon_reviews": Case({"text": T, "label": number(7)}, f"CASE WHEN {number(7)} BETWEEN 0 AND 4 THEN CAST({number(7)} AS VARCHAR) END", (T,)),
    "stsb": Case({"sentence1": T, "sentence2": SECOND, "score": _SCORE}, f"CASE WHEN {_SCORE} <= 1 THEN CAST(CAST(floor(round(5 * {_SCORE}, 4) + 0.5) AS INT) AS VARCHAR) END", (T, SECOND), first="a"),
    "tweet_sentiment": Case({"text": _TWEET, "label": number(5)}, f"CASE WHEN {number(5)} BETWEEN 0 AND 2 THEN CAST({number(5)} AS VARCHAR) END", (_TWEET_TEXT,)),
    "civil_comments": Case({"text": T, "toxicity": _TOXICITY}, f"CASE WHEN {_TOXICITY} <= 0 THEN '0' WHEN {_TOXICITY} <= 0.300001 THEN '1' WHEN {_TOXICITY} <= 0.700001 THEN '2' WHEN {_TOXICITY} <= 1 THEN '3' END", (T,)),
    "ledgar": Case({"text": T, "label": number(27)}, "(SELECT n_name FROM nation WHERE n_nationkey = doc_id % 27 - 1)", (T,), labels="nation"),
    "fewrel": Case(
        {"relation": some("P17", "P31", "P50"), "tokens": f"split({T}, ' ')", "head": "named_struct('indices', array(array(0)))", "tail": "named_struct('indices', filter(array(array(1)), x -> doc_id % 6 > 0))"},
        some("P17", "P31", "P50"), (T, FIRST, f"CASE WHEN doc_id % 6 > 0 THEN split_part({T}, ' ', 2) ELSE '' END"),
    ),
    "hwu64": Case({"text": T, "label": some("alarm_set", "play_music")}, some("alarm_set", "play_music"), (T,)),
    "app_reviews": Case({"review": f"left({T}, doc_id % 300)", "star": number(8)}, f"CASE WHEN {number(8)} BETWEEN 1 AND 5 THEN CAST({number(8)} - 1 AS VARCHAR) END", (f"left({T}, doc_id % 300)",), least=40, short="too_short"),
}


def _oracle(case: Case) -> str:
    cleaned = [clean(t) for t in case.texts]
    short = " OR ".join(f"length(coalesce({t}, '')) < {case.least}" for t in cleaned)
    parts = [case.before, f"CASE WHEN ({case.excluded}) THEN 'excluded_intent' END" if case.excluded else None, f"CASE WHEN ({case.cls}) IS NULL THEN 'unlabelled' END", f"CASE WHEN {short} THEN '{case.short}' END", f"CASE WHEN {case.last} THEN 'malformed_question' END" if case.last else None]
    return f"SELECT doc_id AS row, {case.cls} AS cls, coalesce({', '.join(p for p in parts if p)}) AS skip_reason, {cleaned[0]} AS text FROM documents"


def _register(name: str) -> None:
    case = CASES[name]

    def run(spark, sf):
        given = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), *[F.expr(x).alias(c) for c, x in case.columns.items()])
        known = None
        if case.labels:
            known = table(spark, sf, case.labels).select(F.lit(name).alias("source"), F.col("n_nationkey").cast("string").alias("raw"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), F.lit(False).alias("excluded"))
        return S.normalised(name, given, labels=known).select("row", "cls", "skip_reason", F.col(case.first).alias("text"))

    run.__name__ = f"source_{name}"
    query(_oracle(case))(run)


for _name in CASES:
    _register(_name)
