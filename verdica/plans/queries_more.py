"""Queries over the documents for operators that others use: messages, escapes, clauses, labels, task rows, extra rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..curate import phrasing, synth
from ..functions import text as T
from ..operators import metrics, prompts
from .catalog import query, table
from .queries_prompts import STATE, questions

_TEXT = "coalesce(text, '')"
_STRIPPED = STATE.replace("text", _TEXT)


@query(f"SELECT doc_id::VARCHAR AS request_id, sha256({STATE} || chr(10) || chr(10) || 'Statement: It rains.' || chr(10) || 'Question: Is the statement true?' || chr(10) || 'A. Yes' || chr(10) || 'B. No: it does not' || chr(10) || 'Give only the letter of your answer.') AS message FROM documents")
def chat_messages(spark, sf):
    rows = prompts.with_prompt(questions(spark, sf, "noul", "It rains."))
    return rows.select("request_id", F.sha2(prompts.messages(F.col("state"), F.col("suffix")), 256).alias("message"))


@query(f"SELECT doc_id, sha256({_TEXT} || '😀') AS text FROM documents")
def unescaped_texts(spark, sf):
    """Accented letters and an emoji as escapes, which come back as they were."""
    escaped = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(f"\\u{ord(c):04x}")), "éèüöäßñç", F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.unescape(F.concat(escaped, F.lit("\\ud83d\\ude00"))), 256).alias("text"))


_HEAD = f"array_to_string(string_split(regexp_replace({_STRIPPED}, '\\s+', ' ', 'g'), ' ')[1:6], ' ')"
_CUT = "trim(regexp_replace(x, '[.!… ]+$', ''))"
_FIRST = f"string_split({_CUT}, ' ')[1]"


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'The ' WHEN doc_id % 3 = 1 THEN 'Some ' ELSE '' END || {_HEAD} || ' !.' AS x FROM documents)
SELECT doc_id, CASE WHEN lower({_FIRST}) IN ({", ".join(map(repr, phrasing.SAFE))}) AND {_FIRST} = upper(left({_FIRST}, 1)) || lower({_FIRST}[2:]) THEN lower(left({_CUT}, 1)) || {_CUT}[2:] ELSE {_CUT} END AS clause FROM d"""
)
def clauses(spark, sf):
    """Beginnings of documents as clauses: no end marks, and a small letter where a safe word begins."""
    head = F.array_join(F.slice(F.split(T.collapse(F.coalesce("text", F.lit(""))), " "), 1, 6), " ")
    start = F.when(F.col("doc_id") % 3 == 0, "The ").when(F.col("doc_id") % 3 == 1, "Some ").otherwise("")
    return table(spark, sf, "documents").select("doc_id", T.clause(F.concat(start, head, F.lit(" !.")), phrasing.SAFE).alias("clause"))


@query(
    f"""WITH i AS (SELECT lang AS domain, CASE WHEN doc_id % 9 = 0 THEN 'pay_loan_' ELSE 'i_' END || doc_id AS intent, {_TEXT} AS description, doc_id FROM documents WHERE lang <> 'es' OR doc_id % 8 = 0),
k AS (SELECT * FROM i WHERE NOT regexp_matches(replace(intent, '_', ' ') || ' ' || replace(description, '_', ' '), '{synth.BANKING}') AND doc_id % 4 <> 0)
SELECT domain, intent FROM (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM k) WHERE n >= {synth.MIN_LABELS}"""
)
def usable_labels(spark, sf):
    """Documents as intents of their language: without those on banking and the flagged ones; a language with too few left goes."""
    docs = table(spark, sf, "documents").where("lang <> 'es' OR doc_id % 8 = 0")
    name = F.concat(F.when(F.col("doc_id") % 9 == 0, "pay_loan_").otherwise("i_"), F.col("doc_id").cast("string"))
    rows = docs.select(F.col("lang").alias("domain"), name.alias("intent"), F.coalesce("text", F.lit("")).alias("description"), "doc_id")
    flags = rows.select("domain", "intent", (F.col("doc_id") % 4 == 0).alias("flag"))
    return synth.usable_labels(rows, flags).select("domain", "intent")


_LANG = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"


@query(
    f"""SELECT doc_id, task, sha256(CASE task WHEN 'boolq' THEN to_json({{'passage': {_TEXT}, 'question': lang || '?'}})::VARCHAR WHEN 'yelp' THEN left({_STRIPPED}, 2000) ELSE {_STRIPPED} END) AS state,
CASE task WHEN 'boolq' THEN (doc_id % 2 = 0)::INT WHEN 'sms_spam' THEN (doc_id % 3 = 1)::INT WHEN 'sst2' THEN (doc_id % 2)::INT ELSE {_LANG} END::INT AS label
FROM documents, (VALUES ('boolq'), ('sms_spam'), ('sst2'), ('ag_news'), ('banking77'), ('yelp')) AS t(task)"""
)
def task_rows(spark, sf):
    """Documents in the columns of each benchmark task, as its states and labels."""
    docs, text = table(spark, sf, "documents"), F.coalesce("text", F.lit(""))
    lang = F.expr(_LANG)
    columns = {
        "boolq": {"passage": text, "question": F.concat("lang", F.lit("?")), "answer": F.col("doc_id") % 2 == 0},
        "sms_spam": {"sms": text, "label": F.col("doc_id") % 3},
        "sst2": {"sentence": text, "label": F.col("doc_id") % 2},
        **{t: {"text": text, "label": lang} for t in ("ag_news", "banking77", "yelp")},
    }

    def one(task: str) -> DataFrame:
        rows = docs.select("doc_id", *[c.alias(k) for k, c in columns[task].items()])
        state, label = phrasing.TASKS[task]()
        return rows.select("doc_id", F.lit(task).alias("task"), F.sha2(state, 256).alias("state"), label.cast("int").alias("label"))

    return metrics.union_all([one(t) for t in columns])


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id % 5 = 0) AS extra, coalesce(sum(CASE WHEN doc_id % 5 = 0 THEN doc_id END), 0)::BIGINT AS weight FROM documents GROUP BY source")
def extra_rows(spark, sf):
    """Rows of another set with a column more, appended; those without it have none."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    both = metrics.union_all([docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0").withColumn("weight", F.col("doc_id"))])
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("extra"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
