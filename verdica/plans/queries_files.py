"""Queries over files made from the documents: decision files with planted faults, raw scores with torn tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import decisions as D
from ..sources import rows as R
from ..sources.rows import folder
from .catalog import query, table

_OPTIONS = ["de", "en", "es", "fr"]

#: Faults by document, the first that holds: (condition, path, message). The line keeps what its condition spoils.
_FAULTS = [
    ("doc_id % 41 = 3", None, "invalid JSON"),
    ("doc_id % 37 = 3", "extra", "unknown key"),
    ("doc_id % 31 = 3", None, "label is required"),
    ("doc_id % 29 = 3", "state", "must be a string, object or array"),
    ("doc_id % 23 = 3", "question.instructions", "must not be empty"),
    ("doc_id % 19 = 3", "question.type", None),
    ("lang = 'fr' AND doc_id % 3 = 1", "label", "must be the name of an option"),
    ("doc_id % 17 = 3", "id", "must be a text that is not empty"),
]


@query(
    f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM documents),
f AS (SELECT *, {"CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(_FAULTS)) + " END"} AS fault FROM d),
k AS (SELECT arg_min(CASE WHEN doc_id % 19 = 3 THEN 'noul' ELSE 'choice' END, (source, line)) AS kind FROM f WHERE fault IS NULL OR fault >= 5),
g AS (
    SELECT source, line, fault, CASE WHEN fault IS NULL THEN CASE WHEN doc_id % 7 = 0 THEN 'id' || doc_id // 14 ELSE 'docs/' || line END END AS given,
        list_position({_OPTIONS!r}, lang) - 1 AS label, CASE WHEN doc_id % 19 = 3 THEN 'noul' ELSE 'choice' END AS type, octet_length(encode(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)))) AS n_bytes
    FROM f
),
h AS (SELECT *, first_value(line) OVER w AS first_line, first_value(source) OVER w AS first_source FROM g WINDOW w AS (PARTITION BY given ORDER BY source, line))
SELECT source, line,
    CASE WHEN (fault IS NULL OR fault >= 5) AND type <> kind THEN 'question.type' WHEN fault IS NOT NULL THEN [{", ".join(repr(p or "") for _, p, _ in _FAULTS)}][fault + 1] WHEN (source, line) <> (first_source, first_line) THEN 'id' END AS error_path,
    CASE WHEN (fault IS NULL OR fault >= 5) AND type <> kind THEN 'type differs from earlier rows: ' || kind WHEN fault IS NOT NULL THEN [{", ".join(repr(m) if m else "NULL" for _, _, m in _FAULTS)}][fault + 1]
        WHEN (source, line) <> (first_source, first_line) THEN 'repeats the id of line ' || first_line END AS error,
    CASE WHEN fault IS NULL AND (source, line) = (first_source, first_line) AND type = kind THEN label ELSE -1 END::INT AS label,
    CASE WHEN fault IS NULL OR fault >= 5 THEN n_bytes ELSE -1 END::INT AS state_bytes
FROM h CROSS JOIN k"""
)
def decision_lines(spark, sf):
    """A file a source with its documents as decisions, by id; each fault with its line."""
    docs = table(spark, sf, "documents")
    at = {i: F.coalesce(F.expr(c), F.lit(False)) for i, (c, _, _) in enumerate(_FAULTS)}
    text = lambda x: F.get(F.regexp_extract_all(F.to_json(F.struct(x.alias("x"))), F.lit(r'(?s)^\{"x":(.*)\}$'), F.lit(1)), F.lit(0))
    option = F.lit('"criteria":{' + ",".join(f'"{o}":null' for o in _OPTIONS) + "}")
    instructions = F.when(at[4], F.lit(' " " ')).otherwise(F.lit('"Which language?"'))
    noul = at[5]
    question = F.concat(F.lit('{"type":'), F.when(noul, F.lit('"noul"')).otherwise(F.lit('"choice"')), F.lit(',"instructions":'), instructions, F.when(noul, F.lit("")).otherwise(F.concat(F.lit(","), option)), F.lit("}"))
    label = F.when(noul, F.lit("true")).when(at[6], F.lit('"unknown"')).otherwise(text(F.col("lang")))
    own = F.when(at[7], F.lit('"id":7,')).when(F.col("doc_id") % 7 == 0, F.concat(F.lit('"id":"id'), F.floor(F.col("doc_id") / 14).cast("string"), F.lit('",'))).otherwise(F.lit(""))
    state = F.when(at[3], F.lit("5")).otherwise(text(F.coalesce("text", F.lit(""))))
    line = F.concat(F.lit("{"), own, F.when(at[1], F.lit('"extra":1,')).otherwise(F.lit("")), F.lit('"state":'), state, F.lit(',"question":'), question, F.when(at[2], F.lit("")).otherwise(F.concat(F.lit(',"label":'), label)), F.when(at[0], F.lit("")).otherwise(F.lit("}")))
    path = folder(spark)
    docs.select("source", "doc_id", line.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(path)
    rows = D.checked_lines(spark, path, "docs")
    source = F.regexp_extract("file", "/source=([^/]*)/", 1)
    good = F.col("error").isNull()
    return rows.select(source.alias("source"), "line", "error_path", "error", F.when(good, F.col("label")).otherwise(-1).alias("label"), F.coalesce(F.octet_length("state"), F.lit(-1)).alias("state_bytes"))


@query(
    """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, line, doc_id::VARCHAR AS id, doc_id / 8.0::DOUBLE AS logit FROM d WHERE line < n OR right(source, 1) IN ('0', '2', '4', '6', '8')"""
)
def raw_score_files(spark, sf):
    """A file of raw scores a source; every other one ends in the middle of its last line, which alone goes."""
    docs = table(spark, sf, "documents")
    row = F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('","split":"test","label":1,"kind":"noul","logits":['), (F.col("doc_id") / 8).cast("string"), F.lit(",0.0]"))
    last = F.col("doc_id") == F.col("last")
    whole = F.substring("source", -1, 1).isin("0", "2", "4", "6", "8")
    ends = docs.groupBy("source").agg(F.max("doc_id").alias("last"))
    # the writer ends each row with a blank; the row before closes with brace and line feed
    value = F.concat(row, F.when(last, F.when(whole, F.lit("}\n")).otherwise(F.lit(',"prom'))).otherwise(F.lit("}\n")))
    path = folder(spark)
    # ends, a row a source, go to every task: after an exchange by source the repartition would be left out, and a source's rows come in several files
    docs.join(F.broadcast(ends), "source").select("source", "doc_id", value.alias("value")).repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").option("lineSep", " ").text(path)
    rows = R.read_raw(spark, f"{path}/*/*.txt")
    of = docs.select(F.col("doc_id").cast("string").alias("id"), "source")
    return rows.join(of, "id").select("source", "line", "id", F.get("logits", F.lit(0)).alias("logit"))
