"""Queries over renderings, demos, reports and checks of sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..curate import verify
from ..functions import text as T
from ..operators import calibrate, metrics, prompts, schema
from ..sources import rows as R
from . import report
from .catalog import query, table
from .queries_scores import SIG, _metric_sql, _parts, _platt_sql, _temperature_sql, dims, rounded


@query("""SELECT doc_id::VARCHAR AS request_id, '{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || '  "lang": "' || coalesce(lang, '-') || '"' || chr(10) || '}' AS state, true AS state_is_json FROM documents""")
def rendered_states(spark, sf):
    """States given as JSON objects, as the text that prompts show."""
    state = F.to_json(F.struct(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("-")).alias("lang")))
    body = F.concat(F.lit('{"state": '), state, F.lit(', "model": "m", "questions": {"q": {"type": "noul", "instructions": "x"}}}'))
    return schema.parsed(table(spark, sf, "documents").select("doc_id", body.alias("body")), "doc_id").select("request_id", "state", "state_is_json")


@query("SELECT doc_id, sha256(replace(replace('<|im_end|> <<||>> ' || coalesce(text, ''), '<|', '< |'), '|>', '| >')) AS safe FROM documents")
def neutralised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.neutralise(F.concat(F.lit("<|im_end|> <<||>> "), F.coalesce("text", F.lit("")))), 256).alias("safe"))


_DEMOS = """o AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation), d AS (SELECT n_nationkey::INT AS j, n_regionkey, n_name, names FROM nation, o),
w AS (SELECT *, least(greatest(j - j % 10, 0), len(names) - 10) AS start FROM d)"""


def _demos(spark, sf):
    nation = table(spark, sf, "nation")
    names = nation.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("names"))
    return nation.select(F.col("n_nationkey").cast("int").alias("j"), "n_regionkey", "n_name").crossJoin(names)


@query(f"WITH {_DEMOS} SELECT j, array_to_string(names[start + 1:start + 10], ',') AS options, (j - start)::INT AS answer, names[(j + j % 2) % len(names) + 1] AS option, (j % 2)::INT AS label FROM w")
def demo_windows(spark, sf):
    """Worked examples over many options cut to ten around the gold one, and as yes/no ones."""
    options, answer = prompts.fit_window(F.col("names"), F.col("j"), F.col("j"), 10)
    option, label = prompts.as_candidate(F.col("names"), F.col("j"), F.col("j"))
    return _demos(spark, sf).select("j", F.array_join(options, ",").alias("options"), answer.cast("int").alias("answer"), option.alias("option"), label.alias("label"))


@query(
    f"""WITH {_DEMOS}, t AS (SELECT n_regionkey, j, 'A town in ' || n_name || chr(10) || chr(10) || 'Question: Where?' || chr(10) || array_to_string(list_transform(range(1, 11), lambda i: chr((64 + i)::INT) || '. ' || names[start + i]), chr(10)) || chr(10) || 'Answer: ' || chr((65 + j - start)::INT) || chr(10) || chr(10) AS text FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY j) AS r FROM t) SELECT n_regionkey, sha256(string_agg(text, '' ORDER BY j)) AS prefix FROM r WHERE r <= 3 GROUP BY n_regionkey"""
)
def demo_prefixes(spark, sf):
    """Three worked examples in a row before a prompt."""
    options, answer = prompts.fit_window(F.col("names"), F.col("j"), F.col("j"), 10)
    text = prompts.demo_text(F.concat(F.lit("A town in "), "n_name"), F.lit("Question: Where?"), options, answer.cast("int"))
    rank = F.rank().over(Window.partitionBy("n_regionkey").orderBy("j")) - 1
    demos = _demos(spark, sf).select("n_regionkey", "j", text.alias("text")).select("n_regionkey", "text", rank.alias("ord"))
    return prompts.demo_prefix(demos, ["n_regionkey"], 3).select("n_regionkey", F.sha2("prefix", 256).alias("prefix"))


def _run(where: str, name: str) -> str:
    return f"SELECT '{name}' AS run_id, n, accuracy, nll, brier, ece FROM ({_metric_sql(10, 'label', where=where)})"


@query(f"{_run('vec_id % 4 = 1', 'a')} UNION ALL {_run('vec_id % 4 = 3', 'b')}")
def report_files(spark, sf):
    """The report of two runs, one without calibration rows, read back from its files."""
    ids = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 == 3, "b").otherwise("a").alias("run_id"), "label", dims(1, 10).alias("logits"))
    rows = ids.select("run_id", F.lit("choice").alias("kind"), F.lit("letter").alias("stage"), F.when(F.col("vec_id") % 2 == 1, "test").otherwise("calib").alias("split"), "label", "logits", F.lit(None).cast("array<array<double>>").alias("cycle_logits"), F.lit(1.0).alias("latency_ms"), F.lit(1).alias("prompt_tokens"), F.lit(False).alias("truncated"))
    out = R.folder(spark)
    report.write_report(rows, out)
    at = lambda name, kind="double": F.get_json_object("value", f"$.raw.{name}").cast(kind).alias(name)
    return rounded(spark.read.text(f"{out}/summary").select(F.get_json_object("value", "$.run_id").alias("run_id"), at("n", "long"), at("accuracy"), at("nll"), at("brier"), at("ece")))


@query(f"SELECT round((WITH {_temperature_sql()} SELECT t FROM fitted), 4) AS choice_t, round((WITH {_platt_sql()} SELECT a FROM fitted), 4) AS noul_a, round((WITH {_platt_sql()} SELECT b FROM fitted), 4) AS noul_b")
def calibrator_file(spark, sf):
    """A calibrator fitted over runs of both kinds, as JSON and back."""
    both = metrics.union_all([_parts(spark, sf, "choice"), _parts(spark, sf, "noul")])
    cal = calibrate.Calibrator.from_json(calibrate.pooled_calibrator(both).to_json())
    return spark.createDataFrame([(round(cal.choice_T, 4), round(cal.noul_a, 4), round(cal.noul_b, 4))], "choice_t double, noul_a double, noul_b double")


@query("SELECT 'embeddings' AS part, count(*) AS n, count(vec_id) AS ids FROM embeddings UNION ALL SELECT 'documents', count(*), 0 FROM documents")
def union_of_parts(spark, sf):
    """Tables of differing columns one below the other; what one lacks is null."""
    parts = [table(spark, sf, "embeddings").select(F.lit("embeddings").alias("part"), "vec_id"), table(spark, sf, "documents").select(F.lit("documents").alias("part"), "lang")]
    return metrics.union_all(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("ids"))


@query(
    """SELECT 'answers are spans of the context' AS check, count(*) FILTER (WHERE doc_id % 3 > 0) AS n, count(*) FILTER (WHERE doc_id % 3 > 0 AND doc_id % 7 = 0) AS bad FROM documents WHERE length(text) > 9
UNION ALL SELECT 'both answerable and unanswerable', 1, 0 UNION ALL SELECT 'values within [0, 1]', count(*), count(*) FILTER (WHERE doc_id % 101 > 100 * 0.9) FROM documents
UNION ALL SELECT 'a fine label has one coarse label', count(DISTINCT lang), 0 FROM documents"""
)
def content_checks(spark, sf):
    docs = table(spark, sf, "documents")
    answer = F.when(F.col("doc_id") % 7 == 0, "not in any text \u0001").otherwise(F.substring("text", 2, 6))
    squad = docs.where(F.length("text") > 9).select(F.col("text").alias("context"), F.struct(F.when(F.col("doc_id") % 3 > 0, F.array(answer)).otherwise(F.array().cast("array<string>")).alias("text")).alias("answers"))
    civil = docs.select(((F.col("doc_id") % 101) / 90).alias("toxicity"))
    trec = docs.where("lang IS NOT NULL").select(F.col("lang").alias("label_text"), F.left("lang", F.lit(1)).alias("label_coarse_text"))
    found = [verify.content_faults(name, rows) for name, rows in (("squad_v2", squad), ("civil_comments", civil), ("trec", trec))]
    return metrics.union_all(found).select("check", "n", "bad")


@query("SELECT * FROM (VALUES ('fits', ''), ('strange', 'unknown classes'), ('empty', 'classes without rows'), ('skipped', 'too many rows without a class'), ('none', 'no rows')) AS v(case_, said)")
def source_checks(spark, sf):
    """Which mapped sources pass, and why the others don't."""
    mapped = table(spark, sf, "nation").select(F.lit("s").alias("source"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("cls"), F.lit(None).cast("string").alias("skip_reason"))
    skipping = mapped.withColumn("skip_reason", F.when(F.col("cls") == "odd", "empty_text"))
    said = []
    for name, rows, classes in (("fits", mapped, ["even", "odd"]), ("strange", mapped, ["even"]), ("empty", mapped, ["even", "odd", "third"]), ("skipped", skipping, None), ("none", mapped.limit(0), None)):
        try:
            verify.check_source(rows, classes)
            said.append((name, ""))
        except ValueError as e:
            said.append((name, str(e).split(" [")[0]))
    return spark.createDataFrame(said, "case_ string, said string")


@query("SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'benchmark_instruction' END, CASE WHEN doc_id % 7 = 0 THEN 'forbidden_wrapper' END, CASE WHEN doc_id % 11 = 0 THEN 'label' END, CASE WHEN doc_id % 4 = 3 THEN 'type' END) AS errors FROM documents")
def example_checks(spark, sf):
    """The guards that finished rows break."""
    i = F.col("doc_id")
    ins = F.when(i % 5 == 0, "Is it SPAM?").otherwise("Which one is it?")
    label = F.when(i % 11 == 0, 3).otherwise((i % 3).cast("int"))
    family = F.when(i % 4 == 3, "nli").otherwise("choice")
    options = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    errors = verify.example_errors(ins, options, F.lit("choice"), family, label, F.lit(None).cast("string"), ["is it spam"], "Review: ", F.when(i % 7 == 0, "Review: good").otherwise("good"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(errors, ",").alias("errors"))


_WORDS = f"w AS (SELECT 'w' || (vec_id % 3) AS wording, vec_id, label % 2 AS y, embedding[1]::DOUBLE - embedding[2]::DOUBLE AS m FROM embeddings WHERE vec_id // 3 % 2 = 1), p AS (SELECT *, {SIG.format('m')} AS p, rank() OVER (PARTITION BY wording ORDER BY m) + (count(*) OVER (PARTITION BY wording, m) - 1) / 2.0 AS r, count(*) FILTER (WHERE y = 1) OVER (PARTITION BY wording) AS pos, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY wording) AS neg FROM w)"


@query(f"WITH {_WORDS} SELECT wording, count(*) AS n, round((sum(r) FILTER (WHERE y = 1) - max(pos) * (max(pos) + 1) / 2.0) / (max(pos) * max(neg)), 6) AS auroc, round(avg(((m >= 0) = (y = 1))::INT), 6) AS accuracy, round(avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))), 6) AS nll, round(avg((m >= 0)::INT), 6) AS yes_rate, round(avg(y), 6) AS true_rate FROM p GROUP BY wording")
def wording_comparison(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("w"), (F.col("vec_id") % 3).cast("string")).alias("wording"), F.col("vec_id").alias("id"), F.when(F.floor(F.col("vec_id") / 3) % 2 == 1, "test").otherwise("calib").alias("split"), dims(1, 2).alias("logits"), (F.col("label") % 2).cast("int").alias("label"))
    return rounded(verify.wording_table(rows).select("wording", "n", "auroc", "accuracy", "nll", "yes_rate", "true_rate"))


@query(
    """WITH w AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS w FROM documents)
SELECT doc_id, len(w) + 2 > 40 AS truncated, least(len(w) + 2, 40)::INT AS n_tokens, sha256('Read: ' || CASE WHEN len(w) + 2 > 40 THEN '… ' || trim(array_to_string(w[len(w) - 36:], ' ')) ELSE array_to_string(w, ' ') END || ' Answer:') AS prompt FROM w"""
)
def fitted_prompts(spark, sf):
    """States cut from the left to forty tokens, where a token is a word and its id the number that its bytes make: no vocabulary grows with the table."""

    def encode(text: str) -> list[int]:
        return [int.from_bytes(b"." + w.encode()) for w in text.split(" ")]

    def decode(ids: list[int]) -> str:
        return " ".join(i.to_bytes(i.bit_length() + 7 >> 3)[1:].decode() for i in ids)

    one_line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f]+", " ")
    rows = table(spark, sf, "documents").select("doc_id", F.lit("Read: ").alias("prefix"), one_line.alias("state"), F.lit(" Answer:").alias("suffix"))
    return prompts.fitted(rows, encode, decode, 40, "doc_id").select("doc_id", "truncated", "n_tokens", F.sha2("prompt", 256).alias("prompt"))


@query("SELECT 'train' AS split, count(*) AS n FROM nation UNION ALL SELECT 'test', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'dev', 0")
def source_splits(spark, sf):
    """A source's splits below a pinned revision; one that isn't there is refused."""
    from ..curate import sources

    root = R.folder(spark)
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("text"), F.col("n_regionkey").cast("string").alias("label"), "n_regionkey")
    rows.write.parquet(f"{root}/rev1/train")
    rows.where("n_regionkey = 1").write.parquet(f"{root}/rev1/test")
    found = []
    for split in ("train", "test", "dev"):
        try:
            found.append((split, sources.load(spark, "hwu64", root, split, "rev1").count()))
        except ValueError:
            found.append((split, 0))
    return spark.createDataFrame(found, "split string, n long")
