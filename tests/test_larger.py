"""What only shows on odd rows, larger tables or other splits of the input."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from oracle_check import connect, digest
from verdica.curate import guards, synth
from verdica.functions import text
from verdica.operators import analysis, prompts
from verdica.plans import catalog


def tables(path, **given) -> str:
    """A folder of tables: those given, else the smallest ones."""
    for name, rows in given.items():
        rows.write.parquet(f"{path}/{name}.parquet")
    for file in glob.glob("/root/testdata/sf0.001/*.parquet"):
        if not os.path.exists(to := f"{path}/{os.path.basename(file)}"):
            os.symlink(file, to)
    return str(path)


def like_sql(spark, sf: str, name: str) -> None:
    assert digest(catalog.QUERIES[name](spark, sf).toPandas()) == digest(connect(sf).sql(catalog.ORACLE_SQL[name]).df())


@pytest.fixture
def settings(spark):
    before = {}

    def change(name: str, value: str) -> None:
        before[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def documents(spark, *texts: str):
    return spark.createDataFrame([(i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_lines_with_quotes(spark, tmp_path):
    sf = tables(tmp_path, documents=documents(spark, 'a line\n- token = "2b0c"\n"all of it quoted"\n3) “so is this”', "plain words"))
    like_sql(spark, sf, "parse_utterances")


def test_a_source_stays_in_one_file(spark, tmp_path, settings):
    """Documents come in several pieces, and the join by source is one that turns into a broadcast while it runs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartitionByRange(4, "doc_id")
    sf = tables(tmp_path, documents=docs)
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    settings("spark.sql.files.openCostInBytes", "100000")
    like_sql(spark, sf, "raw_score_files")


def test_equal_means_are_not_above(spark):
    """A later mean of the same values in another order."""
    values = [0.1, 0.7, 0.3, 1.1, 2.3] * 10
    log = spark.createDataFrame(list(enumerate(values + [5.0] * 60 + values[::-1])), "step int, loss double")
    last = analysis.stop_rules(log).where("step = 159").first()
    assert last["trailing"] == pytest.approx(last["first_mean"]) and not last["above_first"]
    above = analysis.stop_rules(log).where("above_first").agg(F.min("step"), F.max("step")).first()
    assert above[0] == 149 and above[1] < 159


def test_escapes_without_python(spark):
    """As the plain function does, lone halves of pairs and long runs too, with no Python stage."""
    texts = ["", None, "a\\u0041", "\\ud83d\\ude00x", "\\ud83dx\\ude00", "\\ud83d\\ud83d\\ude00\\ude00", "\\\\u00e9\\u00E9\\u00g1\\u", "\\u0000\\u000a|", "\\u4e2d" * 5000, "$1 \\u0024 \\"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.unescape(F.col("t")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == [text.unescaped(t) for t in texts]
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_stand_in_tokens_need_no_vocabulary(spark, monkeypatch):
    """Ids and words of the stand-in tokenizer come from each other, so decoding costs what it gives."""
    got = []
    monkeypatch.setattr(prompts, "fitted", lambda rows, encode, decode, *_: got.extend((encode, decode)) or rows.select("doc_id", F.lit(True).alias("truncated"), F.lit(0).alias("n_tokens"), F.lit("").alias("prompt")))
    catalog.QUERIES["fitted_prompts"](spark, "/root/testdata/sf0.001")
    encode, decode = got
    assert decode(encode("naïve  é 中 a")[-5:]) == "naïve  é 中 a"
    assert not encode.__closure__ and not decode.__closure__


def test_no_text_goes_with_each_label(spark):
    """What labels of an utterance are dealt by is short, and few sets of examples meet their questions without an exchange."""
    said = spark.createDataFrame([("d", "a", 1, "one"), ("d", "b", None, "two"), ("d", "a", 1, "three")], "domain string, intent string, n long, text string")
    labels = spark.createDataFrame([("d", x, i) for i, x in enumerate("abcd")], "domain string, intent string, place int")
    rows = synth.decision_rows(said, labels, lambda p: p.withColumn("margin", F.col("place").cast("double")), "s", 2)
    assert {(r.n, r.state, r.gold_rank) for r in rows.collect()} == {(1, "one", 3), (None, "two", 2), (1, "three", 3)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(" text#" in f" {line.split('hashpartitioning')[1].replace('(', ' ')}" for line in plan.splitlines() if "hashpartitioning" in line)


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    """Rounds that settle next to nothing give way to ranges of rows, one after the other, each of bounded size."""
    wide = [(i, [f"k{i}", f"k{i + 1}", f"h{i % 97}" if i % 5 == 0 else "k%d" % i]) for i in range(600)]
    rows = spark.createDataFrame(wide, "id int, keys array<string>").repartition(3)
    used, kept = set(), []
    for i, keys in wide:
        if not used & set(keys):
            used |= set(keys)
            kept.append(i)
    written = []
    folder = guards.folder
    monkeypatch.setattr(guards, "folder", lambda s: written.append(1) or folder(s))
    assert sorted(r.id for r in guards.independent_rows(rows, "keys", "id", at_once=300).collect()) == kept
    assert len(written) < 40
