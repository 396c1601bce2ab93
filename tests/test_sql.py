"""The SQL functions against the column expressions they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdica import sql
from verdica.functions import hashing as H
from verdica.functions import probs as P
from verdica.functions import text as T

TEXTS = ["", " A  b\tC. ", "One two three four five six seven eight nine", "é Ü x!? ", None, "\n\n"]


def test_texts_like_columns(spark):
    sql.register(spark)
    sql.register(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, s string")
    rows.createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, v_key(s) AS k, v_norm(s) AS n, v_words(s) AS w, v_tokens(s) AS t, v_order('a', CAST(id AS STRING)) AS o, v_draw('a', CAST(id AS STRING)) AS u, v_grams(s, 3) AS g FROM texts").collect()
    s = F.col("s")
    want = rows.select("id", F.when(s.isNotNull(), T.key(s)).alias("k"), F.when(s.isNotNull(), T.norm_text(s)).alias("n"), T.words(s).alias("w"), T.token_proxy(s).alias("t"), H.order_key("a", F.col("id")).alias("o"), H.uniform("a", F.col("id")).alias("u"), T.ngrams(T.words(s), 3).alias("g")).collect()
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:7] == b[:7]
        if a.w is not None:
            assert set(a.g) == {"=" + " ".join(a.w), *b.g}


def test_scores_like_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(0, [1.0, 2.0, -3.0], 1), (1, [0.0, 0.0], 0), (2, [800.0, -800.0, 1.0], 2)], "id int, logits array<double>, label int")
    rows.createOrReplaceTempView("scored")
    got = {r.id: r for r in spark.sql("SELECT id, p, v_top(p) AS top, round(v_nll(p, label), 9) AS nll, round(v_brier(p, label), 9) AS brier, round(v_confidence(p), 9) AS c FROM (SELECT *, v_softmax(logits, 1D) AS p FROM scored)").collect()}
    p = P.softmax(F.col("logits"))
    for r in rows.withColumn("p", p).select("id", "p", F.round(P.nll(F.col("p"), F.col("label")), 9).alias("nll"), F.round(P.brier(F.col("p"), F.col("label")), 9).alias("brier"), F.round(P.confidence(F.col("p")), 9).alias("c")).collect():
        assert all(abs(x - y) < 1e-12 for x, y in zip(got[r.id].p, r.p, strict=True)) and got[r.id].top == r.p.index(max(r.p))
        assert (got[r.id].nll, got[r.id].brier, got[r.id].c) == (r.nll, r.brier, r.c)


def test_functions_stay_compiled(spark):
    """A scalar is written into the plan: no Python there."""
    plan = sql.run(spark, "SELECT v_key(CAST(id AS STRING)) AS k, v_draw('x', CAST(id AS STRING)) AS u FROM range(9)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Project" in plan
