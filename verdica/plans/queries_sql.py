"""Queries written as SQL text, through the functions that ``sql.register`` makes known."""

from __future__ import annotations

from .. import sql
from .catalog import ORACLE_SQL, query
from .queries_curation import text_key  # noqa: F401  its oracle and those of the other queries serve here too
from .queries_scores import metrics_choice  # noqa: F401


@query(ORACLE_SQL["text_key"])
def sql_text_key(spark, sf):
    return sql.run(spark, "SELECT doc_id, sha2(v_key(coalesce(text, '')), 256) AS key, sha2(v_norm(text), 256) AS norm, size(v_words(text)) AS n_words FROM documents", sf, ("documents",))


@query(ORACLE_SQL["metrics_choice"])
def sql_metrics(spark, sf):
    """Accuracy, likelihood, Brier score and calibration error in one text."""
    text = """
    WITH p AS (SELECT label, v_softmax(transform(slice(embedding, 1, 10), x -> CAST(x AS DOUBLE)), 1D) AS probs FROM embeddings),
    r AS (SELECT CAST(v_top(probs) = label AS INT) AS hit, array_max(probs) AS conf, v_nll(probs, label) AS nll, v_brier(probs, label) AS brier FROM p),
    b AS (SELECT v_bin(conf) AS bin, count(*) AS c, abs(avg(hit) - avg(conf)) AS gap FROM r GROUP BY 1),
    e AS (SELECT round(sum(c * gap) / sum(c), 6) AS ece FROM b)
    SELECT n, accuracy, nll, brier, ece FROM (SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM r) CROSS JOIN e"""
    return sql.run(spark, text, sf, ("embeddings",))


@query(ORACLE_SQL["class_quota"])
def sql_quota(spark, sf):
    """The first rows of each class in seeded order, as many as its quota."""
    text = """
    WITH r AS (SELECT doc_id, CAST(quality AS INT) AS quality, row_number() OVER (PARTITION BY quality ORDER BY v_order('q', CAST(doc_id AS STRING))) AS r FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, quality FROM r WHERE r <= 21 AND r <= IF(quality = 1, 19, 21)"""
    return sql.run(spark, text, sf, ("documents", "labels"))


@query(ORACLE_SQL["ngram_guard"])
def sql_guard(spark, sf):
    """Documents that repeat a benchmark text or share eight words in a row with one."""
    return sql.run(spark, sql.GUARD, sf, ("documents", "benchmark"))


@query(ORACLE_SQL["pack_batches"])
def sql_pack(spark, sf):
    """Batches by a table function over ordered partitions."""
    text = """
    SELECT grp AS lang, id AS doc_id, length AS n_chars, batch
    FROM v_pack(TABLE(SELECT lang, doc_id, n_chars FROM documents) PARTITION BY lang ORDER BY (n_chars DESC, doc_id), 20000)"""
    return sql.run(spark, text, sf, ("documents",))
