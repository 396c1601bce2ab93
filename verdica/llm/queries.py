"""The registered queries of the corpus operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, licenses, mixing, mpeg, periodic, quality, simhash, substring, toxicity, transducer, whitening, wordbpe
from .common import native_words, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg.described(mpeg.stored(table(spark, sf_dir, "documents")))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extracted(pages, html.learn(pages))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_dedup.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """One text in ten, by its id, repeats a stretch of its own words up to its end."""
    h, w = F.crc32(F.col("doc_id").cast("string")), native_words(F.col("text"))
    n, g = F.size(w), F.floor(h / 10).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(w, F.lit(1), a), tail)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_made_periodic(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic.strongest())
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long: beyond some fifty million vectors it may not fit, and Spark raises an error rather than wrap it."""
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_ALL = (
    op1_quality_rules, op2_mpeg_audio, op3_mixing, op4_html_text, op5_license_scan, op6_token_counts, op7_substring_dedup, op8_simhash, op9_toxicity, op10_byte_bpe,
    op11_periodic_runs, op12_whitening, op13_word_bpe,
)
QUERIES = {f.__name__: f for f in _ALL}

_BLANK = r"[\x20\x09-\x0D]"

#: Word rules by brute force: windows of a text are grouped by their words. Stop words are counted word by word.
_OP1 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents
),
grams AS (SELECT row, i, w[i:i + 4] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY row),
stops AS (
    SELECT row, count(*) AS n FROM (SELECT row, unnest(w) AS x FROM d)
    WHERE regexp_matches(x, '(?i)^(?:{"|".join(sorted(quality.STOP_WORDS))})[.,;:!?]*$') GROUP BY row
),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT row, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n, 0) AS n_stops, coalesce(n_lines, 0) AS n_lines,
        length(t) - length(replace(t, '!', '')) AS n_exclamations
    FROM d LEFT JOIN covered c USING (row) LEFT JOIN stops s USING (row) LEFT JOIN lines USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars / n_words::DOUBLE BETWEEN 2 AND 14
    AND n_symbols / n_words::DOUBLE <= 0.1 AND n_exclamations / n_words::DOUBLE <= 0.3
    AND coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) <= 0.5 AND (n_words < 50 OR n_stops / n_words::DOUBLE >= 0.02) AS kept
FROM m
"""

#: The whole queue in one order, cut where the budget ends.
_OP3 = rf"""
WITH d AS (
    SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> ''))::BIGINT AS size,
        sha256(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''))) AS spot
    FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (
    SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER fill, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0)) AS level
    FROM w WINDOW fill AS (ORDER BY source_size / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT *, 3 * source_size <= level * weight AS filled, max(level) FILTER (WHERE NOT 3 * source_size <= level * weight) OVER () AS common FROM f),
t AS (SELECT source, source_size, rank, CASE WHEN sum(source_size) OVER () = 0 THEN 0.0 WHEN filled OR common IS NULL THEN (3 * source_size)::DOUBLE ELSE common * weight END AS target FROM l),
q AS (
    SELECT d.*, t.source_size, t.rank, t.target, (sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS finish
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (
    SELECT doc_id, size, sum(size) OVER (ORDER BY (source_size * e + finish)::DOUBLE / target, rank, finish, spot, doc_id ROWS UNBOUNDED PRECEDING) AS total
    FROM q, range(0, 3) AS r(e) WHERE size > 0 AND target > 0
),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

#: Every 50-word window of every text, grouped by its words.
_OP7 = rf"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents
),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 50) AS r(k)),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _OP1,
    "op3_mixing": _OP3,
    "op5_license_scan": licenses.oracle_sql(),
    "op7_substring_dedup": _OP7,
}
