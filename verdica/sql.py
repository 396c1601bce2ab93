"""SQL text interface: functions and table functions that a session knows after ``register(spark)``.

Scalars are SQL functions: Spark writes their bodies into the query, so they cost what the same expression costs in a DataFrame and stay
within compiled stages. ``v_pack`` is a table function in Python, since its outcome depends on the rows before; it gets each group's rows
in order and keeps two numbers. Named views (``with_tables``) make a folder's tables known.

Nulls give nulls, as in SQL; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .curate.guards import NGRAM
from .functions.text import SPACE
from .operators.metrics import BINS

_BLANKS = SPACE.replace("\\", "\\\\")
_KEY = f"lower(regexp_replace(regexp_replace(s, '{_BLANKS}+', ' '), '^ | $', ''))"



def _let(value: str, name: str, body: str) -> str:
    """Binds a value once: what stands in a lambda is computed for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Name, parameters, result, body.
FUNCTIONS = [
    ("v_key", "s STRING", "STRING", _KEY),
    ("v_norm", "s STRING", "STRING", "regexp_replace(v_key(s), '[.?! ]+$', '')"),
    ("v_words", "s STRING", "ARRAY<STRING>", "regexp_extract_all(lower(s), '[a-z0-9]+', 0)"),
    ("v_grams", "s STRING, n INT", "ARRAY<STRING>", _let("v_words(s)", "w", "array_distinct(concat(array('=' || array_join(w, ' ')), IF(size(w) >= n, transform(sequence(1, greatest(size(w) - n + 1, 1)), i -> array_join(slice(w, i, n), ' ')), array())))")),
    ("v_tokens", "s STRING", "BIGINT", "CAST(ceil(length(s) / 2.2D) + 3 AS BIGINT)"),
    ("v_order", "seed STRING, id STRING", "STRING", "sha2(concat_ws(':', seed, id), 256)"),
    ("v_draw", "seed STRING, id STRING", "DOUBLE", f"CAST(conv(substring(v_order(seed, id), 1, 13), 16, 10) AS DOUBLE) / {1 << 52}D"),
    ("v_softmax", "logits ARRAY<DOUBLE>, t DOUBLE", "ARRAY<DOUBLE>", _let("array_max(logits)", "m", _let("transform(logits, x -> exp((x - m) / t))", "e", _let("aggregate(e, 0D, (a, y) -> a + y)", "z", "transform(e, y -> y / z)")))),
    ("v_top", "probs ARRAY<DOUBLE>", "INT", "CAST(array_position(probs, array_max(probs)) - 1 AS INT)"),
    ("v_nll", "probs ARRAY<DOUBLE>, label INT", "DOUBLE", "-ln(greatest(element_at(probs, label + 1), 1e-12D))"),
    ("v_brier", "probs ARRAY<DOUBLE>, label INT", "DOUBLE", "aggregate(transform(probs, (p, i) -> pow(p - IF(i = label, 1D, 0D), 2)), 0D, (a, x) -> a + x)"),
    ("v_bin", "conf DOUBLE", "INT", f"CAST(least(floor(conf * {BINS}), {BINS - 1}) AS INT)"),
    ("v_confidence", "probs ARRAY<DOUBLE>", "DOUBLE", "greatest(0D, least(1D, (size(probs) * array_max(probs) - 1) / (size(probs) - 1)))"),
]


@udtf(returnType="grp string, id bigint, length bigint, batch int")
class Pack:
    """Batches of a group whose rows come longest first: rows times the longest stays within the budget."""

    def __init__(self):
        self.batch, self.n, self.width = 0, 0, 0

    def eval(self, row, budget: int):
        grp, key, length = row[0], row[1], row[2]
        width = max(self.width, length)
        if self.n and (self.n + 1) * width > budget:
            self.batch, self.n, width = self.batch + 1, 0, length
        self.n, self.width = self.n + 1, width
        yield grp, key, length, self.batch


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session; again is harmless."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("v_pack", Pack)


def with_tables(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of a folder's Parquet tables."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, text: str, folder: str | None = None, tables: tuple[str, ...] = ()) -> DataFrame:
    """A query's text with the functions, and the tables of a folder, at hand."""
    register(spark)
    if folder is not None:
        with_tables(spark, folder, *tables)
    return spark.sql(text)


GUARD = f"""
WITH held AS (SELECT DISTINCT explode(g) AS g FROM (SELECT v_grams(coalesce(text, ''), {NGRAM}) AS g FROM benchmark)),
own AS (SELECT doc_id, explode(g) AS g FROM (SELECT doc_id, v_grams(coalesce(text, ''), {NGRAM}) AS g FROM documents))
SELECT DISTINCT doc_id FROM own LEFT SEMI JOIN held ON own.g = held.g
"""
