"""Quality rules: a threshold table compiled into one projection of JVM expressions.

Defined results: a null text counts as an empty one (no words, ``base_failed``); blank lines never count as
repeated; texts of any length are taken whole; repeated rows are judged one by one; an empty table gives an empty result; extra input columns pass
through ``apply_rules`` unless they bear the name of a result column, which replaces them, or of a working column
(_words, _lines, _hashes); ``kept_documents`` keeps all columns as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, NOT_BLANK, let, native_words

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were which with you "
    "als auf aus das dem den der des die ein eine er es für im ist mit nicht sich sie und von wie zu "
    "au aux avec ce dans de du elle en est et il la le les ne pas pour qui que se sur un une "
    "como con del el ella las los más no para por su sus una y "
    "che di e gli i per non sono um uma os do da em het een van te dat"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails the rule when ``measure`` lies outside [low, high] and it has ``min_words`` words or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The production threshold table.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.10),
    Rule("exclamations_per_word", "exclamation_ratio", None, 0.30),
    Rule("repeated_lines", "dup_line_ratio", None, 0.50),
    Rule("stop_words", "stop_ratio", 0.02, None, 50),
)


def n_removed(text: Column, pattern: str) -> Column:
    """Code points of a text that match a pattern of single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered_by_repeats(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, first occurrences included.

    Sorting (hash, place) pairs puts equal windows side by side; the places of such windows, sorted, cover the
    sum of min(window, distance to the next place). n log n, whatever is repeated.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
        places = F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
        return let(
            F.sort_array(places),
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    distinct = F.size(F.array_distinct(hashes))
    return F.when(distinct == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of a text; three projections, no exchange."""
    stop = "(?iu)(?:^|" + BLANK + ")(?:" + "|".join(sorted(STOP_WORDS)) + ")(?=[.,;:!?]*(?:" + BLANK + "|$))"
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_BLANK))
    base = df.withColumns({"_words": native_words(F.col(text)), "_lines": lines})
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return (
        base.withColumns({"n_words": n.cast("long"), "_hashes": F.transform(windows, lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))})
        .withColumns(
            {
                "word_chars": (F.length(t) - n_removed(t, BLANK)).cast("long"),
                "n_symbols": n_removed(t, "[#*$%&|<>]").cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _covered_by_repeats(F.col("_hashes")).cast("long"),
                "n_stop_words": F.regexp_count(t, F.lit(stop)).cast("long"),
                "n_exclamations": n_removed(t, "!").cast("long"),
            }
        )
        .drop("_words", "_lines", "_hashes")
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> tuple[dict[str, Column], Column]:
    """The threshold table as expressions: the measures, and the array of names of failed rules."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    measures = {
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "exclamation_ratio": per("n_exclamations", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }
    failed = []
    for r in rules:
        m = F.col(r.measure)
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (m < r.low)
        if r.high is not None:
            outside = outside | (m > r.high)
        failed.append(F.when(outside & (F.col("n_words") >= r.min_words), F.lit(r.name)))
    return measures, F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Input columns, the counts and measures, ``failed_rules``, ``base_failed`` and ``kept``."""
    measures, failed = compiled(rules)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        measured(df, text)
        .withColumns(measures)
        .withColumns({"failed_rules": failed, "base_failed": base_failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns only. Counts live beside the row in a struct, so no name clashes."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    # A filter moves below projections and would pull their expressions into lambdas, to be computed for each word;
    # it stays above a generator.
    return apply_rules(row, "_text").select("_row", F.explode(F.array("kept")).alias("_kept")).where("_kept").select("_row.*")
