"""Scoring dataflow: prompts by question and option, a pluggable backend stage, two-stage choices over wide option sets.

A backend is a function from a table of prompts (key columns, prefix, state, suffix, n_labels) to the same keys with
``logits`` (array of doubles, one a letter), ``prompt_tokens`` and ``truncated``. Python stages see through neither
filters nor column pruning, so ``run_backend`` hands a backend only what it reads. A backend that is a column expression may have a
``reading`` too: of prefix, state and an array of suffixes it gives an array of (logits, prompt_tokens, truncated). Wide choices
then stay one row a question through both passes, and no state is copied for each option or exchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import item, let
from ..functions.text import strip_long, tokens_of
from . import prompts

Backend = Callable[[DataFrame], DataFrame]
LETTERS = 26
SHORTLIST = 10
#: Demo sets whose prefixes are sent to every task, at most.
SETS = 200


def run_backend(table: DataFrame, backend: Backend, keys: list[str]) -> DataFrame:
    """The keys with the backend's columns; raises where a row has not as many finite logits as labels."""
    needed = table.select(*keys, "prefix", "state", "suffix", "n_labels")
    out = backend(needed)
    return out.select(*keys, _fitting(F.col("logits"), F.col("n_labels")).alias("logits"), "prompt_tokens", "truncated")


def _fitting(logits: Column, n: Column) -> Column:
    """The logits, if they are finite and as many as the labels."""
    ok = (F.size(logits) == n) & F.forall(logits, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(ok, F.lit(False)), logits).otherwise(F.raise_error(F.lit("backend logits don't fit the labels")).cast("array<double>"))


def _lexical_logits(lower: Column, suffix: Column) -> Column:
    """Logits of a prompt from its lowered state. Words are cut out and the bytes that go are counted, so no pieces of the state are made."""

    def count(x: Column) -> Column:
        word = F.lower(F.regexp_extract(x, r"[\w]+", 0))
        bare = F.size(F.split(lower, "\\Q\\E")) - 1  # an option without a word
        cut = lambda w: (F.octet_length(lower) - F.octet_length(F.replace(lower, w, F.lit("")))) / F.octet_length(w)
        return F.coalesce(let(word, lambda w: F.when(w == "", bare).otherwise(cut(w))), F.lit(0)).cast("double")

    def answer(lines: Column) -> Column:
        options = F.transform(F.filter(lines, lambda x: x.rlike("^[A-Z]\\. ")), lambda x: F.substr(x, F.lit(4)))
        proposal = F.get(F.filter(lines, lambda x: x.startswith("Proposed answer: ")), F.lit(0))
        return let(proposal, lambda p: F.when(p.isNotNull(), F.array(count(F.substr(p, F.lit(18))), F.lit(0.0))).otherwise(F.transform(options, count)))

    return let(F.split(suffix, "\n"), answer)


def lexical_reading(prefix: Column, state: Column, suffixes: Column) -> Column:
    """What ``lexical_backend`` reads of one state under many suffixes: array of (logits, prompt_tokens, truncated). The state is lowered once."""

    def one(s: Column, suffix: Column) -> Column:
        return F.struct(_lexical_logits(s["lower"], suffix).alias("logits"), tokens_of(s["n"] + F.length(suffix)).cast("int").alias("prompt_tokens"), F.lit(False).alias("truncated"))

    known = F.struct(F.lower(state).alias("lower"), (F.length(prefix) + F.length(state)).alias("n"), suffixes.alias("suffixes"))
    return let(known, lambda s: F.transform(s["suffixes"], lambda x: one(s, x)))


def lexical_backend(table: DataFrame) -> DataFrame:
    """Deterministic stand-in for a model: a letter's logit counts its option's first word in the state.

    Yes/no prompts about a proposed answer count the proposal's first word for yes.
    """
    rows = table.withColumn("_read", F.get(lexical_reading(F.col("prefix"), F.col("state"), F.array("suffix")), F.lit(0)))
    return rows.select("*", "_read.*").drop("_read")


lexical_backend.reading = lexical_reading


def precomputed_backend(logits: DataFrame, keys: list[str]) -> Backend:
    """Logits looked up by key columns from a table (keys, logits)."""

    def read(table: DataFrame) -> DataFrame:
        found = table.join(logits.select(*keys, "logits"), keys)
        return found.withColumns({"prompt_tokens": F.lit(0), "truncated": F.lit(False)})

    return read


def stage1(pairs: DataFrame, keys: list[str], margin: str = "margin", place: str = "place") -> DataFrame:
    """Log softmax of yes-over-no margins over the options of a question, one row an option: adds ``lp`` and ``rank``."""
    w = Window.partitionBy(*keys)
    top = F.max(margin).over(w)
    shifted = pairs.withColumn("_m", F.col(margin) - top)
    lp = shifted.withColumn("lp", F.col("_m") - F.log(F.sum(F.exp("_m")).over(w))).drop("_m")
    return lp.withColumn("rank", F.row_number().over(w.orderBy(F.desc("lp"), place)))


def _prefixed(rows: DataFrame, form: Column, n: Column, demos: DataFrame | None, shots: int) -> DataFrame:
    """Rows with the ``prefix`` of their demo set in a form, made once a set; without demos as they are."""
    if demos is None:
        return rows
    asked = rows.drop("prefix").withColumns({"_form": form, "_n": n})
    made = prompts.prefixes(demos, asked.select("demo_set", F.col("_form").alias("form"), F.col("_n").alias("n")), shots)
    made = made.select("demo_set", F.col("form").alias("_form"), F.col("n").alias("_n"), "prefix")
    # by few sets rows would meet in as few tasks: prefixes of up to SETS sets go to every task instead
    if demos.select("demo_set").distinct().limit(SETS + 1).count() <= SETS:
        made = F.broadcast(made)
    return asked.join(made, ["demo_set", "_form", "_n"], "left").drop("_form", "_n")


def score(questions: DataFrame, backend: Backend, shortlist: int = SHORTLIST, letters: int = LETTERS, demos: DataFrame | None = None, shots: int = 0) -> DataFrame:
    """Raw scores of question rows (request_id, ord, qid, type, instructions, state, options, true_text, false_text, prefix).

    Narrow questions are one prompt; wide choices one yes/no prompt an option, then one prompt over the best. Both
    passes read all their prompts at once. Prompts carry ``place``: an option's place, -1 for a whole question, -2 for a
    shortlist.

    Solved examples stand before each prompt if ``shots`` are asked for: those of the question's ``demo_set`` in ``demos``, without one the
    built-in ones of its type. They take the form of the prompt: lettered with as many options as it may have, or yes and no.
    """
    if shortlist < 2:
        raise ValueError("shortlist must be 2 or more")
    keys = ["request_id", "ord"]
    if shots > 0:
        own = questions if "demo_set" in questions.columns else questions.withColumn("demo_set", F.lit(None).cast("string"))
        questions = own.withColumn("demo_set", F.coalesce("demo_set", "type"))
        built_in = prompts.built_in_demos(questions.sparkSession, shots)
        demos = built_in if demos is None else demos.unionByName(built_in.join(F.broadcast(demos.select("demo_set").where(F.col("demo_set").isin("choice", "score", "noul")).distinct()), "demo_set", "left_anti"))
    else:
        demos = None
    wide = (F.col("type") == "choice") & (F.size("options") > letters)
    narrow = prompts.with_prompt(_prefixed(questions.where(~wide), F.lit("letter"), F.lit(letters), demos, shots)).withColumn("place", F.lit(-1))
    columns = ["request_id", "ord", "place", "prefix", "state", "suffix", "n_labels"]
    one_pass = lambda read: read.where("place = -1").select(*keys, "logits", "prompt_tokens", "truncated", F.lit("letter").alias("stage"), F.lit(None).cast("array<double>").alias("stage1_logits"))
    # stripped before it stands beside each option
    asked = _prefixed(questions.where(wide), F.lit("candidate"), F.lit(2), demos, shots).withColumn("state", strip_long(F.coalesce("state", F.lit(""))))
    if reading := getattr(backend, "reading", None):
        single = one_pass(run_backend(narrow.select(*columns), backend, [*keys, "place"]))
        first_prefix = F.coalesce("prefix", F.lit("")) if "prefix" in asked.columns else F.lit("")
        both = _prefixed(asked.withColumn("_prefix1", first_prefix), F.lit("letter"), F.lit(min(shortlist, letters)), demos, shots)
        return single.unionByName(_wide_at_once(both, reading, keys, min(shortlist, letters)))
    first = prompts.with_candidate_prompt(asked.select("*", F.posexplode("options").alias("place", "option")), stripped=True)
    read = run_backend(narrow.select(*columns).unionByName(first.select(*columns)), backend, [*keys, "place"])
    single = one_pass(read)
    margins = read.where("place >= 0").withColumn("margin", item(F.col("logits"), 0) - item(F.col("logits"), 1))
    # one list, which both readers below need whole, so they share its exchange and the first pass runs once
    each = margins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "margin", "prompt_tokens", "truncated"))).alias("each"))
    ranked = each.select(
        *keys,
        F.transform("each", lambda s: s["margin"]).alias("margins"),
        F.aggregate("each", F.lit(0).cast("long"), lambda n, s: n + s["prompt_tokens"]).alias("tokens1"),
        F.exists("each", lambda s: s["truncated"]).alias("cut1"),
    )
    lp = ranked.withColumn("lp1", P.log_softmax(F.col("margins"))).withColumn("kept", P.shortlist(F.col("lp1"), min(shortlist, letters)))
    short = questions.where(wide).join(lp, keys).withColumn("options", F.transform("kept", lambda j: F.get(F.col("options"), j)))
    short = _prefixed(short, F.lit("letter"), F.size("kept"), demos, shots)
    second = run_backend(prompts.with_prompt(short.withColumn("place", F.lit(-2))), backend, [*keys, "place"]).select(*keys, F.col("logits").alias("l2"), F.col("prompt_tokens").alias("tokens2"), F.col("truncated").alias("cut2"))
    merged = lp.join(second, keys).select(
        *keys,
        P.merge_shortlist(F.col("lp1"), F.col("kept"), P.log_softmax(F.col("l2"))).alias("logits"),
        (F.col("tokens1") + F.col("tokens2")).cast("int").alias("prompt_tokens"),
        (F.col("cut1") | F.col("cut2")).alias("truncated"),
        F.lit("two_stage").alias("stage"),
        F.col("lp1").alias("stage1_logits"),
    )
    return single.unionByName(merged)


def _wide_at_once(asked: DataFrame, reading: Callable[[Column, Column, Column], Column], keys: list[str], shortlist: int) -> DataFrame:
    """Both passes of wide questions by a backend's ``reading``, in the question's own row; ``_prefix1`` stands before the first pass's prompts. States are stripped."""
    prefix = F.coalesce("prefix", F.lit("")) if "prefix" in asked.columns else F.lit("")
    known = F.struct("state", "options", F.col("instructions").alias("ins"), F.col("_prefix1").alias("prefix1"), prefix.alias("prefix2"), F.col("true_text").alias("true"), F.col("false_text").alias("false"))

    def first(q: Column) -> Column:
        suffixes = F.transform(q["options"], lambda o: prompts.tail(*prompts.candidate_lines(q["ins"], o["name"], o["descr"])))
        return let(F.struct(q.alias("q"), reading(q["prefix1"], q["state"], suffixes).alias("r")), ranked)

    def ranked(s: Column) -> Column:
        margins = F.transform(s["r"], lambda x: let(_fitting(x["logits"], F.lit(2)), lambda z: item(z, 0) - item(z, 1)))
        tokens = F.aggregate(s["r"], F.lit(0).cast("long"), lambda n, x: n + x["prompt_tokens"])
        found = F.struct(s["q"].alias("q"), P.log_softmax(margins).alias("lp"), tokens.alias("tokens"), F.exists(s["r"], lambda x: x["truncated"]).alias("cut"))
        return let(found, lambda f: let(F.struct(f.alias("f"), P.shortlist(f["lp"], shortlist).alias("kept")), second))

    def second(s: Column) -> Column:
        f, q = s["f"], s["f"]["q"]
        options = F.transform(s["kept"], lambda j: F.get(q["options"], j))
        header, texts = prompts.question_lines(F.lit("choice"), q["ins"], options, q["true"], q["false"])
        read = F.get(reading(q["prefix2"], q["state"], F.array(let(texts, lambda t: prompts.tail(header, t)))), F.lit(0))
        return let(F.struct(f["lp"].alias("lp"), f["tokens"].alias("tokens"), f["cut"].alias("cut"), s["kept"].alias("kept"), read.alias("r")), merged)

    def merged(s: Column) -> Column:
        logits = P.merge_shortlist(s["lp"], s["kept"], P.log_softmax(_fitting(s["r"]["logits"], F.size(s["kept"]))))
        return F.struct(logits.alias("logits"), (s["tokens"] + s["r"]["prompt_tokens"]).cast("int").alias("prompt_tokens"), (s["cut"] | s["r"]["truncated"]).alias("truncated"), s["lp"].alias("lp1"))

    told = asked.select(*keys, let(known, first).alias("_a"))
    return told.select(*keys, "_a.logits", "_a.prompt_tokens", "_a.truncated", F.lit("two_stage").alias("stage"), F.col("_a.lp1").alias("stage1_logits"))


def nli_logits(kind: Column, triples: Column) -> Column:
    """From (entail, neutral, contradict) logits of each hypothesis: yes against the rest, or entailment's log odds by option."""
    rest = P.logsumexp(F.array(item(item(triples, 0), 1), item(item(triples, 0), 2)))
    return F.when(kind == "noul", F.array(item(item(triples, 0), 0), rest)).otherwise(F.transform(triples, lambda t: item(t, 0) - P.logsumexp(t)))


def ranked_labels(scores: DataFrame, keys: list[str], margin: str = "margin", place: str = "place") -> DataFrame:
    """Adds the zero-based ``rank`` of each label by margin, then place."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(margin), place)) - 1)


def mined(scores: DataFrame, keys: list[str], gold: Column, label: str = "label_name", keep: int = 15) -> DataFrame:
    """Rank of the gold label and the best ``keep`` wrong ones of each row, in one aggregation over ranked labels."""
    ranked = ranked_labels(scores, keys)
    is_gold = gold
    wrong = F.transform(F.array_sort(F.collect_list(F.when(~is_gold & (F.col("rank") <= keep), F.struct("rank", label)))), lambda s: s[label])
    return ranked.groupBy(*keys).agg(F.min(F.when(is_gold, F.col("rank"))).alias("gold_rank"), F.slice(wrong, 1, keep).alias("wrong"))
