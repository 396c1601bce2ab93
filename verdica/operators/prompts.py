"""Prompt text: header lines, lettered options, answer cue, solved examples. All column expressions.

Question rows have type, instructions, state, options (array of name and descr), true_text, false_text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, named, strip

# The layout of prompts and hypotheses that scores depend on.
QUESTION, STATEMENT, PROPOSED = "Question: ", "Statement: ", "Proposed answer: "
IS_TRUE, IS_CORRECT = "Question: Is the statement true?", "Question: Is the proposed answer correct?"
YES_TO, YES_END = 'The answer to the question "', '" is yes.'
REGARDING, ANSWER_IS, LEVEL_IS = 'Regarding "', '", the correct answer is "', '", the best description is: '
CUE = "\nAnswer:"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPLY_RULE = "\nGive only the letter of your answer."


def letter(i: Column) -> Column:
    return F.char(i + F.lit(65))


def question_lines(kind: Column, instructions: Column, options: Column, true_text: Column, false_text: Column) -> tuple[Column, Column]:
    """(header lines joined, option texts)."""
    ins = strip(F.coalesce(instructions, F.lit("")))
    plain = F.concat(F.lit(QUESTION), ins)
    header = F.when((kind == "noul") & ~ins.endswith("?"), F.concat(F.lit(STATEMENT), ins, F.lit(f"\n{IS_TRUE}"))).otherwise(plain)
    yes_no = F.array(named(F.lit("Yes"), true_text), named(F.lit("No"), false_text))
    texts = F.when(kind == "noul", yes_no).when(kind == "score", F.transform(options, lambda o: collapse(o["name"]))).otherwise(F.transform(options, lambda o: named(o["name"], o["descr"])))
    return header, texts


def candidate_lines(instructions: Column, name: Column, descr: Column) -> tuple[Column, Column]:
    header = F.concat(F.lit(QUESTION), strip(F.coalesce(instructions, F.lit(""))), F.lit(f"\n{PROPOSED}"), named(name, descr), F.lit(f"\n{IS_CORRECT}"))
    return header, F.array(F.lit("Yes"), F.lit("No"))


def tail(header: Column, options: Column) -> Column:
    """Everything after the state: two to 26 lettered options, then the cue."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o)), "\n")
    text = F.concat(F.lit("\n\n"), header, F.lit("\n"), lines, F.lit(CUE))
    return F.when(F.size(options).between(2, 26), text).otherwise(F.raise_error(F.lit("2 to 26 options are needed")).cast("string"))


def _question(df: DataFrame) -> tuple[Column, Column]:
    return question_lines(F.col("type"), F.col("instructions"), F.col("options"), F.col("true_text"), F.col("false_text"))


def with_prompt(questions: DataFrame) -> DataFrame:
    """Adds suffix and n_labels; ``prefix`` (solved examples) stays, or is empty."""
    header, options = _question(questions)
    prefix = F.coalesce("prefix", F.lit("")) if "prefix" in questions.columns else F.lit("")
    return questions.withColumns({"prefix": prefix, "state": strip(F.coalesce("state", F.lit(""))), "suffix": tail(header, options), "n_labels": F.size(options)})


def with_candidate_prompt(options: DataFrame, stripped: bool = False) -> DataFrame:
    """For rows with ``option``: a yes/no prompt about it. Where ``stripped``, states already are and aren't searched again for each option."""
    header, yes_no = candidate_lines(F.col("instructions"), F.col("option")["name"], F.col("option")["descr"])
    prefix = F.coalesce("prefix", F.lit("")) if "prefix" in options.columns else F.lit("")
    state = F.col("state") if stripped else strip(F.coalesce("state", F.lit("")))
    return options.withColumns({"prefix": prefix, "state": state, "suffix": tail(header, yes_no), "n_labels": F.lit(2)})


def demo_text(state: Column, header: Column, options: Column, answer: Column) -> Column:
    """A solved example: the block, the gold letter and an empty line."""
    return F.concat(strip(state), tail(header, options), F.lit(" "), letter(answer), F.lit("\n\n"))


def demo_prefix(demos: DataFrame, by: list[str], k: int) -> DataFrame:
    """First k examples (by ``ord``) of each group, joined in order: by, prefix. demos has ord and text."""
    picked = demos.where(F.col("ord") < k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("d"))
    return picked.select(*by, F.array_join(F.transform("d", lambda s: s["text"]), "").alias("prefix"))


def fit_window(options: Column, answer: Column, j: Column | int, n: int) -> tuple[Column, Column]:
    """At most n options in a row around the gold one, whose place there varies with j: (options, answer)."""
    j = F.lit(j) if isinstance(j, int) else j
    start = F.least(F.greatest(answer - j % n, F.lit(0)), F.greatest(F.size(options) - n, F.lit(0)))
    return F.slice(options, start + 1, F.lit(n)), answer - start


def as_candidate(options: Column, answer: Column, j: Column | int) -> tuple[Column, Column]:
    """A choice example as a yes/no one: the gold option for even j, the next one for odd: (option, answer)."""
    j = F.lit(j) if isinstance(j, int) else j
    return F.get(options, (answer + j % 2) % F.size(options)), (j % 2).cast("int")


DEMO = "demo_set string, ord int, state string, type string, instructions string, options array<struct<name:string,descr:string>>, true_text string, false_text string, answer int"

#: Solved examples for questions that bring none, by type; the set's name is the type.
BUILT_IN = [
    ("choice", 0, "The lift stands still between two floors, and its light flickers.", "choice", "Which team should look at this?", [("gardeners", "plants and paths"), ("electricians", "lifts, lights and wiring"), ("cooks", None)], None, None, 1),
    ("choice", 1, "Two seats in the third row, please, for the late show on Friday.", "choice", "What does the guest want?", [("buy tickets", None), ("leave a complaint", None)], None, None, 0),
    ("score", 0, "It does what it should, though the case scratches easily.", "score", "How content is the writer?", [("not at all", None), ("somewhat", None), ("fully", None)], None, None, 1),
    ("score", 1, "Best soup in town. We come every week!", "score", "How content is the writer?", [("not at all", None), ("somewhat", None), ("fully", None)], None, None, 2),
    ("noul", 0, "The museum opens at ten and closes at six, except on Mondays.", "noul", "The museum is open at noon on Mondays.", None, "the text says so", "the text says otherwise", 1),
    ("noul", 1, "Her train left Graz an hour before his.", "noul", "Did she leave before him?", None, None, None, 0),
]


def built_in_demos(spark: SparkSession, shots: int) -> DataFrame:
    """The first ``shots`` built-in examples of each type."""
    return spark.createDataFrame([d for d in BUILT_IN if d[1] < shots], DEMO)


def prefixes(demos: DataFrame, wanted: DataFrame, shots: int) -> DataFrame:
    """demo_set, form, n and the prefix of the first ``shots`` examples of a set, in a form.

    ``wanted`` has demo_set, form and n, in any number of rows: a prefix is made once for each of them that differs. Form "letter" shows
    a choice's options in a window of ``n`` around the gold one; form "candidate" asks yes or no about one option. Other types stay as they are.
    """
    each = wanted.select("demo_set", "form", "n").distinct().join(demos.where(F.col("ord") < shots), "demo_set")
    choice = F.col("type") == "choice"
    n = F.when(choice, F.least("n", F.size("options"))).otherwise(F.size("options"))
    start = F.when(choice, F.least(F.greatest(F.col("answer") - F.col("ord") % n, F.lit(0)), F.size("options") - n)).otherwise(0)
    window = F.when(F.col("options").isNotNull(), F.slice("options", start + 1, n))
    header, lines = question_lines(F.col("type"), F.col("instructions"), window, F.col("true_text"), F.col("false_text"))
    letters_text = demo_text(F.col("state"), header, lines, F.col("answer") - F.when(choice, start).otherwise(0))
    option, answer = as_candidate(F.col("options"), F.col("answer"), F.col("ord"))
    asked, yes_no = candidate_lines(F.col("instructions"), option["name"], option["descr"])
    text = F.when((F.col("form") == "candidate") & choice, demo_text(F.col("state"), asked, yes_no, answer)).otherwise(letters_text)
    found = each.groupBy("demo_set", "form", "n").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))).alias("d"))
    return found.select("demo_set", "form", "n", F.array_join(F.transform("d", lambda s: s["text"]), "").alias("prefix"))


def hypotheses(kind: Column, instructions: Column, options: Column, true_text: Column) -> Column:
    """Statements for an entailment model: one for yes/no, else one an option."""
    ins = collapse(instructions)
    yes = F.when(ins.endswith("?"), F.concat(F.lit(YES_TO), ins, F.lit(YES_END))).when(ins.rlike("[.!]$"), ins).otherwise(F.concat(ins, F.lit(".")))
    extra = F.when(F.coalesce(collapse(true_text), F.lit("")) != "", F.concat(F.lit(" ("), collapse(true_text), F.lit(")"))).otherwise(F.lit(""))
    choice = F.transform(options, lambda o: F.concat(F.lit(REGARDING), ins, F.lit(ANSWER_IS), collapse(o["name"]), F.lit('"'), F.coalesce(F.concat(F.lit(": "), collapse(o["descr"])), F.lit("")), F.lit(".")))
    score = F.transform(options, lambda o: F.concat(F.lit(REGARDING), ins, F.lit(LEVEL_IS), collapse(o["name"])))
    return F.when(kind == "noul", F.array(F.concat(yes, extra))).when(kind == "choice", choice).otherwise(score)


def rendered_pair(premise: Column, hypothesis: Column, marker: str = "\nHypothesis: ", safe: str = "\nHypothesis - ", limit: int = 32_000) -> Column:
    """One text of premise and hypothesis: marks in the premise broken, its start cut where it is too long: (text, cut)."""
    safe_premise = F.replace(premise, F.lit(marker), F.lit(safe))
    room = F.lit(limit - len("Premise: ") - len(marker)) - F.length(hypothesis)
    cut = F.length(safe_premise) > room
    kept = F.when(cut, F.concat(F.lit("…"), F.right(safe_premise, room - 1))).otherwise(safe_premise)
    return F.struct(F.concat(F.lit("Premise: "), kept, F.lit(marker), hypothesis).alias("text"), cut.alias("cut"))


def messages(state: Column, suffix: Column) -> Column:
    """Chat form: the prompt without its cue and a reply rule."""
    return F.concat(state, F.regexp_replace(suffix, "\\nAnswer:$", ""), F.lit(REPLY_RULE))


def fitted(rows: DataFrame, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], most: int, key: str = "request_id", mark: str = "… ") -> DataFrame:
    """key, prompt, n_tokens, truncated: the state (between prefix and suffix) loses its start, token by token, until all fits.

    Joined texts may take more tokens than their parts, so what is kept shrinks by as many as a try is over. A character cut
    in two goes. A prompt that leaves its state no room is null.
    """

    def one(prefix: str, state: str, suffix: str) -> tuple[str | None, int | None, bool]:
        whole = prefix + state + suffix
        if (n := len(encode(whole))) <= most:
            return whole, n, False
        ids = encode(state)
        keep = min(len(ids), most)
        while keep > 0:
            tail = decode(ids[-keep:]).lstrip("\ufffd").lstrip()
            prompt = prefix + mark + tail + suffix
            if (n := len(encode(prompt))) <= most:
                return prompt, n, True
            keep -= n - most
        return None, None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[x or "" for x in batch.column(k).to_pylist()] for k in (1, 2, 3)]
            done = [one(*p) for p in zip(*parts, strict=True)]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "prompt", "n_tokens", "truncated"])

    return rows.select(key, "prefix", "state", "suffix").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, prompt string, n_tokens int, truncated boolean")
