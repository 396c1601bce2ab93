"""Checks of sources, rows and runs: aggregates and anti-joins that must come out empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.probs import EPS, sigmoid
from ..operators.analysis import bootstrap_auroc
from ..operators.calibrate import fit_platt
from ..operators.metrics import auroc

MAX_OPTIONS = 26


def pair_violations(intents: DataFrame, scenarios: DataFrame, key: str = "id") -> DataFrame:
    """Two views of the same utterances: rows whose texts differ, or whose scenario isn't the intent's first part."""
    a = intents.select(key, F.col("text").alias("text_a"), F.col("label_text").alias("intent"))
    b = scenarios.select(key, F.col("text").alias("text_b"), F.col("label_text").alias("scenario"))
    return a.join(b, key).where((F.col("text_a") != F.col("text_b")) | (F.split_part("intent", F.lit("_"), F.lit(1)) != F.col("scenario"))).select(key)


def label_report(mapped: DataFrame) -> DataFrame:
    """From mapped rows: rows, skipped ones, and classes with their counts."""
    return mapped.groupBy("source", "cls").agg(F.count(F.lit(1)).alias("n"), F.count("skip_reason").alias("skipped"))


def check_source(mapped: DataFrame, classes: list[str] | None = None, most_skipped: float = 0.02) -> None:
    """Raises where a source has unknown or empty classes, or more rows without a class than may be."""
    rows = label_report(mapped).collect()
    total = sum(r["n"] for r in rows)
    if not total:
        raise ValueError("no rows")
    found = {r["cls"] for r in rows if r["cls"] is not None}
    if classes is not None and (strange := found - set(classes)):
        raise ValueError(f"unknown classes {sorted(strange)}")
    if classes is not None and (empty := set(classes) - found):
        raise ValueError(f"classes without rows {sorted(empty)}")
    if sum(r["skipped"] for r in rows) > most_skipped * total:
        raise ValueError("too many rows without a class")


def example_errors(instructions: Column, options: Column, kind: Column, family: Column, label: Column, candidate: Column, benchmark: list[str], forbidden: str, state: Column) -> Column:
    """Names of the guards that a finished row breaks."""
    n = F.size(options)
    want = F.when(family.isin("choice", "candidate"), "choice").when(family == "score", "score").otherwise("noul")
    checks = {
        "benchmark_instruction": T.norm_text(instructions).isin([x.lower() for x in benchmark]),
        "forbidden_wrapper": F.contains(state, F.lit(forbidden)),
        "options": (kind != "noul") & ~n.between(2, MAX_OPTIONS),
        "label": ~F.when(kind.isin("choice", "score") & (family != "candidate"), label.between(0, n - 1)).otherwise(label.isin(0, 1)),
        "candidate": (family == "candidate") & ~F.coalesce(F.array_contains(options, candidate), F.lit(False)),
        "type": kind != want,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()]))


def registry_faults(sources: DataFrame, labels: DataFrame, templates: DataFrame, benchmark: DataFrame, excluded: DataFrame, others: list[str], styles: list[str], least_hard: int = 16) -> DataFrame:
    """source, fault and what of a registry before any row is made; empty if all is well.

    sources: source, dataset. labels: source, label_set, raw, name, phrase, hard. templates: source, label_set, kind (choice, statement, question or
    negation), text with {p} for a label's phrase. benchmark: text of wordings that training must not repeat. excluded: dataset.

    Names collide within a style; wordings are compared after all labels stand in all templates. Both by normalised keys, in joins and
    counts over the expansion, which is never gathered.
    """
    fault = lambda rows, name, what: rows.select("source", F.lit(name).alias("fault"), what.alias("what"))
    styled = labels.select("source", "label_set", "raw", "name", F.explode(F.array(*[F.lit(s) for s in styles])).alias("style"))
    styled = styled.withColumn("shown", T.styled(F.col("raw"), F.col("name"), F.col("style")))
    twice = styled.groupBy("source", "label_set", "style", "shown").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named_other = styled.where(T.norm_text(F.col("shown")).isin([o.lower() for o in others])).select("source", "shown").distinct()
    asks = F.trim("text").endswith("?")
    marks = templates.where(F.when(F.col("kind") == "question", ~asks).when(F.col("kind").isin("statement", "negation"), asks).otherwise(False))
    with_labels = templates.where(F.contains("text", F.lit("{p}"))).join(labels.select("source", "label_set", F.coalesce("phrase", "name").alias("p")), ["source", "label_set"])
    wording = with_labels.select("source", F.replace("text", F.lit("{p}"), F.col("p")).alias("w")).unionByName(templates.where(~F.contains("text", F.lit("{p}"))).select("source", F.col("text").alias("w")))
    theirs = benchmark.select(F.sha2(T.norm_text(F.col("text")), 256).alias("k")).distinct()
    repeats = wording.withColumn("k", F.sha2(T.norm_text(F.col("w")), 256)).join(theirs, "k", "left_semi").select("source", "w").distinct()
    few = labels.where("hard").groupBy("source", "label_set").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least_hard)
    found = [
        fault(sources.join(excluded, "dataset", "left_semi"), "excluded_dataset", F.col("dataset")),
        fault(twice, "names_collide", F.concat_ws(": ", "style", "shown")),
        fault(named_other, "named_like_other", F.col("shown")),
        fault(marks, "question_mark", F.col("text")),
        fault(repeats, "benchmark_wording", F.col("w")),
        fault(few, "too_few_labels", F.col("label_set")),
    ]
    return reduce(DataFrame.unionByName, found)


def same_as_bench(rows: DataFrame, bench: DataFrame, key: str = "id") -> DataFrame:
    """Ad-hoc rows beside benchmark rows of the same id: pairs, differing labels, largest logit difference."""
    both = rows.select(key, F.col("label").alias("la"), F.col("logits").alias("za")).join(bench.select(key, F.col("label").alias("lb"), F.col("logits").alias("zb")), key)
    gap = F.array_max(F.zip_with("za", "zb", lambda a, b: F.abs(a - b)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("la") != F.col("lb")).alias("labels_differ"), F.max(gap).alias("max_logit_diff"))


def row_mismatches(a: DataFrame, b: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """How many ids only one model has, or both with different labels; zero for comparable runs."""
    x, y = a.select(F.col(key).alias("ka"), F.col(label).alias("la")), b.select(F.col(key).alias("kb"), F.col(label).alias("lb"))
    return x.join(y, F.col("ka") == F.col("kb"), "full").agg(F.count_if(~F.col("la").eqNullSafe(F.col("lb"))).alias("mismatches"))


def improvement_rules(tasks: DataFrame, least: int = 4) -> DataFrame:
    """From one row a task (base_nll, arm_nll, nll_high, acc_diff, ece_diff): which adoption rules an arm passes."""
    better = (F.col("nll_high") < 0) | (F.col("acc_diff") >= 0.05 - 1e-9)
    return tasks.agg(
        (F.avg("arm_nll") < F.avg("base_nll")).alias("mean_nll_lower"),
        F.count_if(better).alias("improved"),
        (F.count_if(better) >= least).alias("enough_improved"),
        F.count_if(F.col("arm_nll") - F.col("base_nll") > 0.05).alias("worse_nll"),
        F.count_if(F.col("acc_diff") < -0.05).alias("worse_accuracy"),
        (F.count_if(F.col("ece_diff") > 0.05) >= 3).alias("overfit"),
    )


def wording_table(rows: DataFrame, by: str = "wording", key: str = "id", reps: int = 2000) -> DataFrame:
    """Each wording of a yes/no question, from raw rows (split, logits, label): AUROC of the margin with its resampled
    interval on the test split, and accuracy at the plain threshold and at the one that Platt scaling finds on the calib split.

    A loop over wordings, which are a handful.
    """
    rows = rows.withColumn("margin", F.get("logits", F.lit(0)) - F.get("logits", F.lit(1)))
    out = None
    for wording in sorted(r[by] for r in rows.select(by).distinct().collect()):
        one = rows.where(F.col(by) == wording)
        a, b = fit_platt(one.where("split = 'calib'").select("margin", "label"))
        test = one.where("split = 'test'")
        hit = lambda yes: F.avg((yes == (F.col("label") == 1)).cast("int"))
        plain = F.col("margin") >= 0
        lost = F.greatest(F.when(F.col("label") == 1, sigmoid(F.col("margin"))).otherwise(sigmoid(-F.col("margin"))), F.lit(EPS))
        found = test.agg(F.count(F.lit(1)).alias("n"), hit(plain).alias("accuracy"), hit(a * F.col("margin") + b >= 0).alias("accuracy_platt"), F.avg(-F.log(lost)).alias("nll"), F.avg(plain.cast("int")).alias("yes_rate"), F.avg("label").alias("true_rate"))
        ranked = test.select(key, "label", F.col("margin").alias("score"))
        line = found.crossJoin(auroc(ranked, "score", "label")).crossJoin(bootstrap_auroc(ranked, "score", "label", key, reps)).withColumn(by, F.lit(wording))
        out = line if out is None else out.unionByName(line)
    if out is None:
        raise ValueError("no rows")
    return out


def content_faults(source: str, rows: DataFrame) -> DataFrame:
    """(check, n, bad, allowed) of a source's raw rows, beyond classes: what the mapping takes for granted about their content.

    allowed: the share of n that may be bad.
    """
    def counted(check: str, n: Column, bad: Column, allowed: float = 0.0) -> DataFrame:
        return rows.agg(F.count_if(n).alias("n"), F.count_if(n & bad).alias("bad")).select(F.lit(check).alias("check"), "n", "bad", F.lit(allowed).alias("allowed"))

    def one_to_one(check: str, a: Column, b: Column) -> DataFrame:
        pairs = rows.select(a.alias("a"), b.alias("b")).distinct().groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("bad")).select(F.lit(check).alias("check"), "n", "bad", F.lit(0.0).alias("allowed"))

    if source == "squad_v2":
        answered = F.size("answers.text") > 0
        spans = counted("answers are spans of the context", answered, ~F.contains(F.col("context"), F.get("answers.text", F.lit(0))), 0.02)
        none = rows.agg(F.lit(1).cast("long").alias("n"), (F.count_if(answered) * F.count_if(~answered) == 0).cast("long").alias("bad"))
        return spans.unionByName(none.select(F.lit("both answerable and unanswerable").alias("check"), "n", "bad", F.lit(0.0).alias("allowed")))
    if source in ("stsb", "civil_comments"):
        value = F.col("score" if source == "stsb" else "toxicity")
        return counted("values within [0, 1]", value.isNotNull(), ~value.between(0, 1))
    if source == "trec":
        return one_to_one("a fine label has one coarse label", F.col("label_text"), F.col("label_coarse_text"))
    if source == "fewrel":
        return one_to_one("a relation has one name", F.col("relation"), F.get("names", F.lit(0)))
    return counted("rows", F.lit(True), F.lit(False))


def check_content(source: str, rows: DataFrame) -> None:
    """Raises where a check of the content fails."""
    for r in content_faults(source, rows).collect():
        if not r["n"] or r["bad"] > r["allowed"] * r["n"]:
            raise ValueError(f"{source}: {r['check']}: {r['bad']} of {r['n']} fail")
