"""Synthetic decisions: parsers of generated lists, the filter ladder over utterances, flags, soft labels and gold mixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from . import guards

BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"
MIN_LABELS, FLAG_AT, KEEP = 20, 0.5, 15
#: Topics kept out of synthetic sets, since a benchmark is about them.
BANKING = r"(?i)\b(bank\w*|loan\w*|mortgage\w*|credit|debit|atm|iban|overdraft|interest rate\w*)\b"


def taxonomy_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, intent, description) of "name | description" lines: first of a name wins, malformed lines are skipped."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    bare = F.regexp_replace("line", BULLET, "")
    name = F.regexp_replace(F.regexp_replace(F.lower(T.strip(F.split_part(bare, F.lit("|"), F.lit(1)))), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    after = F.when(F.contains(bare, F.lit("|")), F.substr(bare, F.instr(bare, "|") + 1))
    desc = F.regexp_replace(T.collapse(after), r"\.+$", "")
    good = lines.select(key, "pos", name.alias("intent"), desc.alias("description")).where((F.col("intent") != "") & (F.coalesce("description", F.lit("")) != "") & (F.length("intent") <= 60) & ~F.col("intent").isin("other", "none_of_the_above"))
    return good.withColumn("_r", F.row_number().over(Window.partitionBy(key, "intent").orderBy("pos"))).where("_r = 1").drop("_r")


def utterance_lines(docs: DataFrame, keys: list[str], text: str = "text", most: int = 15, quotes: str = '"“”') -> DataFrame:
    """(keys, n, text): one message a line without bullets and without ``quotes`` at its ends, 2 to 80 words, the first ``most`` of each row. Lines are chosen in their row: no exchange."""
    unquoted = (lambda x: F.regexp_replace(x, f"^[{quotes}]+|[{quotes}]+$", "")) if quotes else (lambda x: x)
    bare = F.transform(F.split(text, r"\r?\n"), lambda x: T.collapse(unquoted(T.strip(F.regexp_replace(x, BULLET, "")))))
    good = F.filter(bare, lambda x: F.size(F.split(x, " ")).between(2, 80))
    return docs.select(*keys, F.posexplode(F.slice(good, 1, most)).alias("n", "text"))


def interleaved(intents: DataFrame, done: DataFrame, domain: str = "domain_ord", intent: str = "intent_ord") -> DataFrame:
    """Jobs not done, taking turns over domains."""
    return intents.join(done, ["domain", "intent"], "left_anti").orderBy(intent, domain)


def banking_like(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.replace(p, F.lit("_"), F.lit(" ")) for p in parts]).rlike(BANKING)


def usable_labels(intents: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Intents of taxonomies with enough labels left after the keyword filter and flags."""
    kept = intents.where(~banking_like(F.col("intent"), F.col("description")))
    if flags is not None:
        kept = kept.join(flags.where("flag").select("domain", "intent"), ["domain", "intent"], "left_anti")
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("domain"))).where(F.col("_n") >= MIN_LABELS).drop("_n")


def utterance_reasons(utterances: DataFrame, labels: DataFrame, held_out: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``drop_reason`` in order of precedence: dropped intent, repeated text, held-out overlap, banking-like.

    A repeat is judged over all domains among utterances whose intent stands and that no reason dropped, by ``order``.
    """
    rows = utterances.withColumn("key", T.key(F.col("text")))
    standing = labels.select("domain", "intent").distinct().withColumn("_ok", F.lit(True))
    rows = rows.join(standing, ["domain", "intent"], "left")
    hits = guards.guard_hits(rows.select("key", "text").distinct(), held_out, "key", "text").withColumn("_hit", F.lit(True))
    rows = rows.join(hits, "key", "left").withColumn("_bank", F.col("text").rlike(BANKING))
    fit = F.col("_ok").isNotNull() & F.col("_hit").isNull() & ~F.col("_bank")
    rank = F.row_number().over(Window.partitionBy("key", fit).orderBy(*order))
    reason = F.when(F.col("_ok").isNull(), "utterance_of_dropped_intent").when(F.col("_hit"), "held_out_text_overlap").when(F.col("_bank"), "banking_like_utterance").when(F.col("_r") > 1, "duplicate")
    return rows.withColumn("_r", rank).withColumn("drop_reason", reason).drop("_ok", "_hit", "_bank", "_r", "key")


def progress(ranked: DataFrame) -> DataFrame:
    """From gold ranks by decision: decisions, top-1 and top-10 hits of each domain."""
    return ranked.groupBy("domain").agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("gold_rank") == 0).alias("gold_top1"), F.count_if(F.col("gold_rank") < 10).alias("gold_top10"))


def flagged(scores: DataFrame, p: str = "p_yes") -> DataFrame:
    return scores.withColumn("flag", F.col(p) > FLAG_AT)


def soft_rows(rows: DataFrame, teacher: DataFrame) -> DataFrame:
    """Rows with the teacher's top as label and its probabilities as target; rows its orders disagree on go."""
    both = rows.drop("label", "target").join(teacher.where("agree").select("id", "label", F.col("probs").alias("target")), "id")
    return both


def soft_counts(rows: DataFrame, teacher: DataFrame) -> DataFrame:
    joined = rows.select("id").join(teacher.select("id", "agree"), "id", "left")
    return joined.agg(F.count_if(F.col("agree").isNull()).alias("unlabelled"), F.count_if(~F.col("agree")).alias("disagreed"), F.count_if("agree").alias("kept"))


def gold_mix(rows: DataFrame, teacher: DataFrame, weight: float = 0.5) -> DataFrame:
    """target = (1 - weight) teacher + weight on the gold label."""
    both = rows.join(teacher.select("id", "probs"), "id")
    mixed = F.transform("probs", lambda p, k: p * F.lit(1 - weight) + F.when(k == F.col("label"), F.lit(weight)).otherwise(F.lit(0.0)))
    return both.withColumn("target", mixed).drop("probs")


def first_by_source(rows: DataFrame, cap: int, order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(order))).where(F.col("_r") <= cap).drop("_r")


def carried(rows: DataFrame, existing: DataFrame, flagged_intents: DataFrame) -> DataFrame:
    """Rows of an earlier set whose (domain number, intent) isn't flagged and whose id is new. Ids read source/domain/intent/n."""
    parts = F.split("id", "/")
    keyed = rows.withColumns({"_domain": F.regexp_extract(F.get(parts, F.lit(1)), r"(\d+)$", 1), "_intent": F.get(parts, F.lit(2))})
    bad = flagged_intents.select(F.col("domain_ord").cast("string").alias("_domain"), F.col("intent").alias("_intent"))
    return keyed.join(bad, ["_domain", "_intent"], "left_anti").drop("_domain", "_intent").join(existing.select("id"), "id", "left_anti").dropDuplicates(["id"])


FLAG_ASKED = "Is this support request about money: banking, payments, cards, loans or one's own finances?"


def flag_questions(intents: DataFrame) -> DataFrame:
    """A yes/no question row for each (domain, intent, description)."""
    state = F.concat_ws("\n", F.concat(F.lit("Support desk: "), "domain"), F.concat(F.lit("Intent: "), F.replace("intent", F.lit("_"), F.lit(" "))), F.concat(F.lit("Description: "), "description"))
    none = F.lit(None).cast("string")
    options = F.lit(None).cast("array<struct<name:string,descr:string>>")
    return intents.select("domain", "intent", F.concat_ws("/", "domain", "intent").alias("request_id"), F.lit("noul").alias("type"), F.lit(FLAG_ASKED).alias("instructions"), state.alias("state"), options.alias("options"), none.alias("true_text"), none.alias("false_text"))


def flag_banking(intents: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, chunk_rows: int = 2000) -> DataFrame:
    """domain, intent, p_yes and flag of all intents, by a resumable run below ``path``.

    ``score`` gives request_id and probs (yes first) of question rows. A run that died goes on where chunks lack their commit.
    """
    from ..sources.chunks import committed_rows, run_chunks

    def asked(rows: DataFrame) -> DataFrame:
        found = score(rows).select("request_id", F.round(F.get("probs", F.lit(0)), 4).alias("p_yes"))
        return flagged(rows.select("domain", "intent", "request_id").join(found, "request_id"))

    questions = flag_questions(intents)
    run_chunks(questions, path, asked, "request_id", FLAG_ASKED, chunk_rows)
    return committed_rows(intents.sparkSession, path, "request_id string, domain string, intent string, p_yes double, flag boolean").drop("request_id")


def decision_rows(utterances: DataFrame, labels: DataFrame, score: Callable[[DataFrame], DataFrame], seed: str, wrong: int = 9) -> DataFrame:
    """Choices from utterances: the intent that an utterance was made for, and the ``wrong`` other intents of its domain that rank highest.

    utterances: domain, intent, n, text. labels: domain, intent, place. ``score`` adds ``margin`` to (domain, n, text, label_name, place). Adds options, label
    and gold_rank. An utterance meets its own domain's labels only, whose number a taxonomy bounds.
    """
    from ..operators.scoring import mined

    # texts are told apart by digests: what is exchanged for each label is short, and a text once
    said = utterances.select("domain", "n", "text", F.col("intent").alias("gold")).withColumn("_text", F.coalesce(F.left(F.sha2("text", 256), F.lit(32)), F.lit("")))
    keys = ["domain", "n", "_text", "gold"]
    pairs = said.join(F.broadcast(labels.select("domain", F.col("intent").alias("label_name"), "place")), "domain")
    scored = score(pairs).select(*keys, "label_name", "place", "margin")
    ranked = mined(scored, keys, F.col("label_name") == F.col("gold"), keep=wrong + 1).where("gold_rank IS NOT NULL")
    texts = said.groupBy(*keys).agg(F.first("text").alias("text")).withColumnRenamed("n", "_n")
    same = [*(ranked[k] == texts[k] for k in ("domain", "_text", "gold")), ranked["n"].eqNullSafe(texts["_n"])]
    options = H.shuffled(F.array_append(F.slice("wrong", 1, wrong), F.col("gold")), seed, F.col("domain"), F.col("n"))
    return ranked.join(texts, same).drop(texts["domain"], texts["_text"], texts["gold"]).withColumn("options", options).select("domain", "n", F.concat_ws("/", F.lit("synth"), "domain", F.col("n").cast("string")).alias("id"), F.col("text").alias("state"), "options", (F.array_position("options", F.col("gold")) - 1).cast("int").alias("label"), "gold_rank")


def decisions(utterances: DataFrame, labels: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, seed: str = "0", chunk_rows: int = 8) -> DataFrame:
    """``decision_rows`` of all domains by a resumable run: chunks of ``chunk_rows`` domains, each committed once."""
    from ..sources.chunks import committed_rows, run_chunks

    def rows_of(domains: DataFrame) -> DataFrame:
        own = F.broadcast(domains)  # those of some chunks
        return decision_rows(utterances.join(own, "domain", "left_semi"), labels.join(own, "domain", "left_semi"), score, seed)

    run_chunks(labels.select("domain").distinct(), path, rows_of, "domain", seed, chunk_rows)
    return committed_rows(utterances.sparkSession, path, "domain string, n long, id string, state string, options array<string>, label int, gold_rank int")
