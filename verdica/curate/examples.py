"""Augmented examples from labelled rows: state wrappers, yes/no criteria, options, candidates, levels.

Every draw is a digest of seed, row id and a name, so an example depends on its row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T

# Shares of the augmentations.
WRAPPERS = [("bare", 0.50), ("labelled", 0.30), ("json", 0.15), ("quoted", 0.05)]
PAIR_JSON = 0.4
CRITERIA = [("none", 0.55), ("both", 0.25), ("true", 0.15), ("false", 0.05)]
OPTION_COUNTS = [((2, 5), 0.55), ((6, 10), 0.25), ((11, 20), 0.12), ((26, 26), 0.08)]
DESCRIPTIONS = [("all", 0.40), ("none", 0.50), ("mixed", 0.10)]
NAME_STYLES = ["raw", "spaced", "title"]
NONE_OF_ABOVE, OTHER_DISTRACTOR, NEGATED, SIBLING = 0.08, 0.12, 0.075, 0.5
LEVELS = [("native", 0.70), ("three", 0.20), ("two", 0.10)]
MAX_OPTIONS, SHORT_OPTIONS, NEAR, NEIGHBOURS = 26, 10, 6, 15
OTHERS = ["something else", "none of the above", "other"]


def wrapped(text: Column, seed: str, key: Column, labels: list[str] | None = None, keys: list[str] | None = None) -> tuple[Column, Column]:
    """(state, wrapper kind) of a single text."""
    labels, keys = labels or ["Text", "Message", "Input"], keys or ["text", "message", "body"]
    kind = H.pick(H.uniform(seed, key, F.lit("wrap")), WRAPPERS)
    label = H.choose(H.uniform(seed, key, F.lit("label")), F.array(*[F.lit(x) for x in labels]))
    name = H.choose(H.uniform(seed, key, F.lit("key")), F.array(*[F.lit(x) for x in keys]))
    as_json = F.concat(F.lit("{"), F.substr(F.to_json(F.array(name)), F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(": "), F.substr(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2), F.lit("}"))
    state = F.when(kind == "labelled", F.concat(label, F.lit(": "), text)).when(kind == "json", as_json).when(kind == "quoted", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    return state, kind


def wrapped_pair(first: Column, second: Column, seed: str, key: Column, names: tuple[str, str] = ("first", "second"), labels: tuple[str, str] = ("First", "Second")) -> tuple[Column, Column]:
    as_json = H.uniform(seed, key, F.lit("pair")) < PAIR_JSON
    state = F.when(as_json, F.to_json(F.struct(first.alias(names[0]), second.alias(names[1])))).otherwise(F.concat(F.lit(f"{labels[0]}: "), first, F.lit(f"\n{labels[1]}: "), second))
    return state, F.when(as_json, "pair_json").otherwise("pair_labelled")


def noul_criteria(seed: str, key: Column, true_texts: Column, false_texts: Column) -> tuple[Column, Column, Column]:
    """(mode, true text, false text); a side without texts moves the mode to the other."""
    drawn = H.pick(H.uniform(seed, key, F.lit("criteria")), CRITERIA)
    no_true, no_false = F.size(true_texts) == 0, F.size(false_texts) == 0
    mode = F.when((drawn == "none") | (no_true & no_false), "none").when(no_true, "false").when(no_false, "true").otherwise(drawn)
    true = F.when(mode.isin("both", "true"), H.choose(H.uniform(seed, key, F.lit("true")), true_texts))
    false = F.when(mode.isin("both", "false"), H.choose(H.uniform(seed, key, F.lit("false")), false_texts))
    return mode, true, false


def option_count(seed: str, key: Column, available: Column) -> Column:
    """2 to 5, 6 to 10, 11 to 20 or 26 options, as many as there are."""
    u, v = H.uniform(seed, key, F.lit("k")), H.uniform(seed, key, F.lit("k2"))
    low, high = (H.pick(u, [(r[i], w) for r, w in OPTION_COUNTS]) for i in (0, 1))
    k = low + F.floor(v * (high - low + 1)).cast("int")
    return F.greatest(F.lit(2), F.least(k, available, F.lit(MAX_OPTIONS))).cast("int")


def choice_options(seed: str, key: Column, gold: Column, labels: Column, k: Column) -> Column:
    """Gold and k - 1 others by digest, then all by another digest. labels: array of names."""
    others = F.slice(H.shuffled(F.array_remove(labels, gold), seed, key, F.lit("others")), F.lit(1), k - 1)
    return H.shuffled(F.array_append(others, gold), seed, key, F.lit("order"))


def choice_rows(rows: DataFrame, seed: str, key: str, gold: str, labels: Column) -> DataFrame:
    """Adds k, options, label, other and nota: some rows lose their gold option to an "other", some get it as a distractor."""
    rid = F.col(key)
    rows = rows.withColumn("_labels", labels)
    k = option_count(seed, rid, F.size("_labels"))
    nota = (H.uniform(seed, rid, F.lit("nota")) < NONE_OF_ABOVE) | F.col(gold).isNull()
    distractor = H.uniform(seed, rid, F.lit("other")) < OTHER_DISTRACTOR
    other = H.choose(H.uniform(seed, rid, F.lit("othername")), F.array(*[F.lit(x) for x in OTHERS]))
    out = rows.withColumns({"k": k, "nota": nota, "_other": other})
    wrong = F.slice(H.shuffled(F.array_remove(F.col("_labels"), F.coalesce(F.col(gold), F.lit(""))), seed, rid, F.lit("others")), F.lit(1), F.col("k") - 1)
    out = out.withColumns({"_wrong": wrong, "other": F.col("nota") | (distractor & (F.size(wrong) >= 2))})
    kept = F.when(F.col("nota"), F.col("_wrong")).when(F.col("other"), F.array_append(F.slice("_wrong", F.lit(1), F.size("_wrong") - 1), F.col(gold))).otherwise(F.array_append("_wrong", F.col(gold)))
    ordered = H.shuffled(kept, seed, rid, F.lit("order"))
    out = out.withColumn("options", F.when(F.col("other"), F.array_append(ordered, F.col("_other"))).otherwise(ordered))
    answer = F.when(F.col("nota"), F.col("_other")).otherwise(F.col(gold))
    return out.withColumn("label", (F.array_position("options", answer) - 1).cast("int")).drop("_labels", "_other", "_wrong")


#: What an "other" option may be told to mean.
OTHER_MEANINGS = ["nothing else on this list is right", "whatever the rest leaves out"]


def collision_free(options: Column, taken: Column | None = None) -> Column:
    """The first option of each name in an array of (raw, name, descr, shown), names compared by ``shown`` without case, white space and end marks.

    ``taken`` holds such keys that none may have. Each option looks for its key among those before it: label sets are short.
    """
    keyed = F.transform(options, lambda o: F.struct(o.alias("o"), T.norm_text(o["shown"]).alias("n")))
    first = lambda s: F.filter(s, lambda x, i: (F.array_position(F.transform(s, lambda y: y["n"]), x["n"]) == i + 1) & ~F.array_contains(taken if taken is not None else F.array(F.lit("")), x["n"]))
    return F.transform(F.get(F.transform(F.array(keyed), first), F.lit(0)), lambda x: x["o"])


def described_choice_rows(rows: DataFrame, seed: str, key: str, gold: str, labels: Column) -> DataFrame:
    """Choices with name styles and descriptions. Adds k, options (name and descr), label, style, descriptions, nota and other.

    labels: array of (raw, name, descr); gold: the raw name of the right one, or null. All names of a row have one style. An
    option whose name in that style is another's, the gold one's or an "other" one's is passed over. Descriptions are shown of all options, of none, or of
    each by its own draw. "None of the above" stands last, another "other" anywhere.
    """
    rid = F.col(key)
    draw = lambda name, *more: H.uniform(seed, rid, F.lit(name), *more)
    style = H.choose(draw("style"), F.array(*[F.lit(x) for x in NAME_STYLES]))
    rows = rows.withColumn("style", style)
    shown = F.transform(labels, lambda x: F.struct(x["raw"].alias("raw"), x["name"].alias("name"), x["descr"].alias("descr"), T.styled(x["raw"], x["name"], F.col("style")).alias("shown")))
    rows = rows.withColumn("_all", shown)
    is_gold = lambda x: F.coalesce(x["raw"] == F.col(gold), F.lit(False))
    rows = rows.withColumn("_gold", F.get(F.filter("_all", is_gold), F.lit(0)))
    taken = F.concat(F.array(*[F.lit(x) for x in OTHERS]), F.array(F.coalesce(T.norm_text(F.col("_gold.shown")), F.lit(""))))
    pool = H.shuffled(F.filter("_all", lambda x: ~is_gold(x)), seed, rid, F.lit("others"))
    rows = rows.withColumn("_pool", collision_free(pool, taken=taken))
    k = option_count(seed, rid, F.size("_pool") + 1)
    nota = (draw("nota") < NONE_OF_ABOVE) | F.col("_gold").isNull()
    rows = rows.withColumns({"k": k, "nota": nota, "_wrong": F.slice("_pool", F.lit(1), k - 1)})
    rows = rows.withColumn("other", F.col("nota") | ((draw("other") < OTHER_DISTRACTOR) & (F.size("_wrong") >= 2)))
    kept = F.when(F.col("nota"), F.col("_wrong")).when(F.col("other"), F.array_append(F.slice("_wrong", F.lit(1), F.size("_wrong") - 1), F.col("_gold"))).otherwise(F.array_append("_wrong", F.col("_gold")))
    mode = F.when(F.exists("_all", lambda x: x["descr"].isNotNull()), H.pick(draw("descriptions"), DESCRIPTIONS)).otherwise("none")
    rows = rows.withColumns({"_kept": H.shuffled(kept, seed, rid, F.lit("order")), "descriptions": mode})
    tells = lambda u: (F.col("descriptions") == "all") | ((F.col("descriptions") == "mixed") & (u < 0.5))
    real = F.transform("_kept", lambda x: F.struct(x["shown"].alias("name"), F.when(tells(draw("shown", x["raw"])), x["descr"]).alias("descr")))
    word = H.choose(draw("othername"), F.array(*[F.lit(x) for x in OTHERS]))
    word = F.when(F.col("style") == "raw", F.lit("other")).when(F.col("style") == "title", F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))).otherwise(word)
    meaning = H.choose(draw("meaning"), F.array(*[F.lit(x) for x in OTHER_MEANINGS]))
    rows = rows.withColumns({"_real": real, "_word": word, "_extra": F.struct(word.alias("name"), F.when(tells(draw("othershown")), meaning).alias("descr"))})
    n = F.size("_real")
    place = F.when(F.contains("_word", F.lit("above")) | (draw("last") < 0.5), n).otherwise(F.floor(draw("place") * (n + 1)).cast("int"))
    rows = rows.withColumn("_place", place)
    options = F.when(F.col("other"), F.concat(F.slice("_real", F.lit(1), F.col("_place")), F.array("_extra"), F.slice("_real", F.col("_place") + 1, F.greatest(n - F.col("_place"), F.lit(0))))).otherwise(F.col("_real"))
    rows = rows.withColumn("options", options)
    answer = F.when(F.col("nota"), F.col("_word")).otherwise(F.col("_gold.shown"))
    label = (F.array_position(F.transform("options", lambda o: o["name"]), answer) - 1).cast("int")
    return rows.withColumns({"label": label, "k": F.size("options")}).drop("_all", "_gold", "_pool", "_wrong", "_kept", "_real", "_word", "_extra", "_place")


def neighbours(labels: DataFrame, name: str = "name", order: str = "ord", keep: int = NEIGHBOURS) -> DataFrame:
    """(name, neighbour, similarity, rank): the most similar names by Jaccard overlap of trigrams; ties keep label order.

    Names meet on the trigrams they share, so only pairs with something in common are formed. Where a name has fewer than
    ``keep`` of these, the first names by order follow; twice ``keep`` names and one are enough to choose from.
    """
    each = labels.select(F.col(name).alias("a"), F.col(order).alias("i"), F.explode(T.trigrams(F.col(name))).alias("g"))
    sizes = each.groupBy("a", "i").agg(F.count(F.lit(1)).alias("n"))
    other = each.select(F.col("a").alias("b"), F.col("i").alias("j"), "g")
    shared = each.join(other, "g").where("i <> j").groupBy("a", "i", "b", "j").agg(F.count(F.lit(1)).alias("both"))
    theirs = sizes.select(F.col("i").alias("j"), F.col("n").alias("m"))
    scored = shared.join(sizes.select("i", "n"), "i").join(theirs, "j").select("a", "i", "b", "j", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("similarity"))
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))).where(F.col("rank") <= keep)
    # bounded: 2 * keep + 1 names
    first = [(r[order], r[name]) for r in labels.select(order, name).orderBy(order).limit(2 * keep + 1).collect()]
    had = near.groupBy("i").agg(F.collect_list("j").alias("js"))
    lacking = sizes.join(had, "i", "left").select("a", "i", F.coalesce("js", F.array().cast(had.schema["js"].dataType)).alias("js")).where(F.size("js") < keep)
    names = F.array(*[F.struct(F.lit(j).cast(labels.schema[order].dataType).alias("j"), F.lit(b).alias("b")) for j, b in first])
    free = F.slice(F.filter(names, lambda x: (x["j"] != F.col("i")) & ~F.array_contains("js", x["j"])), F.lit(1), keep - F.size("js"))
    padded = lacking.select("a", F.size("js").alias("n"), F.posexplode(free).alias("p", "x")).select("a", F.col("x.b").alias("b"), F.lit(0.0).alias("similarity"), (F.col("n") + F.col("p") + 1).cast("int").alias("rank")) if first else near.select("a", "b", "similarity", "rank")
    return near.select("a", "b", "similarity", "rank").unionByName(padded).select(F.col("a").alias("name"), F.col("b").alias("neighbour"), "similarity", "rank")


def wrong_label(seed: str, key: Column, gold: Column, labels: Column, siblings: Column) -> tuple[Column, Column]:
    """(wrong label, whether a hard one): half the time from the gold's siblings, where it has any."""
    pool = F.array_remove(labels, gold)
    near = F.array_remove(siblings, gold)
    hard = (F.size(near) > 0) & (H.uniform(seed, key, F.lit("hard")) < SIBLING)
    u = H.uniform(seed, key, F.lit("wrong"))
    return F.when(hard, H.choose(u, near)).otherwise(H.choose(u, pool)), hard


def shortlist_options(seed: str, key: Column, gold: Column, wrong: Column) -> Column:
    """Gold among the nine best mined wrong labels; null where fewer were mined."""
    nine = F.slice(F.array_remove(wrong, gold), 1, SHORT_OPTIONS - 1)
    return F.when(F.size(nine) == SHORT_OPTIONS - 1, H.shuffled(F.array_append(nine, gold), seed, key, F.lit("order")))


def level_rows(rows: DataFrame, seed: str, key: str, level: str, native: int, collapse: dict[int, list[int | None]]) -> DataFrame:
    """Adds levels and label: native, or collapsed to three or two; a level without a place there stays native."""
    draw = H.pick(H.uniform(seed, F.col(key), F.lit("levels")), LEVELS)
    n = F.when(draw == "three", F.lit(3)).when(draw == "two", F.lit(2)).otherwise(F.lit(native))
    place = F.lit(None).cast("int")
    for size, mapping in collapse.items():
        place = F.when(n == size, F.get(F.array(*[F.lit(m).cast("int") for m in mapping]), F.col(level))).otherwise(place)
    ok = (n != native) & place.isNotNull()
    return rows.withColumns({"levels": F.when(ok, n).otherwise(F.lit(native)), "label": F.when(ok, place).otherwise(F.col(level))})


def ovr_rows(rows: DataFrame, seed: str, key: str, gold: str, labels: Column, want: str = "want") -> DataFrame:
    """Adds asked, negated and label for one-vs-rest questions: a negated statement about another label is true."""
    rid = F.col(key)
    out = rows.withColumns({"negated": (H.uniform(seed, rid, F.lit("negated")) < NEGATED) & F.col(gold).isNotNull(), "_labels": labels})
    match = F.col(want) != F.col("negated")
    other = H.choose(H.uniform(seed, rid, F.lit("asked")), F.array_remove(F.col("_labels"), F.coalesce(F.col(gold), F.lit(""))))
    return out.withColumns({"asked": F.when(match, F.col(gold)).otherwise(other), "label": F.col(want).cast("int")}).drop("_labels")
