"""Queries over documents, labels, conversations and events: keys, guards, quotas, samples, manifests, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..curate import build, examples, guards, synth
from ..curate import sources as S
from ..functions import hashing as H
from ..functions import text as T
from ..operators import analysis, sampling
from ..sources import rows as R
from ..streaming import serve
from .catalog import query, table

KEY = "lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))"
_DOCS = f"d AS (SELECT *, {KEY} AS key FROM documents)"
_LABELLED = f"{_DOCS}, l AS (SELECT d.*, quality, toxic FROM d JOIN labels USING (doc_id))"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("key", T.key(F.coalesce("text", F.lit(""))))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")


@query(f"WITH {_DOCS} SELECT doc_id, sha256(key) AS key, sha256(regexp_replace(key, '[.?! ]+$', '')) AS norm, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words FROM d")
def text_key(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2("key", 256).alias("key"), F.sha2(T.norm_text(F.col("text")), 256).alias("norm"), F.size(T.words(F.col("text"))).alias("n_words"))


@query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY doc_id) > 1 THEN 'duplicate_text' END AS drop_reason FROM d")
def exact_dedup(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.array(F.sha2("key", 256)).alias("keys"))
    return guards.first_by_key(rows, "keys", "doc_id", ["doc_id"]).select("doc_id", "drop_reason")


@query(f"WITH {_DOCS}, dev AS (SELECT DISTINCT key FROM d WHERE doc_id % 10 = 0) SELECT doc_id FROM d WHERE doc_id % 10 <> 0 AND NOT EXISTS (FROM dev WHERE dev.key = d.key)")
def reserved_keys(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.sha2("key", 256).alias("key"))
    train = rows.where("doc_id % 10 <> 0").withColumn("keys", F.array("key"))
    return guards.without_keys(train, rows.where("doc_id % 10 = 0"), "keys", "doc_id").select("doc_id")


@query(f"WITH {_DOCS}, f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS least FROM d) SELECT doc_id FROM f WHERE doc_id = least")
def independent_keys(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.array(F.sha2("key", 256)).alias("keys"))
    return guards.independent_rows(rows, "keys", "doc_id").select("doc_id")


@query("WITH r AS (SELECT DISTINCT doc_id, doc_id - dense_rank() OVER (ORDER BY doc_id) AS run FROM documents), s AS (SELECT *, min(doc_id) OVER (PARTITION BY run) AS first FROM r) SELECT doc_id FROM s WHERE (doc_id - first) % 2 = 0")
def independent_chain(spark, sf):
    """Each document conflicts with the next one: one chain as long as the table, of which every other row stays."""
    rows = table(spark, sf, "documents").select("doc_id", F.array(F.col("doc_id"), F.col("doc_id") + 1).alias("keys"))
    return guards.independent_rows(rows, "keys", "doc_id").select("doc_id")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_GUARD = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b) UNION SELECT '=' || array_to_string(w, ' ') FROM b),
dg AS (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w) UNION ALL SELECT doc_id, '=' || array_to_string(w, ' ') FROM w),
hit AS (SELECT DISTINCT doc_id FROM dg JOIN bg USING (g))"""


@query(f"WITH {_GUARD} SELECT doc_id FROM hit")
def ngram_guard(spark, sf):
    return guards.guard_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text")


@query(
    f"""WITH {_GUARD}, {_DOCS}, m AS (SELECT d.doc_id, key, source IN ('src0', 'src1') AS gone, hit.doc_id IS NOT NULL AS held, regexp_matches(text, 'zu') AS bank FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id),
r AS (SELECT *, NOT gone AND NOT held AND NOT bank AS fit, row_number() OVER (PARTITION BY key, NOT gone AND NOT held AND NOT bank ORDER BY doc_id) AS r FROM m)
SELECT coalesce(CASE WHEN gone THEN 'utterance_of_dropped_intent' WHEN held THEN 'held_out_text_overlap' WHEN bank THEN 'banking_like_utterance' WHEN r > 1 THEN 'duplicate' END, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"""
)
def guard_drop_reasons(spark, sf):
    """The filter ladder with a source as dropped intent and a German word standing for the topic pattern."""
    docs = documents(spark, sf).select("doc_id", F.sha2("key", 256).alias("key"), "source", F.col("text").rlike("zu").alias("bank"))
    hits = guards.guard_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text").withColumn("held", F.lit(True))
    rows = docs.join(hits, "doc_id", "left").withColumns({"gone": F.col("source").isin("src0", "src1"), "held": F.coalesce("held", F.lit(False))})
    fit = ~F.col("gone") & ~F.col("held") & ~F.col("bank")
    rank = F.row_number().over(Window.partitionBy("key", fit).orderBy("doc_id"))
    reason = build.first_reason(utterance_of_dropped_intent=F.col("gone"), held_out_text_overlap=F.col("held"), banking_like_utterance=F.col("bank"), duplicate=F.col("r") > 1)
    return rows.withColumn("r", rank).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ORDER = H.order_sql("'q'", "doc_id")


@query(
    f"""WITH {_LABELLED}, r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_ORDER}) AS r FROM l)
SELECT doc_id, quality FROM r WHERE r <= CASE quality WHEN 1 THEN 19 ELSE 21 END"""
)
def class_quota(spark, sf):
    quotas = build.class_quotas("mnli", "nli", 40)
    q = spark.createDataFrame([(1, quotas["entailment"]), (0, 40 - quotas["entailment"])], "quality int, quota int")
    rows = labelled(spark, sf).select("doc_id", F.col("quality").cast("int").alias("quality"))
    return sampling.take_quota(rows, q, "quality", H.order_key("q", F.col("doc_id"))).select("doc_id", "quality")


@query(
    """WITH RECURSIVE c AS (SELECT source AS key, count(*) AS available, row_number() OVER (ORDER BY source) AS o FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
budget AS (SELECT least(30, sum(available)) AS n FROM c),
levels AS (SELECT g AS level, sum(least(available, g)) AS used FROM c, range(0, 31) AS r(g) GROUP BY g),
best AS (SELECT max(level) AS level, arg_max(used, level) AS used FROM levels, budget WHERE used <= n),
x AS (SELECT key, available, least(available, level) AS base, CASE WHEN available > level THEN row_number() OVER (PARTITION BY available > level ORDER BY key) END AS r FROM c, best)
SELECT key, available, (base + CASE WHEN r <= (SELECT n - used FROM budget, best) THEN 1 ELSE 0 END)::BIGINT AS quota FROM x"""
)
def balanced_quota(spark, sf):
    counts = labelled(spark, sf).where("toxic = 1").groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("available"))
    return sampling.balanced_quota_table(counts, 30)


@query(
    """WITH c AS (SELECT lang AS key, count(*) AS weight FROM documents GROUP BY lang), e AS (SELECT *, 97.0::DOUBLE * weight / sum(weight) OVER () AS x FROM c),
r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, key) AS r FROM e) SELECT key, weight, (f + (r <= 97 - (SELECT sum(f) FROM r))::INT)::BIGINT AS n FROM r"""
)
def largest_remainder(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    return sampling.largest_remainder(counts, 97)


@query("SELECT source, count(*) AS n, greatest(1, CASE WHEN abs(count(*) * 0.05 - floor(count(*) * 0.05) - 0.5) < 1e-9 THEN 2 * round(count(*) * 0.025) ELSE round(count(*) * 0.05) END)::BIGINT AS scaled FROM documents GROUP BY source")
def scaled_quota(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("scaled", sampling.scaled(F.col("n"), 0.05))


@query(
    f"""WITH {_LABELLED}, o AS (SELECT doc_id, quality, key, row_number() OVER (ORDER BY {H.order_sql("'s'", 'doc_id')}, doc_id) - 1 AS position, count(*) OVER () AS n FROM l),
g AS (SELECT CASE WHEN n >= 108 THEN 60 ELSE floor(60 * n / 108) END AS tests, CASE WHEN n >= 108 THEN 40 ELSE floor(40 * n / 108) END AS calibs, CASE WHEN n >= 108 THEN 8 ELSE floor(8 * n / 108) END AS shots FROM (SELECT count(*) AS n FROM l)),
t AS (SELECT o.* FROM o, g WHERE position < tests), x AS (SELECT o.*, calibs, row_number() OVER (ORDER BY position) AS r FROM o, g WHERE position >= tests AND position < n - shots AND key NOT IN (SELECT key FROM t)),
c AS (SELECT * FROM x WHERE r <= calibs)
SELECT doc_id, 'test' AS role FROM t UNION ALL SELECT doc_id, 'calib' FROM c"""
)
def sample_roles(spark, sf):
    rows = labelled(spark, sf).withColumn("key", F.sha2(T.key(F.coalesce("text", F.lit(""))), 256)).select("doc_id", "key", "quality")
    return sampling.sample_roles(rows, "key", "s", "doc_id", 60, 40, 8, "quality").where("role <> 'shots'").select("doc_id", "role")


@query(
    f"""WITH {_LABELLED}, o AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {H.order_sql("'b'", 'doc_id')}, doc_id) AS position FROM l),
turns AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY position) AS depth, min(position) OVER (PARTITION BY quality) AS first FROM o)
SELECT doc_id, quality FROM turns ORDER BY depth, first LIMIT 12"""
)
def balanced_shots(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "quality")
    ranked = sampling.digest_positions(rows, H.order_key("b", F.col("doc_id")), "doc_id")
    return sampling.round_robin(ranked, 12, "quality").select("doc_id", "quality")


@query("WITH n AS (SELECT count(*) AS n FROM labels) SELECT role, CASE WHEN 9000 <= n THEN want ELSE want * n // 9000 END AS got FROM n, (VALUES ('test', 5000), ('calib', 3000), ('shots', 1000)) AS w(role, want)".replace("want * n // 9000", "floor(want * n / 9000)::BIGINT"))
def allocate_roles(spark, sf):
    got = sampling.allocate({"test": 5000, "calib": 3000, "shots": 1000}, table(spark, sf, "labels").count())
    return spark.createDataFrame(list(got.items()), "role string, got long")


@query(
    f"""WITH {_LABELLED}, o AS (SELECT doc_id, toxic = 1 AS able, {H.order_sql("'p'", 'doc_id')} AS h FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY h) AS r FROM o),
w AS (SELECT doc_id, able AND r <= 12 AS want, h FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY h) AS i FROM w) SELECT doc_id, want FROM n WHERE want OR i <= 28"""
)
def positive_rate_draw(spark, sf):
    rate = build.positive_rate("clinc", "ovr")
    rows = labelled(spark, sf).select("doc_id", "toxic")
    return sampling.positive_draw(rows, 40, rate, H.order_key("p", F.col("doc_id")), F.col("toxic") == 1).select("doc_id", "want")


@query(f"WITH o AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY {H.order_sql(chr(39) + 'u' + chr(39), 'conv_id', 'turn')}, turn) AS r FROM conversations) SELECT conv_id, turn, role FROM o WHERE r = 1")
def one_turn_per_dialogue(spark, sf):
    best = F.min_by(F.struct("turn", "role"), F.struct(H.order_key("u", F.col("conv_id"), F.col("turn")), "turn"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(best.alias("t")).select("conv_id", "t.turn", "t.role")


@query("SELECT (turn % 3)::BIGINT AS act, count(*) AS n, round(avg((regexp_matches(text, '\\.\\s*$'))::INT), 6) AS question_share FROM conversations GROUP BY 1")
def dialogue_act_check(spark, sf):
    """Acts are turns modulo three; the full stop stands for the question mark, which no test text has."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.translate("text", ".", "?")).alias("utterances"), F.collect_list(F.col("turn") % 3).alias("acts"))
    return S.dialogue_acts(turns).select("act", "n", F.round("question_share", 6).alias("question_share"))


@query("WITH p AS (SELECT source, toxic, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', 'lim', doc_id))) AS r, doc_id FROM documents JOIN labels USING (doc_id)) SELECT doc_id FROM p WHERE r <= 2")
def paragraph_limit(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "source")
    return build.limited(rows, "source", H.order_key("lim", F.col("doc_id"))).select("doc_id")


_TRI = """n AS (SELECT n_name AS name, n_nationkey AS ord, '  ' || lower(n_name) || ' ' AS s FROM nation), g AS (SELECT DISTINCT name, ord, substr(s, i::INT, 3) AS g FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM n)),
c AS (SELECT name, ord, count(*) AS c FROM g GROUP BY ALL), b AS (SELECT x.ord AS i, y.ord AS j, count(*) AS common FROM g x JOIN g y ON x.g = y.g WHERE x.ord <> y.ord GROUP BY ALL),
s AS (SELECT x.name, y.name AS neighbour, x.ord AS i, y.ord AS j, coalesce(common, 0)::DOUBLE / (x.c + y.c - coalesce(common, 0)) AS similarity FROM c x JOIN c y ON x.ord <> y.ord LEFT JOIN b ON b.i = x.ord AND b.j = y.ord),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j)::INT AS rank FROM s)"""


@query(f"WITH {_TRI} SELECT name, neighbour, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 15")
def name_neighbours(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return examples.neighbours(names).withColumn("similarity", F.round("similarity", 6))


_U = H.uniform_sql
_NAMES = "names AS (SELECT list(n_name ORDER BY n_nationkey) AS labels FROM nation)"
_GOLD = f"{_NAMES}, gold AS (SELECT d.doc_id, n.n_name AS gold, n.n_regionkey, toxic = 1 AS want FROM documents d JOIN labels USING (doc_id) JOIN nation n ON n.n_nationkey = d.doc_id % 25)"


def gold(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    labels = nation.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("labels"))
    siblings = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("siblings"))
    rows = labelled(spark, sf).select("doc_id", (F.col("toxic") == 1).alias("want"), (F.col("doc_id") % 25).cast("int").alias("n_nationkey"))
    return rows.join(nation.join(siblings, "n_regionkey"), "n_nationkey").select("doc_id", "want", F.col("n_name").alias("gold"), "siblings").crossJoin(labels)


@query(
    f"""WITH {_GOLD}, sib AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS s FROM nation GROUP BY n_regionkey),
x AS (SELECT doc_id, list_filter(s, lambda v: v <> gold) AS near, list_filter(labels, lambda v: v <> gold) AS pool, {_U("'h'", 'doc_id', "'hard'")} < 0.5 AS coin, {_U("'h'", 'doc_id', "'wrong'")} AS u FROM gold JOIN sib USING (n_regionkey), names)
SELECT doc_id, CASE WHEN coin AND len(near) > 0 THEN near[floor(u * len(near))::INT + 1] ELSE pool[floor(u * len(pool))::INT + 1] END AS wrong, coin AND len(near) > 0 AS hard FROM x"""
)
def hard_negatives(spark, sf):
    wrong, hard = examples.wrong_label("h", F.col("doc_id"), F.col("gold"), F.col("labels"), F.col("siblings"))
    return gold(spark, sf).select("doc_id", wrong.alias("wrong"), hard.alias("hard"))


_K = f"""x AS (SELECT gold.*, labels, {_U("'c'", 'doc_id', "'k'")} AS u, {_U("'c'", 'doc_id', "'k2'")} AS v FROM gold, names),
k AS (SELECT *, greatest(2, least(25, CASE WHEN u < 0.55 THEN 2 + floor(v * 4) WHEN u < 0.8 THEN 6 + floor(v * 5) WHEN u < 0.92 THEN 11 + floor(v * 10) ELSE 26 END))::INT AS k FROM x)"""


@query(f"WITH {_GOLD}, {_K} SELECT k, count(*) AS n FROM k GROUP BY k")
def option_counts(spark, sf):
    return gold(spark, sf).select(examples.option_count("c", F.col("doc_id"), F.size("labels")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_GOLD}, {_K}, o AS (SELECT doc_id, gold, k, list_filter(labels, lambda v: v <> gold) AS others FROM k),
e AS (SELECT doc_id, gold, k, unnest(others) AS name, unnest(range(0, 24)) AS i FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(concat_ws(':', 'c', doc_id, 'others', i)), i) AS r FROM e),
picked AS (SELECT doc_id, name, r - 1 AS i FROM r WHERE r < k UNION ALL SELECT doc_id, gold, k - 1 FROM k),
f AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(concat_ws(':', 'c', doc_id, 'order', i)), i) AS r FROM picked)
SELECT doc_id, string_agg(name, ',' ORDER BY r) AS options FROM f GROUP BY doc_id"""
)
def candidate_options(spark, sf):
    k = examples.option_count("c", F.col("doc_id"), F.size("labels"))
    rows = gold(spark, sf).withColumn("k", k)
    return rows.select("doc_id", F.array_join(examples.choice_options("c", F.col("doc_id"), F.col("gold"), F.col("labels"), F.col("k")), ",").alias("options"))


def _shuffled(values: str, *parts: str) -> str:
    """SQL: a list in the order of digests of the parts and the element's place."""
    digest = H.order_sql(*parts, "i")
    return f"list_transform(list_sort(list_transform(range(0, len({values})), lambda i: {{'h': {digest}, 'i': i, 'x': ({values})[i + 1]}})), lambda s: s.x)"


_DRAW = lambda part: _U("'x'", "doc_id", f"'{part}'")
_BOUND = lambda i: "CASE " + " ".join(f"WHEN u < {sum(w for _, w in examples.OPTION_COUNTS[: n + 1])} THEN {r[i]}" for n, (r, _) in enumerate(examples.OPTION_COUNTS[:-1])) + f" ELSE {examples.OPTION_COUNTS[-1][0][i]} END"


@query(
    f"""WITH {_GOLD}, u AS (SELECT doc_id, gold, labels, {_DRAW('k')} AS u, {_DRAW('k2')} AS v, {_DRAW('nota')} < {examples.NONE_OF_ABOVE} AS nota, {_DRAW('other')} < {examples.OTHER_DISTRACTOR} AS distractor, {examples.OTHERS}[floor({_DRAW('othername')} * {len(examples.OTHERS)})::INT + 1] AS name,
list_filter(labels, lambda v: v <> gold) AS pool FROM gold, names),
b AS (SELECT *, {_BOUND(0)} AS low, {_BOUND(1)} AS high FROM u), k AS (SELECT *, greatest(2, least(low + floor(v * (high - low + 1)), len(labels), {examples.MAX_OPTIONS}))::INT AS k FROM b),
w AS (SELECT *, {_shuffled('pool', "'x'", 'doc_id', "'others'")}[1:k - 1] AS wrong FROM k),
o AS (SELECT *, nota OR (distractor AND len(wrong) >= 2) AS other FROM w),
h AS (SELECT *, CASE WHEN nota THEN wrong WHEN other THEN list_append(wrong[1:len(wrong) - 1], gold) ELSE list_append(wrong, gold) END AS kept FROM o),
f AS (SELECT *, {_shuffled('kept', "'x'", 'doc_id', "'order'")} AS ordered FROM h), g AS (SELECT *, CASE WHEN other THEN list_append(ordered, name) ELSE ordered END AS options FROM f)
SELECT doc_id, k, array_to_string(options, ',') AS options, (list_position(options, CASE WHEN nota THEN name ELSE gold END) - 1)::INT AS label, nota, other FROM g"""
)
def choice_examples(spark, sf):
    rows = examples.choice_rows(gold(spark, sf), "x", "doc_id", "gold", F.col("labels"))
    return rows.select("doc_id", "k", F.array_join("options", ",").alias("options"), "label", "nota", "other")


@query(
    f"""WITH {_GOLD}, x AS (SELECT doc_id, gold, want, {_U("'o'", 'doc_id', "'negated'")} < 0.075 AS negated, list_filter(labels, lambda v: v <> gold) AS pool, {_U("'o'", 'doc_id', "'asked'")} AS u FROM gold, names)
SELECT doc_id, CASE WHEN want <> negated THEN gold ELSE pool[floor(u * 24)::INT + 1] END AS asked, negated, want::INT AS label FROM x"""
)
def ovr_examples(spark, sf):
    return examples.ovr_rows(gold(spark, sf), "o", "doc_id", "gold", F.col("labels")).select("doc_id", "asked", "negated", "label")


@query(
    f"""WITH x AS (SELECT doc_id, (doc_id % 5)::INT AS level, {_U("'v'", 'doc_id', "'levels'")} AS u FROM documents),
y AS (SELECT *, CASE WHEN u < 0.7 THEN 5 WHEN u < 0.9 THEN 3 ELSE 2 END AS n FROM x), z AS (SELECT *, CASE n WHEN 3 THEN [0, 0, 1, 2, 2][level + 1] WHEN 2 THEN [0, 0, NULL, 1, 1][level + 1] END AS place FROM y)
SELECT doc_id, CASE WHEN place IS NULL THEN 5 ELSE n END AS levels, coalesce(place, level) AS label FROM z"""
)
def score_collapse(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("level"))
    return examples.level_rows(rows, "v", "doc_id", "level", 5, {3: [0, 0, 1, 2, 2], 2: [0, 0, None, 1, 1]}).select("doc_id", "levels", "label")


@query(
    f"""WITH r AS (SELECT doc_id, source, quality, row_number() OVER (PARTITION BY source, {KEY} ORDER BY {H.order_sql("'g'", 'doc_id')}, doc_id) > 1 AS dup, {H.order_sql("'g'", 'doc_id')} AS h FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY source, quality, dup ORDER BY h, doc_id) AS r FROM r)
SELECT coalesce(CASE WHEN dup THEN 'duplicate_text' WHEN r > 4 THEN 'quota_full' END, 'taken') AS reason, count(*) AS n FROM k GROUP BY 1"""
)
def set_selection(spark, sf):
    items = labelled(spark, sf).select(F.col("doc_id").alias("id"), "source", F.col("quality").cast("string").alias("cls"), F.sha2(T.key(F.coalesce("text", F.lit(""))), 256).alias("key"))
    quotas = items.select("source", "cls").distinct().withColumn("quota", F.lit(4))
    return build.select_rows(items, quotas, "g", ["source"]).groupBy(F.coalesce("drop_reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {_LABELLED}, o AS (SELECT doc_id AS id, source, quality::VARCHAR AS cls, key, row_number() OVER (PARTITION BY source ORDER BY {H.order_sql("'g'", 'doc_id')}, doc_id) AS r FROM l),
walk(source, r, used, left0, left1, id, cls) AS (
    SELECT DISTINCT source, 0::BIGINT, []::VARCHAR[], 4, 4, NULL::BIGINT, NULL::VARCHAR FROM o
    UNION ALL
    SELECT source, r, CASE WHEN ok THEN list_append(used, key) ELSE used END, left0 - (ok AND cls = '0')::INT, left1 - (ok AND cls = '1')::INT, CASE WHEN ok THEN id END, CASE WHEN ok THEN cls END
    FROM (SELECT o.source, o.r, used, left0, left1, o.id, o.cls, o.key, NOT list_contains(used, o.key) AND CASE o.cls WHEN '0' THEN left0 > 0 WHEN '1' THEN left1 > 0 ELSE false END AS ok
        FROM walk w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.r = w.r + 1)
)
SELECT id, source, cls FROM walk WHERE id IS NOT NULL"""
)
def greedy_selection(spark, sf):
    items = labelled(spark, sf).select(F.col("doc_id").alias("id"), "source", F.col("quality").cast("string").alias("cls"), F.sha2(T.key(F.coalesce("text", F.lit(""))), 256).alias("key"))
    return build.select_greedy(items, {"0": 4, "1": 4}, "g", "source").where("taken").select("id", "source", "cls")


@query("SELECT doc_id, ceil(length(text) / 2.2)::BIGINT + 3 AS tokens, CASE WHEN contains(text, '<|') THEN 'control_token_text' WHEN ceil(length(text) / 2.2) + 3 > 512 THEN 'over_512_tokens' END AS reason FROM documents")
def token_proxy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_proxy(F.col("text")).alias("tokens"), build.length_reason(F.col("text")).alias("reason"))


@query(
    """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS n, round(avg(n_chars), 1) AS mean, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN n_chars END) AS p50, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN n_chars END) AS p95,
max(CASE WHEN i = least(n - 1, floor(0.99 * n)) THEN n_chars END) AS p99, max(n_chars) AS max, sum(n_chars)::BIGINT AS total FROM s GROUP BY lang"""
)
def length_stats(spark, sf):
    return sampling.length_stats(table(spark, sf, "documents"), "n_chars", ["lang"])


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    q = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("q"), F.round(F.avg("value"), 6).alias("mean"))
    return q.select("event_type", "n", F.round(F.get("q", F.lit(0)), 6).alias("p50"), F.round(F.get("q", F.lit(1)), 6).alias("p95"), "mean")


@query("SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id < 700 OR event_id % 7 = 3)")
def resume_pending(spark, sf):
    events = table(spark, sf, "events")
    return R.pending(events.select("event_id", "event_type"), events.where("event_id < 700 OR event_id % 7 = 3"), "event_id")


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_row_wins(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    return R.last_wins(rows, ["user_id"], "event_id")


@query("SELECT event_id, (props ->> '$.k')::INT AS k, json_keys(props)[1] AS first_key FROM events")
def json_leaf(spark, sf):
    leaf = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", leaf["k"].cast("int").alias("k"), F.get(F.map_keys(leaf), F.lit(0)).alias("first_key"))


@query("WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, floor((r - 1) / 8)::BIGINT AS chunk FROM o WHERE floor((r - 1) / 8) < floor(n / 8)")
def chunk_steps(spark, sf):
    return sampling.chunked(table(spark, sf, "documents").select("doc_id", "lang"), 8, F.col("doc_id"), ["lang"]).select("doc_id", "lang", "chunk")


@query(
    """WITH RECURSIVE o AS (SELECT doc_id, lang, n_chars::BIGINT AS n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
f(lang, r, doc_id, n_chars, batch, n, w) AS (SELECT lang, r, doc_id, n_chars, 0, 1, n_chars FROM o WHERE r = 1
UNION ALL SELECT o.lang, o.r, o.doc_id, o.n_chars, CASE WHEN (f.n + 1) * greatest(f.w, o.n_chars) > 20000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN (f.n + 1) * greatest(f.w, o.n_chars) > 20000 THEN 1 ELSE f.n + 1 END,
CASE WHEN (f.n + 1) * greatest(f.w, o.n_chars) > 20000 THEN o.n_chars ELSE greatest(f.w, o.n_chars) END FROM f JOIN o ON o.lang = f.lang AND o.r = f.r + 1)
SELECT lang, doc_id, n_chars, batch FROM f"""
)
def pack_batches(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.packed(rows, ["lang"], "n_chars", "doc_id", 20000)


@query(
    f"""WITH x AS (SELECT length(text) AS c, len({_WORDS}) + 1 AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT c / t::DOUBLE AS x, ceil(c / 2.2) + 3 < t AS under FROM x),
o AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT count(*) AS sampled, round(avg(x), 2) AS mean, round(max(x) FILTER (WHERE place = floor(0.01 * n)), 2) AS p01, round(min(x), 2) AS min, count(*) FILTER (WHERE under) AS proxy_undercounts FROM o"""
)
def chars_per_token(spark, sf):
    """Characters a token (here: a word) over all documents, its first percentile exact, and where the proxy counts too few."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select(F.length("text").alias("c"), (F.size(T.words(F.col("text"))) + 1).alias("t"))
    return sampling.ratio_stats(rows, "c", "t", F.ceil(F.col("c") / F.lit(2.2)) + 3)


@query("WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents) SELECT doc_id, n_chars FROM o WHERE (r - 1) % 37 = 0")
def systematic_sample(spark, sf):
    return sampling.every_kth(table(spark, sf, "documents").select("doc_id", "n_chars"), 37, "doc_id")


_FAMILY = "CASE WHEN doc_id % 3 = 0 THEN 'choice' WHEN doc_id % 3 = 1 THEN 'nli' ELSE 'ovr' END"


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("doc_id") % 3 == 0, "choice").when(F.col("doc_id") % 3 == 1, "nli").otherwise("ovr")
    return labelled(spark, sf).select(F.col("doc_id").alias("id"), "source", family.alias("family"), F.col("quality").alias("label"), F.sha2(T.key(F.coalesce("text", F.lit(""))), 256).alias("content"))


@query(f"SELECT source, family, count(*) AS n, round(avg(CASE WHEN family <> 'choice' THEN quality END), 4) AS positive_rate FROM (SELECT source, {_FAMILY} AS family, quality FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (source, family)")
def manifest_counts(spark, sf):
    return build.summary(decisions(spark, sf))


@query(f"WITH {_GUARD}, {_DOCS}, r AS (SELECT d.doc_id, d.source, key, hit.doc_id IS NOT NULL AS held, row_number() OVER (PARTITION BY key ORDER BY d.doc_id) > 1 AS dup FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id) SELECT 'train' AS role, source, CASE WHEN held THEN 'held_out_text_overlap' ELSE 'duplicate_text' END AS drop_reason, count(*) AS n FROM r WHERE held OR dup GROUP BY ALL")
def manifest_drops(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", F.sha2("key", 256).alias("key"))
    hits = guards.guard_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text").withColumn("held", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    reason = build.first_reason(held_out_text_overlap=F.coalesce("held", F.lit(False)), duplicate_text=F.col("r") > 1)
    rows = docs.join(hits, "doc_id", "left").withColumn("r", rank).withColumn("drop_reason", reason).where("drop_reason IS NOT NULL")
    return rows.groupBy(F.lit("train").alias("role"), "source", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_LABELLED}, t AS (SELECT doc_id, key, CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'dev_in' ELSE 'dev_xfer' END AS role FROM l)
SELECT count(*) AS rows, count(*) - count(DISTINCT doc_id) AS repeated_ids,
(SELECT count(*) FROM (SELECT key FROM t WHERE role = 'train' INTERSECT SELECT key FROM t WHERE role <> 'train')) AS train_in_dev,
(SELECT count(*) FROM (SELECT key FROM t WHERE role = 'dev_in' INTERSECT SELECT key FROM t WHERE role = 'dev_xfer')) AS dev_in_xfer, count(*) FILTER (WHERE doc_id % 4 = 0) - count(DISTINCT CASE WHEN doc_id % 4 = 0 THEN doc_id // 8 END) AS repeated_uids FROM t"""
)
def set_guards(spark, sf):
    d = decisions(spark, sf).withColumn("uid", F.when(F.col("id") % 4 == 0, F.floor(F.col("id") / 8)))
    return guards.set_checks(d.where("id % 5 < 3"), d.where("id % 5 = 3"), d.where("id % 5 = 4"), uid="uid")


@query("SELECT event_id AS id, event_type FROM events WHERE event_type NOT IN ('click') AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 0)")
def carry_drop(spark, sf):
    events = table(spark, sf, "events").select(F.concat_ws("/", F.lit("synth"), F.lit("tag1"), "event_type", F.col("event_id").cast("string")).alias("id"), "event_id", "event_type")
    flags = spark.createDataFrame([(1, "click")], "domain_ord int, intent string")
    return synth.carried(events, events.where("event_id % 4 = 0"), flags).select(F.col("event_id").alias("id"), "event_type")


@query("WITH o AS (SELECT event_id AS step, value, row_number() OVER (ORDER BY event_id) AS n FROM events), t AS (SELECT *, avg(value) OVER (ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS recent, avg(value) FILTER (WHERE n <= 50) OVER () AS first_mean FROM o) SELECT step, round(recent, 6) AS recent, n >= 150 AND round(recent, 9) > round(first_mean, 9) AS above_first FROM t")
def stop_rules(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    out = analysis.stop_rules(log)
    return out.select("step", F.round("trailing", 6).alias("recent"), "above_first")


@query("WITH o AS (SELECT event_id AS step, value, lag(value, 1) OVER (ORDER BY event_id) AS one, lag(value, 2) OVER (ORDER BY event_id) AS two FROM events) SELECT step, coalesce(two < one AND one < value, false) AS stop FROM o")
def early_stop(spark, sf):
    return analysis.rises(table(spark, sf, "events").select(F.col("event_id").alias("step"), "value"), "step", "value").select("step", "stop")


@query("SELECT event_id AS step, round(CASE WHEN s <= 100 THEN 0.001 * s / 100 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, (s - 100) / 4900.0)))) END, 9) AS rate FROM (SELECT event_id, event_id + 1 AS s FROM events)")
def lr_schedule(spark, sf):
    """The rate at each event's step; steps beyond the 5,000th keep the least."""
    return table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round(analysis.learning_rate(F.col("event_id") + 1, 5000, 0.001, 100), 9).alias("rate"))


@query("SELECT count(*) AS n, sum(('0x' || substr(sha256(doc_id || ':' || source), 1, 12))::BIGINT)::VARCHAR AS digest FROM documents")
def table_digest(spark, sf):
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "source")
    part = F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("decimal(38,0)").cast("string").alias("digest"))


@query(f"SELECT doc_id FROM documents ORDER BY {H.order_sql(chr(39) + '0:train-order' + chr(39), 'doc_id')}, doc_id")
def train_order(spark, sf):
    return build.train_order(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "0").select(F.col("id").alias("doc_id"))


@query("SELECT event_type, time_bucket(INTERVAL 1 day, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL")
def latency_windows(spark, sf):
    out = serve.window_measures(table(spark, sf, "events"), "1 day", by=["event_type"])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "most")


@query(
    """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY user_id, s"""
)
def latency_sessions(spark, sf):
    out = serve.sessions(table(spark, sf, "events"), "6 hours", "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))
