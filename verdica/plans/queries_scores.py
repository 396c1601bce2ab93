"""Queries over logits: probabilities, answers, metrics, calibration, two-stage choices, teachers, early exit.

The embeddings table stands for raw scores: ten dimensions in a row are a choice's logits, others a second model's,
a first cycle's, or a second option order's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import argmax, doubles, item
from ..operators import analysis, calibrate, metrics, scoring, teacher
from .catalog import query, table
from .report import by_cycle

TEMPERATURES = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0]


def dims(first: int, n: int | Column) -> Column:
    return doubles(F.slice("embedding", F.lit(first), n if isinstance(n, Column) else F.lit(n)))


def raw(spark: SparkSession, sf: str, first: int = 1, n: int = 10) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", dims(first, n).alias("logits"))


def with_probs(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    return raw(spark, sf, n=n).select("vec_id", (F.col("label") % n).cast("int").alias("label"), P.softmax(F.col("logits")).alias("probs"))


def noul(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, n=2).select("vec_id", (F.col("label") % 2).cast("int").alias("label"), P.noul_probs(F.col("logits")).alias("probs"))


def exploded(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("k", name)).withColumn(name, F.round(name, 6))


def long(first: int, n: int | str, name: str = "z", where: str = "true") -> str:
    """SQL: one row a logit."""
    return f"{name} AS (SELECT vec_id, label, (i - {first})::INT AS k, embedding[i]::DOUBLE AS x FROM embeddings, range({first}, {first} + 64) AS r(i) WHERE i < {first} + {n} AND {where})"


def soft(src: str = "z", name: str = "p", t: str = "1.0") -> str:
    """SQL: adds the probability p and log probability lp."""
    return (
        f"{name}_m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM {src}), {name}_e AS (SELECT *, exp((x - m) / {t}) AS e FROM {name}_m), "
        f"{name} AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, (x - m) / {t} - ln(sum(e) OVER (PARTITION BY vec_id)) AS lp FROM {name}_e)"
    )


SIG = "0.5 * (1 + tanh(0.5 * {}))"
TOP = "top AS (SELECT vec_id, k AS pick, p AS conf FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS r FROM p) WHERE r = 1)"


@query(f"WITH {long(1, 10)}, {soft()} SELECT vec_id, k, round(p, 6) AS p FROM p")
def softmax_choice(spark, sf):
    return exploded(raw(spark, sf), P.softmax(F.col("logits")), "p")


@query(f"WITH {long(1, 10)}, {soft()} SELECT vec_id, k, round(lp, 6) AS lp FROM p")
def log_softmax_choice(spark, sf):
    return exploded(raw(spark, sf), P.log_softmax(F.col("logits")), "lp")


@query(f"WITH {long(1, 10)}, {soft(t='2.5')} SELECT vec_id, k, round(p, 6) AS p FROM p")
def temperature_choice(spark, sf):
    return exploded(raw(spark, sf), P.softmax(F.col("logits"), 2.5), "p")


@query(f"WITH {long(1, 10)}, {soft()}, {TOP} SELECT vec_id, 'option ' || pick AS choice, round(conf, 6) AS p, round(greatest(0, least(1, (10 * conf - 1) / 9)), 6) AS confidence FROM top")
def answer_choice(spark, sf):
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("option "), i.cast("string")))
    a = with_probs(spark, sf).select("vec_id", P.choice_answer(names, F.col("probs")).alias("a"))
    return a.select("vec_id", "a.choice", F.array_max(F.transform("a.probabilities", lambda x: x["p"])).alias("p"), "a.confidence")


@query(f"WITH {long(1, 5)}, {soft()} SELECT vec_id, round(sum(k * p), 6) AS score, round(greatest(0, least(1, (5 * max(p) - 1) / 4)), 6) AS confidence FROM p GROUP BY vec_id")
def answer_score(spark, sf):
    levels = F.array(*[F.lit(f"level {i}") for i in range(5)])
    return with_probs(spark, sf, 5).select("vec_id", P.score_answer(levels, F.col("probs")).alias("a")).select("vec_id", "a.score", "a.confidence")


@query(f"SELECT vec_id, round({SIG.format('(embedding[1]::DOUBLE - embedding[2]::DOUBLE)')}, 6) AS noul FROM embeddings")
def answer_noul(spark, sf):
    return noul(spark, sf).select("vec_id", P.noul_answer(item(F.col("probs"), 1)).alias("a")).select("vec_id", "a.noul")


@query(f"WITH {long(1, 10)}, {soft()} SELECT vec_id, round(greatest(0, least(1, (10 * max(p) - 1) / 9)), 6) AS confidence, abs(sum(p) - 1) <= 1e-4 AS valid FROM p GROUP BY vec_id")
def confidence(spark, sf):
    return with_probs(spark, sf).select("vec_id", F.round(P.confidence(F.col("probs")), 6).alias("confidence"), P.valid(F.col("probs"), F.lit(10)).alias("valid"))


def _metric_sql(n: int | str, labels: str, extra: str = "", where: str = "true", t: str = "1.0") -> str:
    return f"""WITH {long(1, n, where=where)}, {soft(t=t)}, {TOP},
rows AS (
    SELECT vec_id, {labels} AS y, sum((p - (k = {labels})::INT) ** 2) AS brier, max(CASE WHEN k = {labels} THEN p END) AS py, sum(k * p) AS expected FROM p GROUP BY vec_id, label
),
r AS (SELECT rows.*, (pick = y)::INT AS hit, conf, least(floor(conf * 15), 14) AS bin FROM rows JOIN top USING (vec_id)),
b AS (SELECT bin, count(*) AS c, abs(avg(hit) - avg(conf)) AS gap FROM r GROUP BY bin)
SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(-ln(greatest(py, 1e-12))), 6) AS nll, round(avg(brier), 6) AS brier,
    (SELECT round(sum(c * gap) / sum(c), 6) FROM b) AS ece{extra} FROM r"""


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_metric_sql(10, "label"))
def metrics_choice(spark, sf):
    return rounded(metrics.summarize(metrics.checked(with_probs(spark, sf))))


@query(_metric_sql(5, "label % 5", ", round(avg(abs(expected - y)), 6) AS mae, round(avg(hit), 6) AS exact"))
def metrics_score(spark, sf):
    rows = with_probs(spark, sf, 5)
    more = rows.agg(*[c.alias(k) for k, c in metrics.score_measures(F.col("probs"), F.col("label")).items()])
    return rounded(metrics.summarize(rows).crossJoin(more))


@query(_metric_sql("(2 + vec_id % 9)", "(label % (2 + vec_id % 9))"))
def metrics_ragged(spark, sf):
    n = (2 + F.col("vec_id") % 9).cast("int")
    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % n).cast("int").alias("label"), P.softmax(dims(1, n)).alias("probs"))
    return rounded(metrics.summarize(rows))


_NOUL = f"s AS (SELECT vec_id, label % 2 AS y, {SIG.format('(embedding[1]::DOUBLE - embedding[2]::DOUBLE)')} AS p FROM embeddings)"
_RANKS = "k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM s)"
_AUROC = "(sum(r) FILTER (WHERE y = 1) - (count(*) FILTER (WHERE y = 1)) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif((count(*) FILTER (WHERE y = 1)) * (count(*) FILTER (WHERE y = 0)), 0)"


@query(
    f"""WITH {_NOUL}, {_RANKS}, r AS (SELECT y, p, greatest(p, 1 - p) AS conf, (CASE WHEN p > 1 - p THEN 1 ELSE 0 END = y)::INT AS hit, least(floor(greatest(p, 1 - p) * 15), 14) AS bin FROM s),
b AS (SELECT bin, count(*) AS c, abs(avg(hit) - avg(conf)) AS gap FROM r GROUP BY bin)
SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12))), 6) AS nll, round(avg(2 * (p - y) ** 2), 6) AS brier,
(SELECT round(sum(c * gap) / sum(c), 6) FROM b) AS ece, (SELECT round({_AUROC}, 6) FROM k) AS auroc FROM r"""
)
def metrics_noul(spark, sf):
    rows = noul(spark, sf)
    return rounded(metrics.summarize(rows).crossJoin(metrics.auroc(rows.withColumn("score", item(F.col("probs"), 1)))))


@query(
    f"""WITH {long(1, 10)}, {soft()}, {TOP}, r AS (SELECT conf, (pick = label)::INT AS hit, least(floor(conf * 15), 14)::INT AS bin FROM top JOIN embeddings USING (vec_id)),
b AS (SELECT bin, count(*) AS n, avg(conf) AS confidence, avg(hit) AS accuracy FROM r GROUP BY bin)
SELECT s.i::INT AS bin, round(s.i / 15.0, 6) AS low, round((s.i + 1) / 15.0, 6) AS high, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(0, 15) AS s(i) LEFT JOIN b ON b.bin = s.i"""
)
def reliability(spark, sf):
    return rounded(metrics.reliability(with_probs(spark, sf)))


@query(
    f"""WITH {long(1, 10)}, {soft()}, {TOP}, r AS (SELECT label % 4 AS part, conf, (pick = label)::INT AS hit, least(floor(conf * 15), 14) AS bin FROM top JOIN embeddings USING (vec_id)),
b AS (SELECT part, bin, count(*) AS c, abs(avg(hit) - avg(conf)) AS gap FROM r GROUP BY part, bin) SELECT part::INT AS part, round(sum(c * gap) / sum(c), 6) AS ece FROM b GROUP BY part"""
)
def ece(spark, sf):
    rows = with_probs(spark, sf).withColumn("part", (F.col("label") % 4).cast("int"))
    return rounded(metrics.ece(rows, ["part"]))


@query(f"WITH s AS (SELECT label % 2 AS y, round(embedding[1]::DOUBLE, 1) AS p FROM embeddings), {_RANKS} SELECT round({_AUROC}, 6) AS auroc FROM k")
def auroc_ties(spark, sf):
    rows = raw(spark, sf).select((F.col("label") % 2).alias("label"), F.round(item(F.col("logits"), 0), 1).alias("score"))
    return rounded(metrics.auroc(rows))


@query(
    f"""WITH {long(1, 10)}, {soft()}, {TOP},
r AS (SELECT e.vec_id, CASE e.label % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'nli' ELSE 'ovr' END AS family, 'src' || (e.vec_id % 4) AS source, (pick = e.label)::INT AS hit FROM embeddings e JOIN top USING (vec_id)),
g AS (SELECT grouping(family) AS gf, grouping(source) AS gs, family, source, count(*) AS n, round(avg(hit), 6) AS accuracy, bool_and(family <> 'choice') AS all_yes_no FROM r GROUP BY GROUPING SETS ((), (family), (source)))
SELECT CASE WHEN gf = 0 THEN 'family' WHEN gs = 0 THEN 'source' ELSE 'all' END AS kind, coalesce(family, source, '') AS name, n, accuracy, all_yes_no FROM g"""
)
def metrics_grouping_sets(spark, sf):
    rows = with_probs(spark, sf).withColumns({"family": F.element_at(F.array(F.lit("choice"), F.lit("nli"), F.lit("ovr")), (F.col("label") % 3 + 1).cast("int")), "source": F.concat(F.lit("src"), (F.col("vec_id") % 4).cast("string"))})
    return rounded(metrics.grouped(rows).select("kind", "name", "n", "accuracy", "all_yes_no"))


@query(
    f"""WITH {long(1, 10)}, t AS (SELECT unnest({TEMPERATURES}::DOUBLE[]) AS t), zt AS (SELECT z.*, t, x / t AS s FROM z, t), m AS (SELECT *, max(s) OVER (PARTITION BY vec_id, t) AS m FROM zt),
l AS (SELECT vec_id, t, max(m) + ln(sum(exp(s - m))) - max(CASE WHEN k = label THEN s END) AS nll FROM m GROUP BY vec_id, t) SELECT t, round(avg(nll), 6) AS nll FROM l GROUP BY t"""
)
def temperature_grid(spark, sf):
    rows = raw(spark, sf)
    sums = rows.agg(F.array(*[F.struct(F.lit(t).alias("t"), F.avg(calibrate.nll_at(F.col("logits"), F.col("label"), t)).alias("nll")) for t in TEMPERATURES]).alias("g"))
    return rounded(sums.select(F.inline("g")))


def _parts(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    n = 2 if kind == "noul" else 10
    return raw(spark, sf, n=n).select(F.lit("run").alias("run_id"), F.lit(kind).alias("kind"), F.lit("letter").alias("stage"), F.when(F.col("vec_id") % 2 == 0, "calib").otherwise("test").alias("split"), (F.col("label") % n).cast("int").alias("label"), "logits", F.lit(None).cast("array<array<double>>").alias("cycle_logits"))


def _temperature_sql(passes: int = 8, points: int = 33) -> str:
    """SQL: grids of temperatures by log, each around the best of the one before; ``fitted`` has the last's middle."""
    parts = [long(1, 10, "zc", "vec_id % 2 = 0"), "c AS MATERIALIZED (SELECT vec_id, x - max(x) OVER (PARTITION BY vec_id) AS x, k = label % 10 AS gold FROM zc)", "b0 AS (SELECT ln(0.05) AS low, ln(50.0) AS high)"]
    for i in range(1, passes + 1):
        parts += [
            f"g{i} AS MATERIALIZED (SELECT i, low + (high - low) * i / {points - 1}.0 AS lt FROM b{i - 1}, range(0, {points}) AS r(i))",
            f"l{i} AS MATERIALIZED (SELECT i, avg(nll) AS nll FROM (SELECT i, vec_id, ln(sum(exp(x / exp(lt)))) - sum(CASE WHEN gold THEN x / exp(lt) ELSE 0 END) AS nll FROM c, g{i} GROUP BY i, vec_id) GROUP BY i)",
            f"n{i} AS MATERIALIZED (SELECT first(i ORDER BY nll, i) AS best FROM l{i})",
            f"b{i} AS MATERIALIZED (SELECT min(lt) AS low, max(lt) AS high FROM g{i}, n{i} WHERE i BETWEEN best - 1 AND best + 1)",
        ]
    return ", ".join([*parts, f"fitted AS MATERIALIZED (SELECT exp((low + high) / 2) AS t FROM b{passes})"])


def _platt_sql(steps: int = 15) -> str:
    """SQL: Newton steps, one after the other; ``w{steps}`` has the last's a and b."""
    parts = ["m AS MATERIALIZED (SELECT embedding[1]::DOUBLE - embedding[2]::DOUBLE AS x, label % 2 AS y FROM embeddings WHERE vec_id % 2 = 0)", "w0 AS (SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(1, steps + 1):
        means = f"avg((p - y) * x) + {calibrate.RIDGE} * a AS g0, avg(p - y) + {calibrate.RIDGE} * b AS g1, avg(p * (1 - p) * x * x) + {calibrate.RIDGE} AS h00, avg(p * (1 - p) * x) AS h01, avg(p * (1 - p)) + {calibrate.RIDGE} AS h11"
        parts += [
            f"s{i} AS MATERIALIZED (SELECT a, b, {means} FROM (SELECT *, {SIG.format('(a * x + b)')} AS p FROM m, w{i - 1}) GROUP BY a, b)",
            f"w{i} AS MATERIALIZED (SELECT a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{i})",
        ]
    return ", ".join([*parts, f"fitted AS (SELECT a, b FROM w{steps})"])


@query(f"WITH {_temperature_sql()} SELECT 'choice' AS kind, round(t, 4) AS temperature FROM fitted")
def fit_temperature(spark, sf):
    cal = calibrate.fit_calibrator(_parts(spark, sf, "choice"), "run")
    return spark.createDataFrame([("choice", round(cal.choice_T, 4))], "kind string, temperature double")


@query(f"WITH {_platt_sql()} SELECT 'noul' AS kind, round(a, 4) AS a, round(b, 4) AS b FROM fitted")
def fit_platt(spark, sf):
    cal = calibrate.fit_calibrator(_parts(spark, sf, "noul"), "run")
    return spark.createDataFrame([("noul", round(cal.noul_a, 4), round(cal.noul_b, 4))], "kind string, a double, b double")


@query(
    f"WITH {_temperature_sql()} SELECT *, 'raw' AS form FROM ({_metric_sql(10, 'label', where='vec_id % 2 = 1')}) "
    f"UNION ALL SELECT *, 'calibrated' AS form FROM ({_metric_sql(10, 'label', where='vec_id % 2 = 1', t='(SELECT t FROM fitted)')})"
)
def calibrated_report(spark, sf):
    """Fit on one half, measure on the other: raw and calibrated side by side."""
    rows = _parts(spark, sf, "choice")
    cal, test = calibrate.fit_calibrator(rows), rows.where("split = 'test'")
    both = [metrics.summarize(test.withColumn("probs", c.probs(F.col("kind"), F.col("logits"), F.col("stage")))).withColumn("form", F.lit(name)) for name, c in (("raw", calibrate.Calibrator()), ("calibrated", cal))]
    return rounded(both[0].unionByName(both[1]))


@query(f"WITH {long(1, 64)}, {soft()} SELECT vec_id, k, round(lp, 6) AS lp, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, k) AS r FROM p) WHERE r <= 10")
def two_stage_shortlist(spark, sf):
    pairs = table(spark, sf, "embeddings").select("vec_id", F.posexplode(doubles(F.col("embedding"))).alias("k", "margin"))
    kept = scoring.stage1(pairs, ["vec_id"], "margin", "k").where(F.col("rank") <= scoring.SHORTLIST)
    return kept.select("vec_id", "k", F.round("lp", 6).alias("lp"), "rank")


@query(
    f"""WITH {long(1, 64)}, {soft()}, kept AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, k) AS r FROM p),
s AS (SELECT kept.vec_id, label, k, embedding[64 - k]::DOUBLE AS x, lp AS lp1 FROM kept JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id) WHERE r <= 10), {soft('s', 'q')},
mass AS (SELECT vec_id, ln(sum(exp(lp1))) AS m FROM s GROUP BY vec_id)
SELECT p.vec_id, p.k, round(coalesce(mass.m + q.lp, p.lp), 6) AS lp FROM p JOIN mass USING (vec_id) LEFT JOIN q ON q.vec_id = p.vec_id AND q.k = p.k"""
)
def two_stage_merge(spark, sf):
    """Stage 2 reads the dimensions from the other end."""
    lp1 = P.log_softmax(doubles(F.col("embedding")))
    rows = table(spark, sf, "embeddings").select("vec_id", doubles(F.reverse("embedding")).alias("other"), lp1.alias("lp1"))
    rows = rows.withColumn("kept", P.shortlist(F.col("lp1"), 10))
    second = P.log_softmax(F.transform("kept", lambda j: F.get(F.col("other"), j)))
    return exploded(rows.withColumn("lp2", second), P.merge_shortlist(F.col("lp1"), F.col("kept"), F.col("lp2")), "lp")


@query(
    """WITH t AS (SELECT vec_id, k, embedding[1 + 3 * k]::DOUBLE AS e, embedding[2 + 3 * k]::DOUBLE AS n, embedding[3 + 3 * k]::DOUBLE AS c FROM embeddings, range(0, 4) AS r(k))
SELECT vec_id, k::INT AS k, round(e - (greatest(e, n, c) + ln(exp(e - greatest(e, n, c)) + exp(n - greatest(e, n, c)) + exp(c - greatest(e, n, c)))), 6) AS logit FROM t"""
)
def nli_readout(spark, sf):
    triples = F.array(*[dims(1 + 3 * k, 3) for k in range(4)])
    return exploded(table(spark, sf, "embeddings").withColumn("t", triples), scoring.nli_logits(F.lit("choice"), F.col("t")), "logit")


def _margins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(dims(1, 20)).alias("place", "margin")).withColumn("label_name", F.concat(F.lit("l"), F.col("place").cast("string")))


@query(f"WITH {long(1, 20)} SELECT vec_id, k AS place, (row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) - 1)::INT AS rank FROM z")
def rank_labels(spark, sf):
    return scoring.ranked_labels(_margins(spark, sf), ["vec_id"]).select("vec_id", "place", "rank")


@query(
    f"""WITH {long(1, 20)}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) - 1 AS rank FROM z),
w AS (SELECT vec_id, 'l' || k AS name, row_number() OVER (PARTITION BY vec_id ORDER BY rank) AS i FROM r WHERE k <> label)
SELECT g.vec_id, g.rank::INT AS gold_rank, string_agg(w.name, ',' ORDER BY w.i) AS wrong FROM r g JOIN w USING (vec_id) WHERE g.k = g.label AND w.i <= 15 GROUP BY g.vec_id, g.rank"""
)
def mine_negatives(spark, sf):
    found = scoring.mined(_margins(spark, sf), ["vec_id"], F.col("place") == F.col("label"))
    return found.select("vec_id", "gold_rank", F.array_join("wrong", ",").alias("wrong"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    first = rows.select("vec_id", F.lit(0).alias("order"), F.sequence(F.lit(0), F.lit(9)).cast("array<int>").alias("perm"), dims(1, 10).alias("logits"))
    second = rows.select("vec_id", F.lit(1).alias("order"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (3 * i + 1) % 10).cast("array<int>").alias("perm"), dims(31, 10).alias("logits"))
    return first.unionByName(second)


_TWO_ORDERS = f"""{long(1, 10, 'za')}, {soft('za', 'pa')}, {long(31, 10, 'zb')}, {soft('zb', 'pb')}, b AS (SELECT vec_id, ((3 * k + 1) % 10)::INT AS k, p FROM pb),
c AS (SELECT pa.vec_id, pa.k, (pa.p + b.p) / 2 AS p, pa.p AS p1, b.p AS p2 FROM pa JOIN b ON pa.vec_id = b.vec_id AND pa.k = b.k)"""


@query(
    f"""WITH {_TWO_ORDERS}, t AS (SELECT vec_id, first(k ORDER BY p DESC, k) AS label, first(k ORDER BY p1 DESC, k) = first(k ORDER BY p2 DESC, k) AS agree, max(p) AS top FROM c GROUP BY vec_id)
SELECT vec_id, label::INT AS label, agree, round(top, 6) AS top FROM t"""
)
def teacher_combine(spark, sf):
    return teacher.teacher_rows(_orders(spark, sf), ["vec_id"]).select("vec_id", "label", "agree", F.round(F.array_max("probs"), 6).alias("top"))


@query(f"WITH {_TWO_ORDERS}, t AS (SELECT vec_id, first(k ORDER BY p1 DESC, k) AS a, first(k ORDER BY p2 DESC, k) AS b FROM c GROUP BY vec_id) SELECT count(*) AS n, round(avg((a <> b)::INT), 6) AS changed FROM t")
def order_robustness(spark, sf):
    rows = teacher.teacher_rows(_orders(spark, sf), ["vec_id"])
    picks = F.transform("per_order", argmax)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.size(F.array_distinct(picks)) > 1).cast("int")), 6).alias("changed"))


_CYCLES = """a AS (SELECT vec_id, label, k, x FROM za), f AS (SELECT vec_id, first(k ORDER BY x DESC, k) AS pick FROM za GROUP BY vec_id), c1 AS (SELECT vec_id, first(k ORDER BY x DESC, k) AS pick FROM zb GROUP BY vec_id)"""


@query(
    f"""WITH {long(1, 10, 'za')}, {long(11, 10, 'zb')}, {_CYCLES}
SELECT 0 AS cycle, count(*) AS n, round(avg((c1.pick = e.label)::INT), 6) AS accuracy, round(avg((c1.pick = f.pick)::INT), 6) AS agreement_with_final FROM embeddings e JOIN f USING (vec_id) JOIN c1 USING (vec_id)
UNION ALL SELECT 1, count(*), round(avg((f.pick = e.label)::INT), 6), 1.0 FROM embeddings e JOIN f USING (vec_id)"""
)
def cycle_agreement(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.lit("test").alias("split"), F.lit("choice").alias("kind"), F.lit("letter").alias("stage"), dims(1, 10).alias("logits"), F.array(dims(11, 10), dims(1, 10)).alias("cycle_logits"))
    return rounded(by_cycle(rows, []).select("cycle", "n", "accuracy", "agreement_with_final"))


def _exit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", P.softmax(dims(11, 10)).alias("p1"), P.softmax(dims(1, 10)).alias("p2"))
    return rows.select("vec_id", F.round(F.array_max("p1"), 6).alias("conf"), P.correct(F.col("p1"), F.col("label")).alias("hit_first"), P.correct(F.col("p2"), F.col("label")).alias("hit_final"))


_EXIT = f"""{long(11, 10, 'za')}, {soft('za', 'pa')}, {long(1, 10, 'zb')}, {soft('zb', 'pb')},
h1 AS (SELECT vec_id, label, round(max(p), 6) AS conf, (first(k ORDER BY p DESC, k) = label)::INT AS hit_first FROM pa GROUP BY vec_id, label),
h2 AS (SELECT vec_id, (first(k ORDER BY p DESC, k) = label)::INT AS hit_final FROM pb GROUP BY vec_id, label), h AS (SELECT * FROM h1 JOIN h2 USING (vec_id))"""
_CURVE = f"{_EXIT}, g AS (SELECT i / 100.0 AS tau FROM range(0, 101) AS r(i)), c AS (SELECT tau, avg(CASE WHEN conf + 1e-11 >= tau THEN hit_first ELSE hit_final END) AS accuracy, avg((conf + 1e-11 >= tau)::INT) AS exit_share, avg(hit_final) AS final_accuracy FROM h, g GROUP BY tau)"


@query(f"WITH {_EXIT} SELECT vec_id, CASE WHEN conf >= 0.3 THEN hit_first ELSE hit_final END AS hit, conf >= 0.3 AS left_early FROM h")
def early_exit_gate(spark, sf):
    rows = _exit(spark, sf)
    return rows.select("vec_id", analysis.gated(F.col("hit_first"), F.col("hit_final"), F.col("conf"), 0.3).alias("hit"), (F.col("conf") >= 0.3).alias("left_early"))


@query(f"WITH {_CURVE} SELECT round(tau, 2)::DOUBLE AS tau, round(accuracy, 6) AS accuracy, round(exit_share, 6) AS exit_share FROM c")
def gate_curve(spark, sf):
    return rounded(analysis.tau_grid(_exit(spark, sf)).select(F.round("tau", 2).alias("tau"), "accuracy", "exit_share"))


@query(f"WITH {_CURVE} SELECT min(tau)::DOUBLE AS tau FROM c WHERE accuracy >= final_accuracy - 0.01 - 1e-9")
def choose_tau(spark, sf):
    return rounded(analysis.chosen_tau(_exit(spark, sf)))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", P.correct(P.softmax(dims(1, 10)), F.col("label")).alias("a"), P.correct(P.softmax(dims(21, 10)), F.col("label")).alias("b"))


_PAIRS = f"{long(1, 10, 'za')}, {long(21, 10, 'zb')}, ha AS (SELECT vec_id, (first(k ORDER BY x DESC, k) = label)::INT AS a FROM za GROUP BY vec_id, label), hb AS (SELECT vec_id, (first(k ORDER BY x DESC, k) = label)::INT AS b FROM zb GROUP BY vec_id, label), h AS (SELECT * FROM ha JOIN hb USING (vec_id))"


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS diff, round(stddev_samp(a - b) / sqrt(count(*)), 6) AS std_error FROM h")
def paired_diff(spark, sf):
    return rounded(analysis.paired(_pairs(spark, sf), "a", "b"))


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b FROM h")
def mcnemar_counts(spark, sf):
    return analysis.mcnemar(_pairs(spark, sf), "a", "b").select("only_a", "only_b")


@query(
    f"""WITH {_PAIRS}, c AS (SELECT count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b FROM h),
t AS (SELECT *, only_a + only_b AS n, unnest(range(0, least(only_a, only_b) + 1)) AS i FROM c)
SELECT only_a, only_b, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_value FROM t GROUP BY only_a, only_b"""
)
def mcnemar_test(spark, sf):
    return rounded(analysis.mcnemar(_pairs(spark, sf), "a", "b"))


@query(
    f"""WITH {_PAIRS}, d AS MATERIALIZED (SELECT vec_id, a - b AS d FROM h), w AS ({analysis.draws_sql('d', 'vec_id', 'd')}), m AS (SELECT rep, sum(w * d) / sum(w)::DOUBLE AS m FROM w GROUP BY rep)
SELECT round((SELECT avg(d) FROM d), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
)
def bootstrap_ci(spark, sf):
    rows = _pairs(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    return rounded(analysis.bootstrap_mean(rows, "d", "vec_id"))


@query(
    f"""WITH {_NOUL}, w AS ({analysis.draws_sql('s', 'vec_id', 'y, p')}), g AS (SELECT rep, p, sum(w) FILTER (WHERE y = 1) AS pos, sum(w) FILTER (WHERE y = 0) AS neg FROM w GROUP BY rep, p),
t AS (SELECT rep, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, sum(coalesce(neg, 0)) OVER (PARTITION BY rep ORDER BY p) - coalesce(neg, 0) / 2.0 AS below FROM g), u AS (SELECT rep, sum(pos * below) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auroc FROM t GROUP BY rep)
SELECT round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high FROM u"""
)
def bootstrap_auroc(spark, sf):
    rows = noul(spark, sf).select("vec_id", "label", item(F.col("probs"), 1).alias("score"))
    return rounded(analysis.bootstrap_auroc(rows, "score", "label", "vec_id"))


@query(
    f"""WITH {long(1, 10)}, {soft()}, {long(31, 10, 'zt')}, {soft('zt', 'q')}
SELECT p.vec_id, round(CASE WHEN p.vec_id % 2 = 0 THEN -sum(CASE WHEN p.k = p.label THEN p.lp ELSE 0 END) ELSE -sum(q.p * p.lp) END, 6) AS loss FROM p JOIN q ON p.vec_id = q.vec_id AND p.k = q.k GROUP BY p.vec_id"""
)
def soft_ce(spark, sf):
    target = F.when(F.col("vec_id") % 2 == 1, P.softmax(dims(31, 10)))
    loss = P.soft_cross_entropy(doubles(F.col("embedding")), F.lit(10), F.col("label"), target)
    return table(spark, sf, "embeddings").select("vec_id", F.round(loss, 6).alias("loss"))




@query(
    f"""WITH {long(1, 10)}, {soft()}, s AS (SELECT vec_id, label, p.k, p.p FROM p), t AS (SELECT vec_id, label, k, 0.5 * p + CASE WHEN k = label THEN 0.5 ELSE 0 END AS target FROM s) SELECT vec_id, k, round(target, 6) AS target FROM t"""
)
def gold_mix(spark, sf):
    from ..curate import synth

    rows = raw(spark, sf).select(F.col("vec_id").alias("id"), "label")
    probs = raw(spark, sf).select(F.col("vec_id").alias("id"), P.softmax(F.col("logits")).alias("probs"))
    return exploded(synth.gold_mix(rows, probs).withColumnRenamed("id", "vec_id"), F.col("target"), "target")


@query(f"WITH {_TWO_ORDERS}, t AS (SELECT vec_id, first(k ORDER BY p DESC, k)::INT AS label, first(k ORDER BY p1 DESC, k) = first(k ORDER BY p2 DESC, k) AS agree, max(p) AS top FROM c GROUP BY vec_id) SELECT vec_id AS id, label, round(top, 6) AS top FROM t WHERE agree AND vec_id % 3 <> 0")
def soft_rows_merge(spark, sf):
    from ..curate import synth

    found = teacher.teacher_rows(_orders(spark, sf), ["vec_id"]).withColumnRenamed("vec_id", "id")
    rows = raw(spark, sf).where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), "label", F.lit(None).cast("array<double>").alias("target"))
    return synth.soft_rows(rows, found).select("id", "label", F.round(F.array_max("target"), 6).alias("top"))
