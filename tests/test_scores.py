"""Golden values of probabilities, metrics, calibration, two-stage scoring, teachers and analysis."""

from __future__ import annotations

import hashlib
import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from verdica.functions import probs as P
from verdica.operators import analysis, calibrate, metrics, sampling, scoring, teacher
from verdica.plans import report


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def table(spark, probs, labels):
    return spark.createDataFrame(list(zip(probs, labels, strict=True)), "probs array<double>, label int")


def test_metrics_golden(spark):
    r = metrics.summarize(table(spark, [[0.8, 0.2], [0.6, 0.4], [0.3, 0.7], [0.9, 0.1]], [0, 1, 1, 0])).first()
    assert r["accuracy"] == 0.75 and r["brier"] == pytest.approx(0.25) and r["ece"] == pytest.approx(0.3)
    assert r["nll"] == pytest.approx(-sum(map(math.log, (0.8, 0.4, 0.7, 0.9))) / 4)
    assert metrics.ece(table(spark, [[0.75, 0.25]] * 4, [0, 0, 0, 1])).first()["ece"] == pytest.approx(0)
    ragged = metrics.summarize(table(spark, [[0.7, 0.3], [0.2, 0.5, 0.3]], [0, 1])).first()
    assert ragged["accuracy"] == 1 and ragged["n"] == 2


@pytest.mark.parametrize(("scores", "labels", "want"), [([0.1, 0.5, 0.5, 0.9], [0, 0, 1, 1], 0.875), ([0.5] * 4, [0, 1, 0, 1], 0.5), ([0.1, 0.2], [1, 1], None), ([1, 2, 3], [0, 0, 1], 1.0)])
def test_auroc(spark, scores, labels, want):
    df = spark.createDataFrame(list(zip(map(float, scores), labels, strict=True)), "score double, label int")
    assert metrics.auroc(df).first()["auroc"] == want


def test_auroc_matches_pairs(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 2), rng.randint(0, 1), rng.randint(0, 2)) for _ in range(400)]
    df = spark.createDataFrame([(s, y, float(w)) for s, y, w in rows], "score double, label int, w double")
    pairs = lambda weight: sum(weight(a) * weight(b) * ((a[0] > b[0]) + (a[0] == b[0]) / 2) for a in rows for b in rows if a[1] and not b[1])
    total = lambda weight: sum(weight(a) for a in rows if a[1]) * sum(weight(b) for b in rows if not b[1])
    assert metrics.auroc(df).first()["auroc"] == pytest.approx(pairs(lambda r: 1) / total(lambda r: 1))
    assert metrics.auroc(df, weight=F.col("w")).first()["auroc"] == pytest.approx(pairs(lambda r: r[2]) / total(lambda r: r[2]))


@pytest.mark.parametrize(("probs", "labels"), [([[float("nan"), 1.0]], [0]), ([[1.2, -0.2]], [0]), ([[0.5, 0.5]], [2]), ([], []), ([None], [0])])
def test_metrics_reject(spark, probs, labels):
    with pytest.raises(ValueError):
        metrics.checked(table(spark, probs, labels))


def test_reliability_lists_all_bins(spark):
    rows = metrics.reliability(table(spark, [[1.0, 0.0], [0.55, 0.45]], [0, 1])).orderBy("bin").collect()
    assert len(rows) == 15 and rows[14]["n"] == 1 and rows[8]["n"] == 1 and rows[0]["accuracy"] is None


def test_probabilities(spark):
    p = one(spark, P.softmax(arr(1000, 1001, 1002)))
    assert sum(p) == pytest.approx(1) and p[2] / p[1] == pytest.approx(math.e)
    assert one(spark, P.confidence(arr(0.25, 0.25, 0.25, 0.25))) == 0 and one(spark, P.confidence(arr(1, 0))) == 1
    assert one(spark, P.choice_answer(F.array(F.lit("a"), F.lit("b")), arr(0.5, 0.5)))["choice"] == "a"
    assert one(spark, P.score_answer(F.array(F.lit("x"), F.lit("y"), F.lit("z")), arr(0.2, 0.3, 0.5)))["score"] == pytest.approx(1.3)
    assert one(spark, P.noul_probs(arr(0.7, 0.0)))[1] == pytest.approx(1 / (1 + math.exp(-0.7)))
    assert one(spark, P.nll(arr(1, 0), F.lit(1))) == pytest.approx(-math.log(1e-12))
    assert not one(spark, P.valid(arr(0.5, 0.6))) and one(spark, P.valid(arr(0.5, 0.5), F.lit(2)))


def test_temperature_recovers(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        z = [rng.gauss(0, 1.5) for _ in range(4)]
        e = [math.exp(x) for x in z]
        rows.append(([3 * x for x in z], rng.choices(range(4), e)[0]))
    df = spark.createDataFrame(rows, "logits array<double>, label int").cache()
    t = calibrate.fit_temperature(df)
    assert t == pytest.approx(3, rel=0.15)
    losses = calibrate.grid_losses(df, [t * 0.98, t, t * 1.02])
    assert losses[t] == min(losses.values())


def test_platt_recovers(spark):
    rng = random.Random(4)
    rows = [(x := rng.gauss(0, 3), int(rng.random() < 1 / (1 + math.exp(1 - 0.5 * x)))) for _ in range(5000)]
    a, b = calibrate.fit_platt(spark.createDataFrame(rows, "margin double, label int"))
    assert a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(-1, abs=0.15)


def test_calibrator_files(tmp_path):
    cal = calibrate.Calibrator(choice_T=2.0, noul_b=-1.0)
    cal.save(f"{tmp_path}/c.json")
    assert calibrate.Calibrator.load(f"{tmp_path}/c.json") == cal
    with pytest.raises(ValueError):
        calibrate.Calibrator.from_json('{"other": 1}')
    with pytest.raises(ValueError):
        calibrate.Calibrator(score_T=0.0)


def raw_rows(spark, n=60, stage="letter", kind="choice"):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        z = [rng.gauss(0, 2) for _ in range(2 if kind == "noul" else 4)]
        y = max(range(len(z)), key=lambda k: z[k]) if rng.random() < 0.7 else 0
        rows.append((f"r{i}", "run", "calib" if i % 2 else "test", y if kind != "noul" else 1 - y, kind, z, [z[::-1], z], 10, False, stage if i % 3 else "letter", float(i)))
    return spark.createDataFrame(rows, "id string, run_id string, split string, label int, kind string, logits array<double>, cycle_logits array<array<double>>, prompt_tokens int, truncated boolean, stage string, latency_ms double")


@pytest.mark.parametrize("kind", ["choice", "noul", "score"])
def test_report(spark, tmp_path, kind):
    rows = raw_rows(spark, kind=kind, stage="two_stage" if kind == "choice" else "letter")
    r = report.evaluate(rows, "run")
    assert r["raw"]["n"] == 30 and (r["raw"]["auroc"] is not None) == (kind == "noul") and (r["raw"]["mae"] is not None) == (kind == "score")
    assert r["cycles"][1]["agreement_with_final"] == 1 and r["calibrated"]["nll"] is not None
    assert "| run | 30 |" in report.markdown([r])
    assert report.write_report(rows, f"{tmp_path}/out") == []
    assert report.write_report(rows.where("split = 'calib'"), f"{tmp_path}/out") == ["run: run: no test rows yet"]
    pooled = calibrate.pooled_calibrator(rows)
    assert (pooled.choice_two_stage_T != 1) == (kind == "choice")


def test_two_stage_golden(spark):
    margins = [1.0, 0, 3, 0, 0, 2, 0, 0]
    lp = one(spark, P.log_softmax(arr(*margins)))
    kept = one(spark, P.shortlist(arr(*lp), 3))
    assert kept == [0, 2, 5]
    z = one(spark, P.merge_shortlist(arr(*lp), F.array(*[F.lit(k) for k in kept]), P.log_softmax(arr(1, 3, 2))))
    p = [math.exp(x) for x in z]
    assert sum(p) == pytest.approx(1) and max(range(8), key=lambda k: p[k]) == 2
    assert p[1] == pytest.approx(math.exp(lp[1])) and p[2] / p[0] == pytest.approx(math.exp(2))
    assert one(spark, P.shortlist(arr(*[0.0] * 8), 4)) == [0, 1, 2, 3]


def questions(spark, n_options, state="delta alpha", rows=2):
    options = [{"name": w, "descr": None} for w in ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"][:n_options]]
    data = [(str(i), 0, "q", "m", state, "choice", "Which?", options, None, None) for i in range(rows)]
    return spark.createDataFrame(data, "request_id string, ord int, qid string, model string, state string, type string, instructions string, options array<struct<name:string,descr:string>>, true_text string, false_text string")


def test_score_narrow_and_wide(spark):
    narrow = scoring.score(questions(spark, 4), scoring.lexical_backend).collect()
    assert {r["stage"] for r in narrow} == {"letter"} and narrow[0]["logits"] == [1.0, 0.0, 0.0, 1.0]
    wide = scoring.score(questions(spark, 8, "delta delta alpha"), scoring.lexical_backend, shortlist=10, letters=4).collect()
    assert {r["stage"] for r in wide} == {"two_stage"} and len(wide) == 2
    p = [math.exp(x) for x in wide[0]["logits"]]
    assert sum(p) == pytest.approx(1) and max(range(8), key=lambda k: p[k]) == 3 and len(wide[0]["stage1_logits"]) == 8


def test_backend_is_checked(spark):
    short = lambda t: t.withColumns({"logits": F.array(F.lit(1.0)), "prompt_tokens": F.lit(1), "truncated": F.lit(False)})
    with pytest.raises(Exception, match="don't fit"):
        scoring.score(questions(spark, 4), short).collect()


def test_precomputed_backend(spark):
    logits = spark.createDataFrame([("0", 0, -1, [1.0, 2.0, 3.0, 4.0])], "request_id string, ord int, place int, logits array<double>")
    got = scoring.score(questions(spark, 4, rows=1), scoring.precomputed_backend(logits, ["request_id", "ord", "place"])).first()
    assert got["logits"] == [1.0, 2.0, 3.0, 4.0]


def test_teacher_orders(spark):
    perm = one(spark, teacher.shuffled_order(F.lit(5), "s", F.lit("k")))
    assert sorted(perm) == list(range(5)) and perm != list(range(5))
    assert all(one(spark, teacher.shuffled_order(F.lit(2), "s", F.lit(str(i)))) == [1, 0] for i in range(6))
    assert one(spark, teacher.to_given_order(arr(0.1, 0.2, 0.7), F.array(F.lit(2), F.lit(0), F.lit(1)))) == [0.2, 0.7, 0.1]
    rows = [("a", 0, [0, 1, 2], [3.0, 0.0, 0.0]), ("a", 1, [1, 2, 0], [3.0, 0.0, 0.0]), ("b", 0, [0, 1, 2], [3.0, 0.0, 0.0]), ("b", 1, [1, 2, 0], [0.0, 0.0, 3.0])]
    got = {r["id"]: r for r in teacher.teacher_rows(spark.createDataFrame(rows, "id string, order int, perm array<int>, logits array<double>"), ["id"]).collect()}
    assert not got["a"]["agree"] and got["b"]["agree"] and got["b"]["label"] == 0
    assert one(spark, teacher.majority(F.array(F.lit(2), F.lit(1), F.lit(1)))) == 1
    with pytest.raises(Exception, match="permutation"):
        one(spark, teacher.reordered(arr(1, 2), F.array(F.lit(0), F.lit(0))))


def test_significance(spark):
    pairs = [(0, 0), (5, 0), (3, 3), (7, 30), (400, 310), (900, 1100)]
    chances = spark.createDataFrame(pairs, "x long, y long").select("x", "y", analysis.exact_binomial(F.col("x"), F.col("y")).alias("p")).collect()
    for x, y, p in chances:
        assert p == pytest.approx(min(1, 2 * sum(math.comb(x + y, i) for i in range(min(x, y) + 1)) / 2 ** (x + y))), (x, y)
    rows = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(120)], "id int, a int, b int")
    m = analysis.mcnemar(rows, "a", "b").first()
    assert (m["only_a"], m["only_b"]) == (30, 20) and 0 < m["p_value"] < 1
    ci = analysis.bootstrap_mean(rows.withColumn("d", F.col("a") - F.col("b")), "d", "id", 400).first()
    assert ci["low"] < ci["mean"] < ci["high"] and ci["mean"] == pytest.approx(1 / 12)


def test_resamples(spark):
    rng = np.random.default_rng(3)
    digests = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = analysis.poisson_weights(digests, 0, 2000)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.01) and (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.005)
    assert (analysis.poisson_weights(digests[5:9], 500, 300) == w[5:9, 500:800]).all()
    # ten scores over twelve slices, so ties go on in the next slice; a third of all rows has one score
    data = [(i, 4 if i % 3 == 0 else i * 7 % 10, int(i * 31 % 17 < 5 + i * 7 % 10)) for i in range(300)]
    rows = spark.createDataFrame([(i, s / 10, y) for i, s, y in data], "id int, score double, label int")
    for reps in (40, 1001):
        got = analysis.bootstrap_auroc(rows, "score", "label", "id", reps).first()
        drawn = np.array([int(hashlib.sha256(f"0:{i}".encode()).hexdigest()[:15], 16) for i, _, _ in data], np.uint64)
        w = analysis.poisson_weights(drawn, 0, reps + reps % 2)[:, :reps].T.astype(float)
        s, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
        wins = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
        wp, wn = w[:, y == 1], w[:, y == 0]
        want = np.percentile(np.einsum("bi,ij,bj->b", wp, wins, wn) / (wp.sum(1) * wn.sum(1)), [2.5, 97.5])
        assert [got["low"], got["high"]] == pytest.approx(list(want), abs=1e-12)
    # the ends no longer hang on the draws: within a tenth of a standard error of those of other seeds
    for ends in ([analysis.bootstrap_auroc(rows, "score", "label", "id", seed=k).first() for k in range(4)], [analysis.bootstrap_mean(rows, "score", "id", seed=k).first() for k in range(4)]):
        error = (ends[0]["high"] - ends[0]["low"]) / 3.92
        assert all(max(e[c] for e in ends) - min(e[c] for e in ends) < 0.15 * error for c in ("low", "high"))


@pytest.mark.parametrize("name", ["bootstrap_ci", "bootstrap_auroc"])
def test_registered_resamples(spark, monkeypatch, name):
    asked = []
    for f in (analysis.bootstrap_mean, analysis.bootstrap_auroc):
        def seen(*args, _f=f, **named):
            call = inspect.signature(_f).bind(*args, **named)
            call.apply_defaults()
            asked.append(call.arguments["reps"])
            return _f(*args, **named)

        monkeypatch.setattr(analysis, f.__name__, seen)
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == [10_000]


def test_auroc_with_an_outlier(spark):
    """One score far from all others leaves the ranges as full as before, and the area exact."""
    rng = np.random.default_rng(6)
    s, y = rng.standard_normal(3000).round(2), rng.integers(0, 2, 3000)
    s[7] = 1e300
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")
    wins = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    assert metrics.auroc(rows).first()["auroc"] == pytest.approx(wins.mean(), abs=1e-12)
    sums = rows.groupBy(F.col("score").alias("_s")).agg(F.count(F.lit(1)).alias("_all"))
    ranges = sampling.ranged(sums, "_s", 16).groupBy("_range").count().collect()
    assert max(r["count"] for r in ranges) < 3 * sums.count() / 16


def test_early_exit(spark):
    rows = spark.createDataFrame([(0.2, 0, 1), (0.5, 1, 1), (0.9, 1, 1), (0.95, 1, 0)], "conf double, hit_first int, hit_final int")
    grid = {round(r["tau"], 2): r for r in analysis.tau_grid(rows).collect()}
    assert grid[0.0]["accuracy"] == 0.75 and grid[0.3]["accuracy"] == 1.0 and grid[1.0]["accuracy"] == 0.75 and grid[0.9]["exit_share"] == 0.5
    assert analysis.chosen_tau(rows).first()["tau"] == 0


def test_stop_rules(spark):
    log = spark.createDataFrame([(i, 1.0 if i < 100 else 2.0) for i in range(1, 200)] + [(200, float("nan")), (201, float("inf"))], "step int, loss double")
    out = {r["step"]: r for r in analysis.stop_rules(log).collect()}
    assert not out[149]["above_first"] and out[150]["above_first"] and out[201]["bad_pair"] and not out[200]["bad_pair"]
    # blocks that overlap give what one window would, each run by itself too
    rng = np.random.default_rng(2)
    many = [(r, k * 3, float(x) if k % 17 else float("nan")) for r in range(2) for k, x in enumerate(rng.standard_normal(700).cumsum())]
    frame = spark.createDataFrame(many, "run int, step int, loss double").repartition(3)
    whole, cut = ({(r["run"], r["step"]): (r["trailing"], r["above_first"], r["bad_pair"]) for r in analysis.stop_rules(frame, by=["run"], block=b).collect()} for b in (10_000, 90))
    assert whole.keys() == cut.keys() and all(a[1:] == b[1:] and a[0] == pytest.approx(b[0], abs=1e-9) for a, b in ((whole[k], cut[k]) for k in whole))
    assert {(r["run"], r["step"]): r["stop"] for r in analysis.rises(frame, "step", "loss", ["run"], block=60).collect()} == {(r["run"], r["step"]): r["stop"] for r in analysis.rises(frame, "step", "loss", ["run"]).collect()}
    up = spark.createDataFrame([(1, 1.0), (2, 1.1), (3, 1.2), (4, 1.2)], "step int, v double")
    assert [r["stop"] for r in analysis.rises(up, "step", "v").orderBy("step").collect()] == [False, False, True, False]
