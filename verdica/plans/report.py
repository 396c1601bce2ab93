"""Benchmark report: runs' raw scores in, metrics of the test split out, raw and calibrated, by run and by cycle."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..operators import metrics as M
from ..operators.calibrate import Calibrator, fit_calibrator


def scored(rows: DataFrame, cal: Calibrator | None = None) -> DataFrame:
    """Adds probs."""
    return rows.withColumn("probs", (cal or Calibrator()).probs(F.col("kind"), F.col("logits"), F.coalesce("stage", F.lit("letter"))))


def run_measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """All measures of test rows with probs, for each group: one aggregation, one for calibration error, one for AUROC."""
    test = rows.where("split = 'test'")
    m = M.measures(F.col("probs"), F.col("label"))
    score = {k: F.avg(F.when(F.col("kind") == "score", v)) for k, v in {"mae": F.abs(F.aggregate(F.transform("probs", lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x) - F.col("label")), "exact": (argmax(F.col("probs")) == F.col("label")).cast("int")}.items()}
    latency = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
    base = test.groupBy(*by).agg(
        *[c.alias(k) for k, c in (m | score).items()], latency.alias("_l"), F.avg("latency_ms").alias("latency_mean"), F.avg("prompt_tokens").alias("prompt_tokens_mean"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("stage") == "two_stage").alias("two_stage")
    )
    base = base.withColumns({"latency_p50": F.get("_l", F.lit(0)), "latency_p95": F.get("_l", F.lit(1))}).drop("_l")
    noul = M.auroc(test.where("kind = 'noul'").withColumn("score", F.get("probs", F.lit(1))), by=by)
    return base.join(M.ece(test, by), by).join(noul, by, "left")


def n_cycles(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cycles of each run if all its rows have as many, else 0."""
    n = F.coalesce(F.size("cycle_logits"), F.lit(0))
    return rows.groupBy(*by).agg(F.when(F.min(n) == F.max(n), F.greatest(F.max(n), F.lit(0))).otherwise(F.lit(0)).alias("n_cycles"))


def by_cycle(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, log loss and agreement with the final pick after each cycle."""
    each = rows.where("split = 'test'").select("*", F.posexplode("cycle_logits").alias("cycle", "_z"))
    probs = Calibrator().probs(F.col("kind"), F.col("_z"), F.coalesce("stage", F.lit("letter")))
    each = each.withColumn("probs", probs)
    m = M.measures(F.col("probs"), F.col("label"))
    return each.groupBy(*by, "cycle").agg(*[c.alias(k) for k, c in m.items()], F.avg((argmax(F.col("_z")) == argmax(F.col("logits"))).cast("int")).alias("agreement_with_final"))


def calibrated(rows: DataFrame, cals: dict[str, Calibrator]) -> DataFrame:
    """Adds probs, each run's by its own calibrator; runs without one by none."""
    stage = F.coalesce("stage", F.lit("letter"))
    probs = Calibrator().probs(F.col("kind"), F.col("logits"), stage)
    for run_id, cal in cals.items():
        probs = F.when(F.col("run_id") == run_id, cal.probs(F.col("kind"), F.col("logits"), stage)).otherwise(probs)
    return rows.withColumn("probs", probs)


def evaluated(rows: DataFrame) -> tuple[list[dict[str, Any]], list[str]]:
    """Reports of all runs, by run, and the runs left out with reasons. Results are small.

    Runs are groups of the same aggregations, so jobs don't grow with them; only the calibrators are fitted one by one.
    """
    parts = {r["run_id"]: (r["test"], r["calib"]) for r in rows.groupBy("run_id").agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "calib").alias("calib")).collect()}
    runs = sorted(r for r, (test, _) in parts.items() if test)
    skipped = [f"{r}: {r}: no test rows yet" for r in sorted(parts.keys() - set(runs))]
    if not runs:
        return [], skipped
    rows = rows.where(F.col("run_id").isin(runs))
    test = rows.where("split = 'test'")
    cals = {r: fit_calibrator(rows.where(F.col("run_id") == r), r) for r in runs if parts[r][1]}
    of = lambda frame: {r["run_id"]: r.asDict() for r in frame.collect()}
    raw = of(run_measures(scored(rows), ["run_id"]))
    cal = of(run_measures(calibrated(rows, cals), ["run_id"])) if cals else {}
    bins, cycles = {r: [] for r in runs}, {r: [] for r in runs}
    for r in M.reliability(calibrated(test, cals), ["run_id"]).orderBy("run_id", "bin").collect():
        bins[r["run_id"]].append({k: v for k, v in r.asDict().items() if k != "run_id"})
    if with_cycles := [r["run_id"] for r in n_cycles(test, ["run_id"]).where("n_cycles > 0").collect()]:
        for r in by_cycle(rows.where(F.col("run_id").isin(with_cycles)), ["run_id"]).orderBy("run_id", "cycle").collect():
            cycles[r["run_id"]].append(r.asDict())
    out = []
    for r in runs:
        fitted = cals.get(r)
        out.append({"run_id": r, "raw": raw[r], "calibrated": cal[r] if fitted else None, "calibrator": json.loads(fitted.to_json()) if fitted else None, "reliability": bins[r]} | ({"cycles": cycles[r]} if cycles[r] else {}))
    return out, skipped


def evaluate(rows: DataFrame, run_id: str) -> dict[str, Any]:
    """One run: raw and calibrated measures, calibrator, reliability and cycles."""
    reports, _ = evaluated(rows.where(F.col("run_id") == run_id))
    if not reports:
        raise ValueError(f"{run_id}: no test rows yet")
    return reports[0]


def markdown(reports: list[dict[str, Any]]) -> str:
    """A comparison table of runs, raw and calibrated."""
    show = lambda x: "-" if x is None else f"{x:.3f}"
    head = "| run | n | accuracy | ECE raw / cal | NLL raw / cal | Brier | AUROC | MAE | p50 / p95 ms |\n|-|-|-|-|-|-|-|-|-|\n"
    lines = []
    for r in reports:
        raw, cal = r["raw"], r["calibrated"] or {}
        lines.append(f"| {r['run_id']} | {raw['n']} | {show(raw['accuracy'])} | {show(raw['ece'])} / {show(cal.get('ece'))} | {show(raw['nll'])} / {show(cal.get('nll'))} | {show(raw['brier'])} | {show(raw['auroc'])} | {show(raw['mae'])} | {raw['latency_p50']:.0f} / {raw['latency_p95']:.0f} |")
    return head + "\n".join(lines) + "\n"


def write_report(rows: DataFrame, out: str) -> list[str]:
    """Summaries of all runs as JSON lines and one table; returns the runs left out, with reasons."""
    reports, skipped = evaluated(rows)
    spark = rows.sparkSession
    text = [json.dumps(r, default=str) for r in reports]
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    table = markdown(reports) + "".join(f"\nskipped {s}" for s in skipped)
    spark.createDataFrame([(table,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return skipped
