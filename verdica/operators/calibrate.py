"""Temperature and Platt scaling: fitted by passes of small sums over the rows, applied as expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.arrays import item

T_LOW, T_HIGH = 0.05, 50.0
RIDGE, MAX_STEPS, HALVINGS, MIN_GAIN = 1e-6, 100, 34, 1e-14


def nll_at(logits: Column, label: Column, t: Column | float) -> Column:
    t = F.lit(float(t)) if isinstance(t, int | float) else t
    return P.logsumexp(F.transform(logits, lambda x: x / t)) - item(logits, label) / t


def grid_losses(df: DataFrame, temperatures: list[float]) -> dict[float, float]:
    """Mean log loss at each temperature, in one pass: one sum a temperature, no copies of rows.

    The grid is one array literal, so passes over other grids run the code compiled for the first.
    """
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    losses = df.select(F.transform(grid, lambda t: nll_at(F.col("logits"), F.col("label"), t)).alias("l"))
    row = losses.agg(*[F.avg(F.get("l", F.lit(i))) for i in range(len(temperatures))]).first()
    return dict(zip(temperatures, row, strict=True))


def fit_temperature(df: DataFrame, points: int = 32, passes: int = 7) -> float:
    """The temperature of least mean log loss, by log. The loss has one minimum there, so each pass keeps the two
    steps around the best point of an even grid: after seven passes the bracket is narrower than one part in ten million."""
    df = df.select("logits", "label").persist()
    try:
        if df.isEmpty():
            raise ValueError("no calibration rows to fit on")
        low, high = math.log(T_LOW), math.log(T_HIGH)
        for _ in range(passes):
            grid = [low + (high - low) * i / (points - 1) for i in range(points)]
            losses = list(grid_losses(df, [math.exp(g) for g in grid]).values())
            best = min(range(points), key=lambda i: (losses[i], i))
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
        return math.exp((low + high) / 2)
    finally:
        df.unpersist()


def fit_platt(df: DataFrame) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b) of least mean log loss plus ridge, for columns ``margin`` and ``label``.

    Damped Newton steps. One pass gives the loss, its gradient and its curvature as means; a second one the losses of the
    step and of its halves down to 2 ** -33, of which the first that doesn't rise is taken.
    """
    df = df.select(F.col("margin").cast("double").alias("x"), F.col("label").cast("double").alias("y")).persist()
    try:
        if df.isEmpty():
            raise ValueError("no calibration rows to fit on")
        x, y = F.col("x"), F.col("y")

        def losses(at: np.ndarray) -> Column:
            z = F.transform(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in at]), lambda p: p["a"] * x + p["b"])
            return F.transform(z, lambda t: F.greatest(t, F.lit(0.0)) - t * y + F.log1p(F.exp(-F.abs(t))))

        def mean_losses(at: np.ndarray) -> np.ndarray:
            rows = df.select(losses(at).alias("l")).agg(*[F.avg(F.get("l", F.lit(i))) for i in range(len(at))]).first()
            return np.array(rows) + RIDGE / 2 * (at**2).sum(axis=1)

        at = np.array([1.0, 0.0])
        now = mean_losses(at[None])[0]
        for _ in range(MAX_STEPS):
            p = P.sigmoid(F.lit(float(at[0])) * x + F.lit(float(at[1])))
            miss, spread = p - y, p * (1 - p)
            g0, g1, h00, h01, h11 = df.agg(*[F.avg(c) for c in (miss * x, miss, spread * x * x, spread * x, spread)]).first()
            step = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + RIDGE * np.eye(2), np.array([g0, g1]) + RIDGE * at)
            tries = at - step / 2.0 ** np.arange(HALVINGS)[:, None]
            found = mean_losses(tries)
            lower = np.flatnonzero(found <= now)
            if not len(lower):
                break
            at, gain, now = tries[lower[0]], now - found[lower[0]], found[lower[0]]
            if gain < MIN_GAIN:
                break
        return float(at[0]), float(at[1])
    finally:
        df.unpersist()


@dataclass
class Calibrator:
    choice_T: float = 1.0
    choice_two_stage_T: float = 1.0
    score_T: float = 1.0
    noul_a: float = 1.0
    noul_b: float = 0.0
    meta: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for t in (self.choice_T, self.choice_two_stage_T, self.score_T):
            if not (math.isfinite(t) and t > 0):
                raise ValueError("temperatures must be finite and above 0")
        if not (math.isfinite(self.noul_a) and math.isfinite(self.noul_b)):
            raise ValueError("Platt parameters must be finite")

    def probs(self, kind: Column, logits: Column, stage: Column) -> Column:
        """Probabilities by question kind; two-stage choices have their own temperature."""
        t = F.when(kind == "score", F.lit(self.score_T)).when(stage == "two_stage", F.lit(self.choice_two_stage_T)).otherwise(F.lit(self.choice_T))
        return F.when(kind == "noul", P.noul_probs(logits, self.noul_a, self.noul_b)).otherwise(P.softmax(logits, t))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, value: str | Mapping[str, Any]) -> Calibrator:
        found = json.loads(value) if isinstance(value, str) else dict(value)
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**found)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as out:
            out.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> Calibrator:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())


def fit_calibrator(rows: DataFrame, run_id: str | None = None, cycle: int | None = None) -> Calibrator:
    """From raw score rows (kind, stage, split, logits, cycle_logits, label): temperature or Platt on the calib split."""
    calib = rows.where("split = 'calib'")
    kinds = [r["kind"] for r in calib.select("kind").distinct().limit(2).collect()]
    if not kinds:
        raise ValueError("no calibration rows to fit on")
    if len(kinds) > 1:
        raise ValueError("rows of one kind only")
    logits = F.col("logits") if cycle is None else F.get("cycle_logits", F.lit(cycle))
    calib = calib.select(logits.alias("logits"), "label", "stage")
    meta: dict[str, Any] = {"run_id": run_id, "n": calib.count(), "split": "calib", "kind": kinds[0]} | ({} if cycle is None else {"cycle": cycle})
    if kinds[0] == "noul":
        a, b = fit_platt(calib.select((item(F.col("logits"), 0) - item(F.col("logits"), 1)).alias("margin"), "label"))
        return Calibrator(noul_a=a, noul_b=b, meta=meta)
    if kinds[0] == "score":
        return Calibrator(score_T=fit_temperature(calib), meta=meta)
    two = F.coalesce(F.col("stage") == "two_stage", F.lit(False))
    parts = {name: calib.where(two if name.endswith("stage_T") else ~two) for name in ("choice_T", "choice_two_stage_T")}
    return Calibrator(meta=meta, **{name: fit_temperature(part) for name, part in parts.items() if not part.isEmpty()})


def pooled_calibrator(rows: DataFrame) -> Calibrator:
    """One calibrator for all kinds found in the calib rows of many runs; missing kinds stay as they are."""
    out: dict[str, float] = {}
    for kind in ("choice", "score", "noul"):
        part = rows.where(F.col("kind") == kind)
        if not part.where("split = 'calib'").isEmpty():
            fitted = fit_calibrator(part)
            names = {"choice": ("choice_T", "choice_two_stage_T"), "score": ("score_T",), "noul": ("noul_a", "noul_b")}[kind]
            out |= {n: getattr(fitted, n) for n in names}
    return Calibrator(**out, meta={"pooled": True})
