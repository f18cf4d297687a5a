"""Temperature calibration fitted and applied as distributed aggregates."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.functions.scores import temperature_scale

#: Trial points of a search round; all are evaluated in one aggregation.
POINTS = 16


@dataclass(frozen=True)
class Calibration:
    """None, a fixed temperature, or one learned from a run: exactly one way."""

    mode: str = "none"
    temperature: float | None = None
    source_run: str | None = None
    objective: str = "nll"

    def __post_init__(self) -> None:
        if self.mode not in ("none", "temperature") or self.objective not in ("nll", "brier"):
            raise ValueError("unknown mode or objective")
        if (self.mode == "temperature") != ((self.temperature is None) != (self.source_run is None)):
            raise ValueError("a temperature mode takes a temperature or a source run, the mode none neither")
        if self.temperature is not None and self.temperature <= 0:
            raise ValueError("the temperature is positive")

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Calibration:
        return Calibration(**json.loads(text))


def training_rows(df: DataFrame, confidence: str = "estimated_confidence", label: str = "resolved") -> DataFrame:
    """(z, y): logits and outcomes of rows with 0 < c < 1. Needs both classes, no wrong certainty, and
    at least one row that is left."""
    c, y = F.col(confidence).cast("double"), F.col(label).cast("int")
    got = df.agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"), F.count_if(((c <= 0) & (y == 1)) | ((c >= 1) & (y == 0))).alias("wrong"), F.count_if((c > 0) & (c < 1)).alias("left")).first()
    if not got["p"] or not got["n"]:
        raise ValueError("both outcomes are needed")
    if got["wrong"]:
        raise ValueError("a certain confidence is wrong: no temperature mends it")
    if not got["left"]:
        raise ValueError("no confidence strictly between 0 and 1")
    return df.where((c > 0) & (c < 1)).select(F.log(c / (1 - c)).alias("z"), y.cast("double").alias("y"))


def _search(evaluate: Callable[[list[float]], list[float]], low: float, high: float, rounds: int) -> float:
    """The zero of an increasing function between ``low`` (below) and ``high`` (not below)."""
    for _ in range(rounds):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        values = evaluate(points)
        below = [p for p, v in zip(points, values, strict=True) if v < 0]
        above = [p for p, v in zip(points, values, strict=True) if v >= 0]
        low, high = (below[-1] if below else low), (above[0] if above else high)
        if high - low <= 1e-13 * max(1.0, high):
            break
    return (low + high) / 2


def _evaluator(hist: DataFrame, slope: Callable[[float], Column]) -> Callable[[list[float]], list[float]]:
    def evaluate(points: list[float]) -> list[float]:
        return list(hist.agg(*[F.sum(F.col("m") * slope(b)).alias(f"g{i}") for i, b in enumerate(points)]).first())

    return evaluate


def fit_temperature(df: DataFrame, objective: str = "nll", confidence: str = "estimated_confidence", label: str = "resolved", rounds: int = 16) -> float:
    """The temperature of least log loss or Brier score, by search over 1/T.

    Rows are counted by different (confidence, outcome) once; a round evaluates the slope at all its
    trial points in one aggregation. Log loss is convex; the Brier score is not, and its minimum next
    to T = 1 on the descending side is taken. Errors: a slope that is not negative at 1/T = 0
    (endless temperature) and, for log loss, signs that all agree (temperature zero).
    """
    hist = training_rows(df, confidence, label).groupBy("z", "y").agg(F.count(F.lit(1)).alias("m")).cache()
    try:
        z, y = F.col("z"), F.col("y")
        sig = lambda b: 1 / (1 + F.exp(-F.lit(b) * z))
        if objective == "nll":
            slope = lambda b: z * (sig(b) - y)
        else:
            slope = lambda b: 2 * (sig(b) - y) * sig(b) * (1 - sig(b)) * z
        evaluate = _evaluator(hist, slope)
        (at_zero,) = evaluate([0.0])
        if at_zero >= 0:
            raise ValueError("confidence does not tell the outcomes: the temperature is endless")
        if objective == "nll":
            if hist.agg(F.min(F.when(y == 1, z).otherwise(-z))).first()[0] >= 0:
                raise ValueError("every confidence has the right sign: the temperature is zero")
            low, high = 0.0, 1.0
            while evaluate([high])[0] < 0:
                low, high = high, high * 2
                if high > 1e9:
                    raise ValueError("the temperature is zero")
        else:
            (here,) = evaluate([1.0])
            low, high = 1.0, 1.0
            if here < 0:
                while evaluate([high])[0] < 0:
                    low, high = high, high * 1.25
                    if high > 1e9:
                        raise ValueError("the temperature is zero")
            else:
                while evaluate([low])[0] >= 0:
                    low, high = low / 1.25, low
                    if low < 1e-9:
                        raise ValueError("the temperature is endless")
        return 1 / _search(evaluate, low, high, rounds)
    finally:
        hist.unpersist()


def resolve(config: Calibration, runs: DataFrame, run: str = "run") -> float | None:
    """The temperature of a configuration: none, fixed, or learned from its source run."""
    if config.mode == "none":
        return None
    if config.temperature is not None:
        return config.temperature
    source = runs.where(F.col(run) == config.source_run)
    return fit_temperature(source, config.objective)


def calibrate(df: DataFrame, temperature: float | None, confidence: str = "estimated_confidence", raw: str = "raw_confidence") -> DataFrame:
    """Scaled confidences with the raw ones kept: rows that were scaled before start from their raw one."""
    base = F.coalesce(F.col(raw), F.col(confidence)) if raw in df.columns else F.col(confidence)
    kept = df.withColumn(raw, base)
    if temperature is None or math.isclose(temperature, 1.0, rel_tol=0, abs_tol=0):
        return kept.withColumn(confidence, F.col(raw))
    return kept.withColumn(confidence, temperature_scale(raw, temperature))
