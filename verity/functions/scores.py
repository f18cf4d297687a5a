"""Scalar functions over confidences, log-probabilities and votes, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = float(np.finfo(np.float64).eps)


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def require(condition: Column, message: str, value: Column) -> Column:
    """``value`` where ``condition`` holds; the query fails where it does not (null counts as not)."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def rescale(score: Column | str, low: float, high: float) -> Column:
    s = _c(score)
    return require((s >= low) & (s <= high), "score out of range", (s - low) / (high - low))


def is_probability(x: Column | str) -> Column:
    """In [0, 1] or NaN."""
    return F.isnan(_c(x)) | _c(x).between(0.0, 1.0)


def temperature_scale(confidence: Column | str, temperature: float) -> Column:
    """sigmoid(logit(c) / T); 0 and 1 stay."""
    if temperature <= 0:
        raise ValueError("the temperature is positive")
    c = _c(confidence)
    return F.when((c <= 0) | (c >= 1), c).otherwise(1 / (1 + F.exp(-F.log(c / (1 - c)) / temperature)))


def claim_dropout(confidence: Column | str, dropout: Column | float) -> Column:
    d = _c(dropout)
    return d + (1 - d) * _c(confidence)


def product(values: Column) -> Column:
    """Product of a group in log space; a zero makes it zero."""
    positive = F.sum(F.log(F.when(values > 0, values)))
    return F.when(F.min(values) <= 0, 0.0).otherwise(F.exp(positive))


def geometric_mean(values: Column) -> Column:
    return F.when(F.min(values) <= 0, 0.0).otherwise(F.exp(F.avg(F.log(F.when(values > 0, values)))))


def bin_index(confidence: Column | str, bins: int) -> Column:
    """The equal-width bin, by the float edges of ``linspace``; the last bin holds 1; null outside."""
    if bins < 1:
        raise ValueError("bins is 1 or more")
    c = _c(confidence)
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    below = sum(((c >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when((c >= edges[0]) & (c <= edges[-1]), below)


def log_sum_exp(values: str) -> Column:
    """Of an array column, shifted by its greatest element."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def log_mean_exp(values: str) -> Column:
    return F.exp(log_sum_exp(values)) / F.size(values)


def true_share(tokens: str, log_probs: str) -> Column:
    """Softmax mass of ``true`` against ``false`` among a step's top tokens (stripped, any case)."""
    pairs = F.arrays_zip(F.col(tokens).alias("t"), F.col(log_probs).alias("p"))
    top = F.array_max(log_probs)

    def mass(label: str) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.when(F.lower(F.trim(x[tokens])) == label, F.exp(x[log_probs] - top)).otherwise(0.0))

    yes, no = mass("true"), mass("false")
    distinct = F.size(F.array_distinct(tokens)) == F.size(tokens)
    return require(distinct & (yes > 0) & (no > 0), "both labels are needed, each token once", yes / (yes + no))


def vote(answers: str, samples: int, most_malformed: int = 2) -> Column:
    """Share of ``true`` among the sampled answers; up to ``most_malformed`` that are neither are left out."""
    yes = F.size(F.filter(answers, lambda x: F.coalesce(F.lower(F.trim(x)) == "true", F.lit(False))))
    no = F.size(F.filter(answers, lambda x: F.coalesce(F.lower(F.trim(x)) == "false", F.lit(False))))
    good = (F.size(answers) == samples) & (samples - yes - no <= most_malformed)
    return require(good, "too many malformed answers, or not as many as asked for", yes / (yes + no))


def values_equal(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Null-safe equality of numbers within 1e-12 relative or ``tolerance`` absolute; NaN equals NaN."""
    both = a.isNotNull() & b.isNotNull()
    near = F.abs(a - b) <= F.greatest(F.lit(1e-12) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
    return F.when(both, F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(near)).otherwise(a.isNull() & b.isNull())


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double"))


def usage_or_unset(total: Column | str) -> Column:
    """Token counts and costs that were never counted are -1."""
    t = _c(total)
    return F.when(t > 0, t).otherwise(F.lit(-1).cast("double"))
