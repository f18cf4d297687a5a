"""Sweeps, breakdowns, shared subsets, usage and summary tables over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.operators.metrics import calibration_sweep, run_metrics
from verity.plans.tables import running

KEY = ("instance_id", "model")

# US dollars per million tokens (input, output), by model name, where a run has no cost.
PRICES = {
    "Qwen/Qwen3.6-27B": (0.289, 2.40),
    "openai/qwen36-27b": (0.289, 2.40),
    "openai/qwen38-27b": (0.289, 2.40),
    "Qwen/Qwen3.8-27B-FP8": (0.32, 2.50),
    "openai/Qwen/Qwen3.8-27B-FP8": (0.32, 2.50),
}


def normalized_difficulty(column: str = "difficulty") -> Column:
    """The two longest classes are one; null stays a class of its own."""
    d = F.col(column)
    return F.when(d.isin("1-4 hours", ">4 hours"), "> 1 hour").otherwise(d)


def difficulty_is(value: str | None, column: str = "difficulty") -> Column:
    return normalized_difficulty(column).eqNullSafe(F.lit(value))


def min_n(df: DataFrame, n: int, run: str = "run") -> DataFrame:
    """Rows of runs with ``n`` rows or more, counted before any other filter."""
    if n < 1:
        raise ValueError("n is 1 or more")
    big = df.groupBy(run).count().where(F.col("count") >= n).select(run)
    return df.join(big, run, "left_semi")


def shared_subset(df: DataFrame, run: str = "run", key: Sequence[str] = KEY) -> DataFrame:
    """Rows whose key is in every run that has rows."""
    counted = df.select(run, *key).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("_in"))
    runs = df.agg(F.countDistinct(run).alias("_runs"))
    everywhere = counted.crossJoin(runs).where("_in = _runs").select(*key)  # runs: one row
    return df.join(everywhere, list(key), "left_semi")


def split_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, sorted, null last."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def ece_sweep(df: DataFrame, bins: Sequence[int] = (5, 10, 15, 20), keys: Sequence[str] = ("run",), order: str = "ord") -> DataFrame:
    """Both calibration errors for each number of bins: one row per key, two columns per number."""
    if not bins or len(set(bins)) != len(bins) or min(bins) < 1:
        raise ValueError("bins are different positive numbers")
    return calibration_sweep(df, keys, bins, order=order)


def breakdown(df: DataFrame, by: str, keys: Sequence[str] = ("run",), order: str = "ord") -> DataFrame:
    """The metric bundle by key and by a benchmark, model or (normalised) difficulty."""
    if by == "difficulty":
        df = df.withColumn("difficulty", normalized_difficulty())
    return run_metrics(df, [*keys, by], order=order)


def mean_usage(df: DataFrame, keys: Sequence[str] = ("run",), columns: Sequence[str] = ("total_tokens", "generated_tokens")) -> DataFrame:
    """Means without the -1 of rows that were not counted; null where no row was."""
    return df.groupBy(*keys).agg(*[F.avg(F.expr(f"nullif({c}, -1)")).alias(f"mean_{c}") for c in columns])


def with_cost(usage: DataFrame, model: str, prices: dict[str, tuple[float, float]] | None = None, cost: str = "mean_cost") -> DataFrame:
    """Cost by token prices where a mean cost is missing or zero and the model has a price."""
    price = usage.sparkSession.createDataFrame([(m, *p) for m, p in (PRICES if prices is None else prices).items()], "_m string, _in double, _out double")
    known = F.col(cost) if cost in usage.columns else F.lit(None).cast("double")
    generated = F.col("mean_generated_tokens")
    priced = ((F.col("mean_total_tokens") - generated) * F.col("_in") + generated * F.col("_out")) / 1e6
    joined = usage.join(F.broadcast(price), usage[model] == price["_m"], "left")
    return joined.withColumn(cost, F.when(known.isNull() | (known == 0), F.coalesce(priced, known)).otherwise(known)).drop("_m", "_in", "_out")


def usage_labels(usage: DataFrame) -> DataFrame:
    """Mean tokens in thousands and mean cost in dollars as shown; a missing mean is ``N/A`` and a
    missing column ``-``."""

    def shown(name: str, head: str, pattern: str, tail: str, per: float = 1.0) -> Column:
        if name not in usage.columns:
            return F.lit("-")
        value = F.col(name).cast("double") / per
        return F.when(value.isNull(), F.lit("N/A")).otherwise(F.concat(F.lit(head), F.format_string(pattern, value), F.lit(tail)))

    made = ("mean_total_tokens", "mean_generated_tokens", "mean_cost")
    return usage.select(*[c for c in usage.columns if c not in made], shown("mean_total_tokens", "", "%.1f", "K", 1000).alias("total_tokens"), shown("mean_generated_tokens", "", "%.1f", "K", 1000).alias("gen_tokens"), shown("mean_cost", "$", "%.2f", "").alias("cost"))


def estimator_model(config: Column) -> Column:
    """The model named by a run's configuration (a JSON text), found where its type of estimator keeps
    it; types without a model have a fixed label, and an unknown type is an error."""
    at = lambda path: F.get_json_object(config, f"$.estimator.{path}")
    kind = at("estimator_type")
    return (
        F.when(kind == "oh_gsn", F.coalesce(at("graph_populator.agent.model_name"), at("graph_generator.agent.model_name")))
        .when(kind == "litellm_verbal", at("litellm.agent.model_name"))
        .when(kind.isin("log_probs_estimator", "gsn_plain_verbalized"), at("agent.model_name"))
        .when(kind == "replay", F.lit("replay"))
        .when(kind.isin("dummy", "gsn_product", "gsn_aggregate"), F.lit("N/A"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown estimator type: "), F.coalesce(kind, F.lit("none")))).cast("string"))
    )


def by_benchmark(df: DataFrame, default: str, texts: dict[str, str], column: str = "benchmark", name: str = "criteria") -> DataFrame:
    """``df`` with the text of its benchmark: ``default`` for none, and an error for an unknown one."""
    known = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[F.col(column)] if texts else F.lit(None).cast("string")
    lost = F.raise_error(F.concat(F.lit("no text for benchmark "), F.col(column))).cast("string")
    return df.withColumn(name, F.when(F.col(column).isNull(), F.lit(default)).otherwise(F.coalesce(known, lost)))


#: Rows of a table that is rendered as one text; larger ones belong in a sink.
MOST_SHOWN = 10_000


def _shown(rows: DataFrame, most: int) -> list:
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows to render: write the table with a sink")
    return got


def delimited(rows: DataFrame, decimals: int = 2, mark: str = "\t", most: int = MOST_SHOWN) -> str:
    """A summary table (few rows by nature: one per run) as CSV or TSV text; more than ``most`` rows are
    an error."""
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    return "\n".join([mark.join(rows.columns), *(mark.join(map(show, r)) for r in _shown(rows, most))])


def merge_usage(df: DataFrame, keys: Sequence[str], column: str = "usage_by_model") -> DataFrame:
    """A map of structs per row, summed field by field per key and model."""
    fields = df.schema[column].dataType.valueType.fieldNames()
    each = df.select(*keys, F.explode(column).alias("usage_model", "u"))
    return each.groupBy(*keys, "usage_model").agg(*[F.sum(f"u.{f}").alias(f) for f in fields])


def usage_delta(after: DataFrame, before: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Metrics after less a baseline; rows that did not change are left out."""
    base = before.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    delta = after.join(base, list(keys), "left").select(*keys, *[(F.col(f) - F.coalesce(f"_{f}", F.lit(0))).alias(f) for f in fields])
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f) != 0)
    return delta.where(changed)


def nearest_percentile(df: DataFrame, keys: Sequence[str], column: str, q: float, name: str) -> DataFrame:
    """The value at 0-based place q*(n-1), rounded half to even, from counts by different value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_m"))
    placed = running(counts, list(keys), [column], {"_upto": F.col("_m")})
    return placed.where(F.col("_upto") > F.rint(q * (F.col("_upto_all") - 1))).groupBy(*keys).agg(F.min(column).alias(name))


def markdown(rows: DataFrame, decimals: int = 2, most: int = MOST_SHOWN) -> str:
    """A summary table (few rows by nature: one per run) as Markdown; more than ``most`` rows are an error."""
    got = _shown(rows, most)
    show = lambda v: "N/A" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(map(show, r)) + " |" for r in got)])
