"""Evaluation of confidences against outcomes: one row per run (or any other key)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.functions.scores import EPSILON, bin_index
from verity.plans.tables import Scratch, cut, eq_join, running

NAN = float("nan")
METRICS = ["n", "auroc", "auarc", "beh_align_score", "ece", "adaptive_ece", "brier", "brier_skill", "nll", "mean_confidence", "std_confidence", "mean_accuracy"]


def _base(df: DataFrame, keys: Sequence[str], confidence: str, label: str, order: str) -> DataFrame:
    named = [F.col(k) for k in keys]
    return df.select(*named, F.col(confidence).cast("double").alias("_c"), F.col(label).cast("double").alias("_y"), F.col(order).alias("_ord")).where("_c is not null and _y is not null")


def ranked(df: DataFrame, keys: Sequence[str], confidence: str, label: str, order: str, scratch: Scratch) -> DataFrame:
    """Each row with its place from the top and from the bottom (ties by input order), the hits so far,
    and the misses below it and level with it.

    Rows are sorted by range of (key, confidence, order), so a key or a group of one confidence may lie
    in many parts and no task holds more than its part. Sums run within the parts; a part adds the sums
    of the parts before it, and for its first and its last group, which alone go on in other parts, what
    those have of them. That is a row for each key and part, which meets the sorted rows where they are:
    nothing is joined by confidence.
    """
    k = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))  # one column, in which nulls are equal
    base = _base(df, keys, confidence, label, order).withColumn("_k", k)
    ranged = base.repartitionByRange("_k", "_c", "_ord").sortWithinPartitions("_k", "_c", "_ord")
    rows = scratch.cut(ranged.select("_k", "_c", "_y", "_ord", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    inside, group = Window.partitionBy("_k", "_part").orderBy("_c", "_ord", "_at").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_k", "_part", "_c")
    within = rows.select("*", F.count(F.lit(1)).over(inside).alias("_r"), F.sum("_y").over(inside).alias("_u"))
    within = within.select("*", F.count(F.lit(1)).over(group).alias("_gm"), F.sum("_y").over(group).alias("_gp"), F.min("_r").over(group).alias("_gr"), F.min(F.col("_u") - F.col("_y")).over(group).alias("_gu"))
    ends = rows.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.min("_c").alias("low"), F.max("_c").alias("high"))
    ends = scratch.cut(ends, "ranked-parts")
    edge = rows.join(ends.select("_k", "_part", "low", "high"), ["_k", "_part"]).where((F.col("_c") == F.col("low")) | (F.col("_c") == F.col("high")))
    edge = edge.groupBy("_k", "_part", "_c").agg(F.count(F.lit(1)).alias("m"), F.sum("_y").alias("p"))
    same = Window.partitionBy("_k", "_c")
    earlier = same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    edge = edge.select("_k", "_part", F.struct("_c", F.sum("m").over(same).alias("m"), F.sum("p").over(same).alias("p"), zero(F.sum("m").over(earlier)).alias("im"), zero(F.sum("p").over(earlier)).alias("ip")).alias("e"))
    edge = edge.groupBy("_k", "_part").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    all_parts = Window.partitionBy("_k")
    before = all_parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = ends.select("_k", "_part", zero(F.sum("n").over(before)).alias("bn"), zero(F.sum("s").over(before)).alias("bs"), F.sum("n").over(all_parts).alias("_n"), F.sum("s").over(all_parts).alias("_s")).join(edge, ["_k", "_part"])
    both = within.join(moved, ["_k", "_part"])
    border = F.when(F.col("_c") == F.col("first._c"), F.col("first")).when(F.col("_c") == F.col("last._c"), F.col("last"))
    told = both.withColumn("_e", border)
    m, p = F.coalesce("_e.m", "_gm"), F.coalesce("_e.p", "_gp")
    i, hits = zero(F.col("_e.im")) + F.col("_r") - F.col("_gr") + 1, zero(F.col("_e.ip")) + F.col("_u") - F.col("_gu")
    placed = told.select(*[F.col(f"_k.{c}").alias(c) for c in keys], "_c", "_y", "_ord", "_n", "_s", i.alias("_i"), hits.alias("_hits"), m.alias("_m"), p.alias("_p"), (F.col("bn") + F.col("_r") - i).alias("_below"), (F.col("bs") + F.col("_u") - hits).alias("_lost"))
    return placed.select(
        *keys, "_c", "_y", "_ord", "_below", "_n", "_i", "_hits",
        (F.col("_n") - F.col("_below") - F.col("_m")).alias("_above"),
        (F.col("_s") - F.col("_lost") - F.col("_p")).alias("_won"),
        (F.col("_below") - F.col("_lost")).alias("_under"),
        (F.col("_m") - F.col("_p")).alias("_level"),
    )


def _from_ranks(df: DataFrame, keys: Sequence[str], confidence: str, label: str, order: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of the ranked rows, a small table; the sorted rows are deleted."""
    with Scratch(df.sparkSession) as scratch:
        return cut(made(ranked(df, keys, confidence, label, order, scratch)), "metrics")


def _auroc(won: Column, hits: Column, n: Column) -> Column:
    total = hits * (n - hits)
    return F.when(total > 0, won / total).otherwise(F.lit(NAN))


def auroc(df: DataFrame, keys: Sequence[str], confidence: str = "estimated_confidence", label: str = "resolved") -> DataFrame:
    """Area under the ROC curve with tie-averaged ranks, from counts by different confidence; NaN
    where one class is missing."""
    base = _base(df, keys, confidence, label, label)
    groups = base.groupBy(*keys, "_c").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q"))
    below = running(groups, keys, ["_c"], {"_upto": F.col("_q")})
    won = F.sum(F.col("_p") * (F.col("_upto") - F.col("_q") / 2))
    return below.groupBy(*keys).agg(_auroc(won, F.sum("_p"), F.sum(F.col("_p") + F.col("_q"))).alias("auroc"))


def auarc(df: DataFrame, keys: Sequence[str], confidence: str = "estimated_confidence", label: str = "resolved", order: str = "ord") -> DataFrame:
    """Trapezoids under accuracy against coverage, over n; one row gives 0."""
    return _from_ranks(df, keys, confidence, label, order, lambda rows: rows.withColumn("_acc", _accuracy()).groupBy(*keys).agg(_auarc().alias("auarc")))


def _accuracy() -> Column:
    return (F.col("_won") + F.col("_hits")) / (F.col("_above") + F.col("_i"))


def _auarc() -> Column:
    first = F.max(F.when(F.col("_above") + F.col("_i") == 1, F.col("_acc")))
    n = F.count(F.lit(1))
    return F.when(n == 1, 0.0).otherwise((F.sum("_acc") - (first + F.avg("_y")) / 2) / n)


def selective_utility(df: DataFrame, keys: Sequence[str], threshold: float, confidence: str = "estimated_confidence", label: str = "resolved") -> DataFrame:
    if not 0 <= threshold < 1:
        raise ValueError("the threshold is in [0, 1)")
    base = _base(df, keys, confidence, label, label)
    answered = F.when(F.col("_c") >= threshold, F.when(F.col("_y") == 1, 1.0).otherwise(-threshold / (1 - threshold))).otherwise(0.0)
    return base.groupBy(*keys).agg(F.avg(answered).alias("selective_utility"))


def _bas() -> Column:
    return F.avg(F.when(F.col("_y") == 1, F.col("_c")).otherwise(F.col("_c") + F.log(1 - F.least("_c", F.lit(1 - EPSILON)))))


def _nll() -> Column:
    c = F.greatest(F.least(F.col("_c"), F.lit(1 - EPSILON)), F.lit(EPSILON))
    return F.avg(-(F.col("_y") * F.log(c) + (1 - F.col("_y")) * F.log(1 - c)))


def _brier() -> Column:
    return F.avg(F.pow(F.col("_c") - F.col("_y"), 2))


def _brier_skill() -> Column:
    p = F.avg("_y")
    return F.when(p * (1 - p) > 0, 1 - _brier() / (p * (1 - p))).otherwise(F.lit(NAN))


SIMPLE = {"beh_align_score": _bas, "brier": _brier, "brier_skill": _brier_skill, "nll": _nll}


def simple_metric(df: DataFrame, keys: Sequence[str], name: str, confidence: str = "estimated_confidence", label: str = "resolved") -> DataFrame:
    """One of beh_align_score, brier, brier_skill and nll."""
    return _base(df, keys, confidence, label, label).groupBy(*keys).agg(SIMPLE[name]().alias(name))


def expected_calibration_error(df: DataFrame, keys: Sequence[str], bins: int = 10, confidence: str = "estimated_confidence", label: str = "resolved", name: str = "ece") -> DataFrame:
    """Equal-width bins. Scores outside [0, 1] are in no bin but count in n."""
    base = _base(df, keys, confidence, label, label).withColumn("_bin", bin_index("_c", bins))
    by_bin = base.groupBy(*keys, "_bin").agg(F.abs(F.sum("_y") - F.sum("_c")).alias("_gap"), F.count(F.lit(1)).alias("_m"))
    return by_bin.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("_bin").isNotNull(), F.col("_gap"))), F.lit(0.0)) / F.sum("_m")).alias(name))


def chunk_index(rank: Column, n: Column, k: int) -> Column:
    """Of a 0-based rank, the chunk when n rows are cut into k, the first n mod k with one more."""
    q, r = F.floor(n / k), n % k
    wide = r * (q + 1)
    return F.when(rank < wide, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - wide) / F.greatest(q, F.lit(1))))


def adaptive_calibration_error(df: DataFrame, keys: Sequence[str], bins: int = 10, confidence: str = "estimated_confidence", label: str = "resolved", order: str = "ord", name: str = "adaptive_ece") -> DataFrame:
    """Equal-count chunks in order of confidence, ties in input order; empty chunks do not count."""
    chunk = chunk_index(F.col("_below") + F.col("_i") - 1, F.col("_n"), bins)

    def made(rows: DataFrame) -> DataFrame:
        by_chunk = rows.groupBy(*keys, chunk.alias("_chunk")).agg(F.abs(F.sum("_c") - F.sum("_y")).alias("_gap"), F.count(F.lit(1)).alias("_m"))
        return by_chunk.groupBy(*keys).agg((F.sum("_gap") / F.sum("_m")).alias(name))

    return _from_ranks(df, keys, confidence, label, order, made)


def calibration_sweep(df: DataFrame, keys: Sequence[str], bins: Sequence[int], confidence: str = "estimated_confidence", label: str = "resolved", order: str = "ord") -> DataFrame:
    """One row per key: ``ece_k`` and ``adaptive_ece_k`` for each number of bins. The places are worked
    out once, and one grouping has the sums of the cells of every number of bins."""
    cells = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), cell.cast("long").alias("cell")) for k in bins for kind, cell in (("", bin_index("_c", k)), ("adaptive_", chunk_index(F.col("_below") + F.col("_i") - 1, F.col("_n"), k)))]

    def summed(rows: DataFrame) -> DataFrame:
        each = rows.select(*keys, "_c", "_y", F.explode(F.array(*cells)).alias("x"))
        return each.groupBy(*keys, "x").agg(F.abs(F.sum("_y") - F.sum("_c")).alias("gap"), F.count(F.lit(1)).alias("m"))

    sums = _from_ranks(df, keys, confidence, label, order, summed)

    def error(k: int, kind: str) -> Column:
        own = (F.col("x.k") == k) & (F.col("x.kind") == kind)
        return (F.coalesce(F.sum(F.when(own & F.col("x.cell").isNotNull(), F.col("gap"))), F.lit(0.0)) / F.sum(F.when(own, F.col("m")))).alias(f"{kind}ece_{k}")

    return sums.groupBy(*keys).agg(*[error(k, kind) for k in bins for kind in ("", "adaptive_")])


def run_metrics(df: DataFrame, keys: Sequence[str] = ("run",), confidence: str = "estimated_confidence", label: str = "resolved", order: str = "ord", bins: int = 10) -> DataFrame:
    """All of METRICS by key. Rows without confidence or outcome are left out.

    The places are worked out once. One grouping by (key, bin, chunk) makes sums of fixed number, and
    every metric is an expression of those sums.
    """
    keys = list(keys)
    c, y = F.col("_c"), F.col("_y")
    clipped = F.greatest(F.least(c, F.lit(1 - EPSILON)), F.lit(EPSILON))
    cells = lambda rows: rows.withColumn("_acc", _accuracy()).withColumn("_bin", bin_index("_c", bins)).withColumn("_chunk", chunk_index(F.col("_below") + F.col("_i") - 1, F.col("_n"), bins))
    sums = _from_ranks(df, keys, confidence, label, order, lambda rows: cells(rows).groupBy(*keys, "_bin", "_chunk").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum(c).alias("sc"),
        F.sum(c * c).alias("scc"),
        F.sum(y).alias("sy"),
        F.sum("_acc").alias("sa"),
        F.max(F.when(F.col("_above") + F.col("_i") == 1, F.col("_acc"))).alias("first"),
        F.sum(F.pow(c - y, 2)).alias("sb"),
        F.sum(F.when(y == 1, c).otherwise(c + F.log(1 - F.least(c, F.lit(1 - EPSILON))))).alias("ss"),
        F.sum(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("sl"),
        F.sum(y * (F.col("_under") + F.col("_level") / 2)).alias("sw"),
    ))
    n, p = F.sum("m"), F.sum("sy") / F.sum("m")
    brier = F.sum("sb") / n
    whole = sums.groupBy(*keys).agg(
        n.alias("n"),
        _auroc(F.sum("sw"), F.sum("sy"), n).alias("auroc"),
        F.when(n == 1, 0.0).otherwise((F.sum("sa") - (F.max("first") + p) / 2) / n).alias("auarc"),
        (F.sum("ss") / n).alias("beh_align_score"),
        brier.alias("brier"),
        F.when(p * (1 - p) > 0, 1 - brier / (p * (1 - p))).otherwise(F.lit(NAN)).alias("brier_skill"),
        (F.sum("sl") / n).alias("nll"),
        (F.sum("sc") / n).alias("mean_confidence"),
        F.sqrt(F.greatest(F.sum("scc") / n - F.pow(F.sum("sc") / n, 2), F.lit(0.0))).alias("std_confidence"),
        p.alias("mean_accuracy"),
    )

    def error(cell: str, name: str) -> DataFrame:
        per = sums.where(F.col(cell).isNotNull()).groupBy(*keys, cell).agg(F.abs(F.sum("sy") - F.sum("sc")).alias("gap"))
        return per.groupBy(*keys).agg(F.sum("gap").alias(name))

    out = eq_join(whole, error("_chunk", "_adaptive"), keys)
    out = eq_join(out, error("_bin", "_equal"), keys)
    return out.select(*keys, "n", "auroc", "auarc", "beh_align_score", (F.col("_equal") / F.col("n")).alias("ece"), (F.col("_adaptive") / F.col("n")).alias("adaptive_ece"), "brier", "brier_skill", "nll", "mean_confidence", "std_confidence", "mean_accuracy")
