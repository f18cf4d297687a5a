"""Quality of claim graphs: claim pairs, entailment scores and aggregation errors."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.functions.permute import permuted
from verity.functions.scores import geometric_mean, product
from verity.operators.graphs import goal_edges
from verity.plans.tables import running

# The labels of an assessment and the names of the checks.
LABELS = ("entailment", "contradiction", "neutral")
SUFFICIENCY, NECESSITY, SIBLINGS, PARTICULARIZATION = "joint_sufficiency", "child_necessity", "non_redundant_siblings", "quality_of_particularization"
CHECKS = (SUFFICIENCY, NECESSITY, SIBLINGS, PARTICULARIZATION)


def children_of(nodes: DataFrame, edges: DataFrame, claim: str = "auditable_claim") -> DataFrame:
    """(gid, parent, relation, parent_claim, ids, claims): each parent's goal children in edge order."""
    claims = nodes.select("gid", "id", F.col(claim).alias("claim"))
    inner = goal_edges(nodes, edges).join(claims.select("gid", F.col("id").alias("source"), F.col("claim").alias("child_claim")), ["gid", "source"])
    each = F.struct("pos", F.col("source").alias("id"), F.col("child_claim").alias("claim"))
    grouped = inner.groupBy("gid", F.col("target").alias("parent"), F.col("relationship_type").alias("relation")).agg(F.sort_array(F.collect_list(each)).alias("kids"))
    own = claims.select("gid", F.col("id").alias("parent"), F.col("claim").alias("parent_claim"))
    return grouped.join(own, ["gid", "parent"]).select("gid", "parent", "relation", "parent_claim", F.transform("kids", lambda k: k["id"]).alias("ids"), F.transform("kids", lambda k: k["claim"]).alias("claims"))


def claim_pairs(nodes: DataFrame, edges: DataFrame, claim: str = "auditable_claim") -> DataFrame:
    """(gid, metric, parent, pair, direction, child_ids, premise, hypothesis).

    joint_sufficiency: all children's claims joined by " AND " against the parent's, one pair for each
    decomposition; child_necessity: the parent's claim against each child's; quality_of_particularization:
    child against parent and the reverse, as two directions of a pair.
    """
    kids = children_of(nodes, edges, claim)
    parts = kids.where("relation = 'decomposes_from'")
    joint = parts.select("gid", F.lit(SUFFICIENCY).alias("metric"), "parent", F.lit(0).alias("pair"), F.lit(0).alias("direction"), F.col("ids").alias("child_ids"), F.array_join("claims", " AND ").alias("premise"), F.col("parent_claim").alias("hypothesis"))
    each = lambda rows: rows.select("gid", "parent", "parent_claim", F.posexplode(F.arrays_zip("ids", "claims")).alias("pair", "child"))
    needed = each(parts).select("gid", F.lit(NECESSITY).alias("metric"), "parent", "pair", F.lit(0).alias("direction"), F.array("child.ids").alias("child_ids"), F.col("parent_claim").alias("premise"), F.col("child.claims").alias("hypothesis"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("direction"), F.col("child.claims").alias("premise"), F.col("parent_claim").alias("hypothesis")), F.struct(F.lit(1).alias("direction"), F.col("parent_claim").alias("premise"), F.col("child.claims").alias("hypothesis"))))
    special = each(kids.where("relation = 'particularizes'")).select("gid", F.lit(PARTICULARIZATION).alias("metric"), "parent", "pair", F.array("child.ids").alias("child_ids"), both.alias("r")).select("gid", "metric", "parent", "pair", "r.direction", "child_ids", "r.premise", "r.hypothesis")
    return joint.unionByName(needed).unionByName(special)


def sibling_pairs(nodes: DataFrame, edges: DataFrame, claim: str = "auditable_claim") -> DataFrame:
    """Each two children of a parent (first before second in edge order), in both directions, as
    claim pairs of the metric ``non_redundant_siblings``."""
    ranked = children_of(nodes, edges, claim).where("relation = 'decomposes_from'").select("gid", "parent", F.posexplode(F.arrays_zip("ids", "claims")).alias("at", "kid"))
    a = ranked.select("gid", "parent", F.col("at").alias("i"), F.col("kid.ids").alias("id_a"), F.col("kid.claims").alias("a"))
    b = ranked.select("gid", "parent", F.col("at").alias("j"), F.col("kid.ids").alias("id_b"), F.col("kid.claims").alias("b"))
    pairs = a.join(b, ["gid", "parent"]).where("i < j")
    both = F.explode(F.array(F.struct(F.lit(0).alias("direction"), F.col("a").alias("premise"), F.col("b").alias("hypothesis")), F.struct(F.lit(1).alias("direction"), F.col("b").alias("premise"), F.col("a").alias("hypothesis"))))
    return pairs.select("gid", F.lit(SIBLINGS).alias("metric"), "parent", "i", "j", "id_a", "id_b", both.alias("r")).select("gid", "metric", "parent", "i", "j", "id_a", "id_b", "r.*")


def pair_at(k: Column, n: Column) -> tuple[Column, Column]:
    """The ``k``-th (from 0) of the pairs i < j of ``n``, in order of i, then j."""
    begin = lambda i: (i * (2 * n - i - 1) / 2).cast("long")
    near = (n - 2 - F.floor((F.sqrt((4 * n * (n - 1) - 8 * k - 7).cast("double")) - 1) / 2)).cast("long")
    i = F.when(begin(near) > k, near - 1).when(begin(near + 1) <= k, near + 1).otherwise(near)  # a root may be one off
    return i, k - begin(i) + i + 1


def sampled_sibling_pairs(nodes: DataFrame, edges: DataFrame, k: int, picked: DataFrame | None = None, seed: int = 42, claim: str = "auditable_claim") -> DataFrame:
    """``sibling_pairs`` of ``k`` pairs of each graph (all, if it has fewer), without making the others.

    The pairs of a graph are numbered, parent by parent (in the order of ids) and as they stand in
    ``sibling_pairs``; a number is turned into its parent and its two children by arithmetic. Which are
    taken is told by ``picked`` (gid, place; see ``sample_pairs``), or they are those that a permutation
    of all places by ``seed`` puts first.
    """
    claims = nodes.select("gid", "id", F.col(claim).alias("claim"))
    kids = goal_edges(nodes, edges).where("relationship_type = 'decomposes_from'").select("gid", F.col("target").alias("parent"), "source", "pos")
    kids = kids.withColumn("at", F.row_number().over(Window.partitionBy("gid", "parent").orderBy("pos", "source")) - 1)
    sizes = kids.groupBy("gid", "parent").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    placed = running(sizes, ["gid"], ["parent"], {"upto": F.col("pairs")}).withColumn("begin", F.col("upto") - F.col("pairs"))
    if picked is None:
        totals = placed.groupBy("gid").agg(F.max("upto").alias("all")).where("all > 0")
        first = totals.select("gid", "all", F.explode(F.sequence(F.lit(0), F.least(F.lit(k).cast("long"), F.col("all")) - 1)).alias("nth"))
        picked = first.select("gid", permuted(F.col("nth"), F.col("all"), seed).alias("place"))
    # each place lies in the parent that begins last before it
    both = placed.where("pairs > 0").select("gid", F.col("begin").alias("at"), F.struct("parent", "n", "begin").alias("p")).unionByName(picked.select("gid", F.col("place").alias("at"), F.lit(None).cast("struct<parent:string,n:bigint,begin:bigint>").alias("p")))
    before = Window.partitionBy("gid").orderBy("at", F.col("p").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("in", F.last("p", ignorenulls=True).over(before)).where("p is null")
    i, j = pair_at(F.col("at") - F.col("in.begin"), F.col("in.n"))
    chosen = found.select("gid", F.col("in.parent").alias("parent"), i.alias("i"), j.alias("j"))
    told = kids.join(claims.select("gid", F.col("id").alias("source"), "claim"), ["gid", "source"])
    side = lambda of, c: told.select("gid", "parent", F.col("at").cast("long").alias(of), F.col("source").alias(f"id_{c}"), F.col("claim").alias(c))
    pairs = chosen.join(side("i", "a"), ["gid", "parent", "i"]).join(side("j", "b"), ["gid", "parent", "j"])
    ways = F.explode(F.array(F.struct(F.lit(0).alias("direction"), F.col("a").alias("premise"), F.col("b").alias("hypothesis")), F.struct(F.lit(1).alias("direction"), F.col("b").alias("premise"), F.col("a").alias("hypothesis"))))
    return pairs.select("gid", F.lit(SIBLINGS).alias("metric"), "parent", "i", "j", "id_a", "id_b", ways.alias("r")).select("gid", "metric", "parent", "i", "j", "id_a", "id_b", "r.*")


def sample_pairs(counts: DataFrame, k: int) -> DataFrame:
    """(instance_id, model, picked): sorted places of ``k`` of ``n`` sibling pairs (all if fewer), drawn
    by Python's generator seeded with "<instance>:<model>:non_redundant_siblings"."""

    def draw(batches):
        for rows in batches:
            picked = [sorted(random.Random(f"{i}:{m}:{SIBLINGS}").sample(range(n), min(k, n))) for i, m, n in zip(rows["instance_id"], rows["model"], rows["n"], strict=True)]
            yield pd.DataFrame({"instance_id": rows["instance_id"], "model": rows["model"], "picked": picked})

    return counts.select("instance_id", "model", "n").mapInPandas(draw, "instance_id string, model string, picked array<int>")


def entailment_scores(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each label and the share of entailments by ``keys`` and metric."""
    counts = [F.count_if(F.col("label") == label).alias(label) for label in LABELS]
    return assessments.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("predictions"), *counts, F.expr("try_divide(count_if(label = 'entailment'), count(1))").alias("score"))


def paired_scores(assessments: DataFrame, keys: list[str], want: str) -> DataFrame:
    """Share of pairs whose two directions both entail (``entailment``) or both do not (``independence``)."""
    entails = F.col("label") == "entailment"
    good = entails if want == "entailment" else ~entails
    return assessments.groupBy(*keys, "parent", "pair").agg(F.bool_and(good).alias("ok")).groupBy(*keys).agg(F.avg(F.col("ok").cast("int")).alias("score"), F.count(F.lit(1)).alias("pairs"))


def total_entailments(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """Entailments over predictions of all metrics but the siblings'; null without a prediction."""
    some = assessments.where(F.col("metric") != SIBLINGS)
    return some.groupBy(*keys).agg(F.count_if(F.col("label") == "entailment").alias("entailments"), F.count(F.lit(1)).alias("predictions"), F.expr("try_divide(count_if(label = 'entailment'), count(1))").alias("score"))


def aggregation_mse(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean squared differences between a parent's confidence and its children's product, geometric
    and arithmetic mean, and between child and parent of particularizations. Nodes without
    confidence are left out with their parent."""
    conf = nodes.select("gid", "id", F.col("confidence").alias("c"))
    inner = goal_edges(nodes, edges).join(conf.select("gid", F.col("id").alias("source"), "c"), ["gid", "source"])
    grouped = inner.groupBy("gid", F.col("target").alias("id"), "relationship_type").agg(F.min("c").alias("least"), product(F.col("c")).alias("p"), geometric_mean(F.col("c")).alias("g"), F.avg("c").alias("m"))
    both = grouped.join(conf, ["gid", "id"]).where("least >= 0 and c >= 0")
    split = lambda kind, value: F.avg(F.when(F.col("relationship_type") == kind, F.pow(F.col("c") - value, 2)))
    d, s = "decomposes_from", "particularizes"
    return both.groupBy(*(keys or [])).agg(split(d, F.col("p")).alias("product_mse"), split(d, F.col("g")).alias("geometric_mse"), split(d, F.col("m")).alias("arithmetic_mse"), split(s, F.col("m")).alias("particularization_mse"), F.count_if(F.col("relationship_type") == d).alias("decompositions"), F.count_if(F.col("relationship_type") == s).alias("particularizations"))


def graph_scores(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ``score`` by ``keys`` and metric as a graph reports them: the share of entailments,
    but for the checks in two directions (``pair`` tells a check) the share of checks of which both
    directions entail, or for siblings of which neither does."""
    plain = entailment_scores(assessments, keys)
    paired = None
    for metric, want in ((SIBLINGS, "independence"), (PARTICULARIZATION, "entailment")):
        part = paired_scores(assessments.where(F.col("metric") == metric), keys, want).select(*keys, F.lit(metric).alias("metric"), F.col("score").alias("_paired"))
        paired = part if paired is None else paired.unionByName(part)
    return plain.join(paired, [*keys, "metric"], "left").withColumn("score", F.coalesce("_paired", "score")).drop("_paired")


def quality_summary(results: DataFrame, scores: DataFrame, failures: DataFrame | None = None, run: str = "run", min_n: int | None = None) -> DataFrame:
    """One row per run: evaluator, rows, failures, mean score of each check, entailments over all
    checks but the siblings', and sums and means of tokens and cost.

    ``results``: run, gid, evaluator_model, total_tokens, generated_tokens, cost, one row per graph;
    ``scores``: ``graph_scores`` by run and gid. A run with other than one evaluator is an error.
    """
    one = F.when(F.countDistinct("evaluator_model") == 1, F.max("evaluator_model")).otherwise(F.raise_error(F.lit("a run has other than one evaluator")).cast("string"))
    usage = [f(c).alias(f"{name}_{c}") for c in ("total_tokens", "generated_tokens", "cost") for name, f in (("avg", F.avg), ("sum", F.sum))]
    runs = results.groupBy(run).agg(one.alias("evaluator_model"), F.count(F.lit(1)).alias("n"), *usage)
    if min_n is not None:
        if min_n < 1:
            raise ValueError("min_n is 1 or more")
        runs = runs.where(F.col("n") >= min_n)
    of = lambda m: F.avg(F.when(F.col("metric") == m, F.col("score"))).alias(m)
    counted = F.col("metric") != SIBLINGS
    observed, expected = F.sum(F.when(counted, F.col("entailment"))), F.sum(F.when(counted, F.col("predictions")))
    checks = scores.groupBy(run).agg(*map(of, CHECKS), F.coalesce(observed, F.lit(0)).alias("observed_entailments"), F.coalesce(expected, F.lit(0)).alias("expected_entailments"), F.try_divide(observed, expected).alias("total_entailments"))
    out = runs.join(checks, run, "left")
    if failures is None:
        return out.withColumn("failed", F.lit(0).cast("long"))
    lost = failures.groupBy(run).agg(F.count(F.lit(1)).alias("failed"))
    return out.join(lost, run, "left").fillna(0, ["failed"])


def macro_average(per_graph: DataFrame, keys: list[str], score: str = "score", count: str = "predictions") -> DataFrame:
    """Mean of the graphs' scores that are not null, and mean count, by key."""
    return per_graph.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.avg(count).alias("mean_predictions"), F.count(score).alias("graphs"))


def pair_counts(pairs: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Dry run: pairs by metric, and of which graphs results are saved (gid) already."""
    marked = pairs if saved is None else pairs.join(saved.select("gid").distinct().withColumn("_saved", F.lit(True)), "gid", "left")
    done: Column = F.coalesce(F.col("_saved"), F.lit(False)) if saved is not None else F.lit(False)
    return marked.groupBy("metric").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(done).alias("resumed"), F.count_if(~done).alias("to_run"))
