"""Confidences propagated from the leaves of claim graphs to their roots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.functions.scores import claim_dropout, geometric_mean, product, require, temperature_scale
from verity.functions.text import outdated
from verity.operators.contract import MATRIX, RULES, Columns, Rule, along_ancestors, evaluate, interpolated
from verity.operators.graphs import GOAL, confidence_leaves, goal_edges, goal_leaves, leaves
from verity.plans.tables import Scratch, cut

Combine = Callable[[Column], Column]

COMBINE: dict[str, Combine] = {
    "product": product,
    "geometric_mean": geometric_mean,
    "arithmetic_mean": F.avg,
    "minimum": F.min,
    "maximum": F.max,
    "union_bound": lambda c: F.greatest(F.lit(0.0), 1 - F.sum(1 - c)),
}


#: Tables of levels that are read side by side before they are written as one.
SIDE_BY_SIDE = 6


def bottom_up(nodes: DataFrame, edges: DataFrame, combine: Combine, finish: Callable[[Column], Column] = lambda derived: derived, max_levels: int = 10_000) -> DataFrame:
    """``nodes`` with the confidence of every goal whose goal children are all resolved and set, for any
    rule; see ``contracted`` for those whose rounds do not grow with the depth.

    A leaf is resolved as it is; ``combine`` is an aggregate over children and ``finish`` an expression
    over its result (``derived``) and the node's own columns. Goals that never resolve (a cycle or an
    unset leaf below) keep what they had; evidence does not count. Each level of all graphs is one
    join and one partial aggregation, and only goals that wait take part.
    """
    with Scratch(nodes.sparkSession) as scratch:
        inner = scratch.cut(goal_edges(nodes, edges).select("gid", "source", "target"), "propagate-edges")
        waiting = inner.groupBy("gid", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("_k"))
        waiting = scratch.cut(waiting.join(nodes, ["gid", "id"]), "propagate-waiting")
        levels = [scratch.cut(goal_leaves(nodes, edges).where("confidence >= 0").select("gid", "id", "confidence", F.lit(False).alias("derived")), "propagate-done")]
        for _ in range(max_levels):
            done = levels[0]
            for level in levels[1:]:
                done = done.unionByName(level)
            if len(levels) > SIDE_BY_SIDE:
                done = scratch.cut(done, "propagate-done")
                for level in levels:
                    scratch.drop(level)
                levels = [done]
            child = done.select("gid", F.col("id").alias("source"), F.col("confidence").alias("_c"))
            ready = inner.join(child, ["gid", "source"]).groupBy("gid", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("_r"), combine(F.col("_c")).alias("derived"))
            fresh = waiting.join(ready, ["gid", "id"]).where("_r = _k").join(done.select("gid", "id"), ["gid", "id"], "left_anti")
            fresh, counts = scratch.cut_counted(fresh.select("gid", "id", finish(F.col("derived")).alias("confidence"), F.lit(True).alias("derived")), "propagate-level", n=F.lit(1))
            if not counts["n"]:
                break
            levels.append(fresh)
        new = cut(done.where("derived").select("gid", "id", F.col("confidence").alias("_new")), "propagate-derived")
    return _renewed(nodes, new)


def _renewed(nodes: DataFrame, new: DataFrame, checked: Callable[[Column], Column] = lambda new: new) -> DataFrame:
    """``nodes`` with the confidences of ``new`` (gid, id, _new)."""
    joined = nodes.join(new, ["gid", "id"], "left")
    found = F.when(F.col("_new").isNotNull(), checked(F.col("_new"))).otherwise(F.col("confidence"))
    return joined.select(*[found.alias(c) if c == "confidence" else F.col(c) for c in nodes.columns])


def contracted(nodes: DataFrame, edges: DataFrame, rule: Rule, checked: Callable[[Column], Column] = lambda new: new) -> DataFrame:
    """As ``bottom_up``, for a rule of ``contract``: rounds grow with the logarithm of the size."""
    with Scratch(nodes.sparkSession) as scratch:
        inner = scratch.cut(goal_edges(nodes, edges).select("gid", "source", "target"), "contract-inner")
        new = evaluate(nodes, inner, _leaves_of(nodes, inner).where("confidence >= 0").select("gid", "id", F.col("confidence").alias("value")), rule)
    return _renewed(nodes, new.withColumnRenamed("value", "_new"), checked)


def _leaves_of(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """``goal_leaves``, of which the edges between goals are there."""
    return nodes.where(F.col("kind") == GOAL).join(inner.select("gid", F.col("target").alias("id")), ["gid", "id"], "left_anti")


def aggregate(nodes: DataFrame, edges: DataFrame, method: str) -> DataFrame:
    """One of COMBINE at every level."""
    return contracted(nodes, edges, RULES[method])


def _on_leaves(nodes: DataFrame, edges: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Goal leaves changed (an unset leaf is an error), other goals unset, evidence as it was."""
    leaf = goal_leaves(nodes, edges).select("gid", "id", F.lit(True).alias("_leaf"))
    c = F.col("confidence")
    changed = require(c >= 0, "a leaf has no confidence", change(c))
    new = F.when(F.col("_leaf"), changed).when(F.col("kind") == GOAL, F.lit(-1.0)).otherwise(c)
    return nodes.join(leaf, ["gid", "id"], "left").withColumn("confidence", new).drop("_leaf")


def product_claim_dropout(nodes: DataFrame, edges: DataFrame, dropout: float) -> DataFrame:
    return contracted(_on_leaves(nodes, edges, lambda c: claim_dropout(c, dropout)), edges, RULES["product"])


def product_adaptive_dropout(nodes: DataFrame, edges: DataFrame, expected_leaves: float) -> DataFrame:
    """Dropout max(0, 1 - k / leaves) of each graph."""
    count = goal_leaves(nodes, edges).groupBy("gid").agg(F.count(F.lit(1)).alias("_leaves"))
    with_count = nodes.join(count, "gid", "left")
    d = F.greatest(F.lit(0.0), 1 - expected_leaves / F.col("_leaves"))
    return contracted(_on_leaves(with_count, edges, lambda c: claim_dropout(c, d)).drop("_leaves"), edges, RULES["product"])


def product_leaf_temperature(nodes: DataFrame, edges: DataFrame, temperature: float) -> DataFrame:
    return contracted(_on_leaves(nodes, edges, lambda c: temperature_scale(c, temperature)), edges, RULES["product"])


def product_all_temperature(nodes: DataFrame, edges: DataFrame, temperature: float) -> DataFrame:
    """Leaves are scaled, and so is each product."""
    scaled = _on_leaves(nodes, edges, lambda c: temperature_scale(c, temperature))
    return bottom_up(scaled, edges, product, lambda p: temperature_scale(p, temperature))


def final_temperature(nodes: DataFrame, root: DataFrame, temperature: float) -> DataFrame:
    """Only the root's own confidence (gid, root) is scaled; an unset root is an error."""
    c = F.col("confidence")
    scaled = require(c >= 0, "the root has no confidence", temperature_scale(c, temperature))
    at = root.select("gid", F.col("root").alias("id"), F.lit(True).alias("_root"))
    return nodes.join(at, ["gid", "id"], "left").withColumn("confidence", F.when(F.col("_root"), scaled).otherwise(c)).drop("_root")


def geometric_mean_of_leaves(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    """The root gets the geometric mean of all goal leaves of its graph; other inner goals are unset.
    A root that is the only leaf gets its own confidence."""
    own = _on_leaves(nodes, edges, lambda c: c)
    c = F.col("confidence")
    mean = goal_leaves(nodes, edges).groupBy("gid").agg(geometric_mean(c).alias("_mean"))
    at = root.select("gid", F.col("root").alias("id"), F.lit(True).alias("_root"))
    joined = own.join(mean, "gid", "left").join(at, ["gid", "id"], "left")
    return joined.withColumn("confidence", F.when(F.col("_root") & F.col("_mean").isNotNull(), F.col("_mean")).otherwise(c)).drop("_mean", "_root")


def product_interpolated(nodes: DataFrame, edges: DataFrame, prior: float | None = None) -> DataFrame:
    """w * product of the children + (1 - w) * own confidence (or ``prior``), with w the node's
    ``confidence_in_children``. Unset w (and without a prior, an unset goal) is an error."""
    if prior is not None and not 0 <= prior <= 1:
        raise ValueError("the prior is in [0, 1]")
    w, own = F.col("confidence_in_children"), F.lit(float(prior)) if prior is not None else F.col("confidence")
    mean: Callable[[Columns], Column] = (lambda p: F.lit(float(prior))) if prior is not None else (lambda p: p["confidence"])
    rule = interpolated("confidence_in_children", mean, ("confidence_in_children", "confidence"))
    return contracted(nodes, edges, rule, lambda new: require((w >= 0) & (own >= 0), "a weight or a confidence is unset", new))


#: What each aggregation type takes besides the graph, by the name of the parameter.
AGGREGATIONS: dict[str, tuple[str, ...]] = {
    "product": (),
    "product_leaf_adaptive_claim_dropout": ("expected_leaves",),
    "product_leaf_claim_dropout": ("dropout",),
    "product_leaf_temperature_scaled": ("temperature",),
    "product_all_temperature_scaled": ("temperature",),
    "temperature_scale_final": ("temperature",),
    "geometric_mean": (),
    "geometric_mean_leaves": (),
    "arithmetic_mean": (),
    "minimum": (),
    "maximum": (),
    "union_bound": (),
    "simple_bp_goal_leaf_v1": (),
    "simple_bp_goal_leaf_v2": (),
    "product_interp_prior": ("prior",),
}
RANGES: dict[str, Callable[[float], bool]] = {"temperature": lambda x: x > 0, "dropout": lambda x: 0 <= x <= 1, "expected_leaves": lambda x: x >= 0, "prior": lambda x: 0 <= x <= 1}


def aggregate_graphs(nodes: DataFrame, edges: DataFrame, root: DataFrame, aggregation: str, **parameters: float) -> DataFrame:
    """``nodes`` after one of AGGREGATIONS, with the old rationale of changed goals marked as outdated.

    A parameter that the type takes and lacks, or has and does not take, is an error.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {aggregation}")
    given = {k: v for k, v in parameters.items() if v is not None}
    if set(given) != set(AGGREGATIONS[aggregation]) or not all(RANGES[k](v) for k, v in given.items()):
        raise ValueError(f"{aggregation} takes {AGGREGATIONS[aggregation] or 'no parameter'}, got {given}")
    value = next(iter(given.values()), 0.0)
    if aggregation in COMBINE:
        out = aggregate(nodes, edges, aggregation)
    elif aggregation.startswith("simple_bp"):
        out = belief_propagation(nodes, edges, 1 if aggregation.endswith("v1") else 2)
    elif aggregation == "temperature_scale_final":
        out = final_temperature(nodes, root, value)
    elif aggregation == "geometric_mean_leaves":
        out = geometric_mean_of_leaves(nodes, edges, root)
    elif aggregation == "product_interp_prior":
        out = product_interpolated(nodes, edges, value)
    else:
        ways = {"product_leaf_adaptive_claim_dropout": product_adaptive_dropout, "product_leaf_claim_dropout": product_claim_dropout, "product_leaf_temperature_scaled": product_leaf_temperature, "product_all_temperature_scaled": product_all_temperature}
        out = ways[aggregation](nodes, edges, value)
    if "confidence_rationale" not in nodes.columns:
        return out
    before = nodes.select("gid", "id", F.col("confidence").alias("_old"))
    both = out.join(before, ["gid", "id"])
    changed = (F.col("kind") == GOAL) & (F.col("confidence") != F.col("_old"))
    new = F.when(changed, outdated(F.col("confidence_rationale"), aggregation)).otherwise(F.col("confidence_rationale"))
    return both.select(*[new.alias(c) if c == "confidence_rationale" else F.col(c) for c in nodes.columns])


def root_confidence(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """(gid, confidence) of the roots (gid, root); an unset root is an error, a lost one is absent."""
    at = root.select("gid", F.col("root").alias("id"))
    c = F.col("confidence")
    return nodes.join(at, ["gid", "id"]).select("gid", require(c >= 0, "the root has no confidence", c).alias("confidence"))


Score = Callable[[DataFrame], DataFrame]
POPULATIONS = ("all_nodes", "goal_leaves_product", "product_interp_verbalized", "product_interp_prior")


def populate(nodes: DataFrame, edges: DataFrame, score: Score, mode: str = "all_nodes", prior: float | None = None, max_waves: int = 10_000) -> DataFrame:
    """``nodes`` with a confidence for all (``all_nodes``) or for all goals.

    ``score`` takes rows of nodes and returns (gid, id, confidence). all_nodes: unset nodes without
    predecessors, then wave by wave those whose predecessors are all set. The other modes score goal
    leaves and propagate by product, or by interpolation with the goals' own scores or a prior. Nodes
    that never become ready are an error. Every wave is one job over all graphs.
    """
    if mode not in POPULATIONS:
        raise ValueError(f"unknown mode: {mode}")

    def fill(now: DataFrame, rows: DataFrame) -> DataFrame:
        told = cut(score(rows).select("gid", "id", F.col("confidence").alias("_new")), "populate-scores")
        return cut(now.join(told, ["gid", "id"], "left").select(*[F.coalesce("_new", "confidence").alias("confidence") if c == "confidence" else F.col(c) for c in nodes.columns]), "populate-nodes")

    def settled(now: DataFrame, of: Column) -> DataFrame:
        left = now.where(of & (F.col("confidence") < 0)).limit(20).collect()
        if left:
            raise ValueError(f"never ready: {[(r['gid'], r['id']) for r in left]}")
        return now

    unset = F.col("confidence") < 0
    goal = F.col("kind") == GOAL
    if mode == "all_nodes":
        now = fill(nodes, leaves(nodes, edges).where(unset))
        for _ in range(max_waves):
            ready = cut(confidence_leaves(now, edges), "populate-ready")
            if ready.isEmpty():
                return settled(now, F.lit(True))
            now = fill(now, ready)
        raise RuntimeError("more waves than max_waves")
    leaf = goal_leaves(nodes, edges)
    now = fill(nodes, leaf.where(unset))
    if mode == "goal_leaves_product":
        return settled(contracted(now, edges, RULES["product"]), goal)
    if mode == "product_interp_verbalized":
        now = fill(now, now.where(goal).join(leaf.select("gid", "id"), ["gid", "id"], "left_anti"))
        return product_interpolated(now, edges)
    if prior is None:
        raise ValueError("the prior is missing")
    return product_interpolated(now, edges, prior)


# Likelihood of a leaf's confidence class given that the claim is false, and true. The
# classes are cut at .2, .4, .7 and .9; a value on a cut belongs to the upper class.
CUTS = (0.2, 0.4, 0.7, 0.9)
GIVEN_FALSE = (0.30, 0.10, 0.15, 0.13, 0.32)
GIVEN_TRUE = (0.12, 0.05, 0.10, 0.08, 0.65)


def leaf_likelihood(confidence: Column, version: int) -> tuple[Column, Column]:
    """(given false, given true): version 1 takes the confidence itself, version 2 its class."""
    if version == 1:
        return 1 - confidence, confidence

    def pick(values: tuple[float, ...]) -> Column:
        out = F.when(confidence < CUTS[0], values[0])
        for cut_at, v in zip(CUTS[1:], values[1:-1], strict=True):
            out = out.when(confidence < cut_at, v)
        return out.otherwise(values[-1])

    return pick(GIVEN_FALSE), pick(GIVEN_TRUE)


def _all_true(p: Columns) -> Column:
    return F.when(p["zeros"] > 0, 0.0).otherwise(F.exp(p["logs"]))


def _conjunction(p: Columns) -> Column:
    all_true = _all_true(p)
    return F.when(p["equal"], p["only"]).otherwise(all_true / (all_true + (1 - all_true) / _others(p["k"])))


def _others(k: Column) -> Column:
    """Child states besides the one in which all hold."""
    return F.pow(F.lit(2.0), k) - 1


def _given_one(p: Columns) -> list[Column]:
    """The message as a matrix over (true, false) of the one child that is open."""
    rest, n = _all_true(p), _others(p["k"])
    return [F.when(p["equal"], same).otherwise(x) for same, x in ((1.0, rest), (0.0, F.lit(0.0)), (0.0, (1 - rest) / n), (1.0, 1 / n))]


UPWARD = Rule(RULES["product"].parts | {"only": (lambda x: x, "max", 0.0)}, _conjunction, _given_one, MATRIX, ("equal",))


def belief_propagation(nodes: DataFrame, edges: DataFrame, version: int = 1) -> DataFrame:
    """``nodes`` with every goal's confidence replaced by its marginal in the tree.

    A decomposition with k children is a conjunction whose other 2^k - 1 child states are equally
    likely when the parent is false; a particularization is an equality. Messages are kept
    normalised, so a parent's message is a function of the product of its children's and a child's of
    that product without the child: sums of logs and a count of zeros, never a list of siblings. Both
    are matrices over true and false, which compose, so messages go up and down in rounds that grow
    with the logarithm of the size. The root's prior is one half. Trees are taken as valid; see
    ``tree_errors``.
    """
    with Scratch(nodes.sparkSession) as scratch:
        inner = scratch.cut(goal_edges(nodes, edges).select("gid", "source", "target", "relationship_type"), "bp-edges")
        given_false, given_true = leaf_likelihood(F.col("confidence"), version)
        leaf = _leaves_of(nodes, inner).select("gid", "id", require(F.col("confidence") >= 0, "a leaf has no confidence", given_true / (given_true + given_false)).alias("value"))
        leaf = scratch.cut(leaf, "bp-leaves")
        kinds = inner.groupBy("gid", F.col("target").alias("id")).agg(F.max(F.col("relationship_type") == "particularizes").alias("equal"))
        up = leaf.unionByName(evaluate(kinds, inner, leaf, UPWARD, keep=scratch.cut)).withColumnRenamed("value", "up")
        sums = scratch.cut(inner.join(up.select("gid", F.col("id").alias("source"), F.col("up")), ["gid", "source"]), "bp-links")
        zero = F.col("up") <= 0
        per_parent = sums.groupBy("gid", "target").agg(F.count(F.lit(1)).alias("k"), F.count_if(zero).alias("zeros"), F.coalesce(F.sum(F.when(~zero, F.log("up"))), F.lit(0.0)).alias("logs"))
        others_zero = F.col("zeros") - zero.cast("int") > 0
        without = F.when(others_zero, 0.0).otherwise(F.exp(F.col("logs") - F.when(zero, 0.0).otherwise(F.log("up"))))
        equal, n = F.col("relationship_type") == "particularizes", _others(F.col("k"))
        down = F.array(*[F.when(equal, same).otherwise(x) for same, x in ((1.0, without), (0.0, (1 - without) / n), (0.0, F.lit(0.0)), (1.0, 1 / n))])
        links = sums.join(per_parent, ["gid", "target"]).select("gid", F.col("source").alias("id"), F.col("target").alias("above"), down.alias("f"))
        tops = up.join(inner.select("gid", F.col("source").alias("id")), ["gid", "id"], "left_anti").select("gid", "id", F.lit(0.5).alias("value"))
        down = along_ancestors(tops, links, MATRIX, keep=scratch.cut).withColumnRenamed("value", "down")
        yes, no = F.col("down") * F.col("up"), (1 - F.col("down")) * (1 - F.col("up"))
        marginal = up.join(down, ["gid", "id"]).select("gid", "id", F.when(yes + no > 0, yes / (yes + no)).otherwise(F.lit(float("nan"))).alias("_new"))
        marginal = cut(marginal, "bp-marginals")
    return _renewed(nodes, marginal)


def tree_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, id, error) of what a belief-propagation tree must not have: several parents, several or
    no roots, mixed relations under a parent, a particularization with more than one child."""
    inner = goal_edges(nodes, edges)
    parents = inner.groupBy("gid", F.col("source").alias("id")).count().where("count > 1").select("gid", "id", F.lit("several parents").alias("error"))
    mixed = inner.groupBy("gid", F.col("target").alias("id")).agg(F.countDistinct("relationship_type").alias("r"), F.count(F.lit(1)).alias("k"), F.max("relationship_type").alias("label"))
    relations = mixed.where("r > 1").select("gid", "id", F.lit("mixed relations").alias("error"))
    single = mixed.where("r = 1 and label = 'particularizes' and k > 1").select("gid", "id", F.lit("particularization with several children").alias("error"))
    goals = nodes.where(F.col("kind") == GOAL)
    tops = goals.join(inner.select("gid", F.col("source").alias("id")), ["gid", "id"], "left_anti").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    graphs = goals.select("gid").distinct().join(tops, "gid", "left")
    root = graphs.where("coalesce(n, 0) <> 1").select("gid", "id", F.when(F.col("n").isNull(), "no root").otherwise("several roots").alias("error"))
    return parents.unionByName(relations).unionByName(single).unionByName(root)
