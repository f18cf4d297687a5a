"""Claim graphs as node and edge tables: leaves, levels, closures and statistics.

``nodes``: gid, id, kind, confidence (-1: unset), ... ``edges``: gid, source (child), target (parent),
relationship_type, pos. Graphs are told apart by ``gid``; levels are found for all graphs at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from verity.operators.contract import CLAMPED, FAR, Rule, evaluate, follow, gather, plain
from verity.operators.reports import nearest_percentile
from verity.plans.tables import Scratch, cut, cut_counted

GOAL, EVIDENCE = "GSNGoalNode", "EvidenceNodeV2"
# The relation labels of goal edges and of evidence edges with what they mean, the name
# of the root, and the optional fields of a rendered node.
GOAL_RELATIONS = {
    "decomposes_from": "is a conjunct in a decomposition of the target goal",
    "particularizes": "restates the target goal concretely for the specific task context",
}
EVIDENCE_RELATIONS = {
    "proves": "establishes the target claim as true beyond reasonable doubt",
    "supports": "increases confidence in the target claim",
    "refutes": "establishes the target claim as false beyond reasonable doubt",
    "undermines": "decreases confidence in the target claim",
    "unverified": "identifies missing verification or evidence, without indicating falsehood",
}
ROOT_NAME = "Agent's Overall Task"
NODE_FIELDS = {GOAL: ["reasoning"], EVIDENCE: ["step_numbers", "contribution"]}


def relation_meanings(labels: list[str]) -> dict[str, str]:
    """Evidence labels, in the order given, with what they mean; an unknown label is an error."""
    return {label: EVIDENCE_RELATIONS[label] for label in labels}


def checked_node_fields(fields: dict[str, list[str]]) -> dict[str, list[str]]:
    """Optional fields to render by kind of node: known ones, each once; core fields are always there."""
    for kind, names in fields.items():
        if len(set(names)) != len(names) or not set(names) <= set(NODE_FIELDS[kind]):
            raise ValueError(f"fields of {kind}: {names}; each at most once of {NODE_FIELDS[kind]}")
    return fields


def goal_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a goal at both ends."""
    goals = nodes.where(F.col("kind") == GOAL).select("gid", "id")
    return edges.join(goals.withColumnRenamed("id", "source"), ["gid", "source"], "left_semi").join(goals.withColumnRenamed("id", "target"), ["gid", "target"], "left_semi")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge of any kind."""
    return nodes.join(edges.select("gid", F.col("target").alias("id")), ["gid", "id"], "left_anti")


def goal_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Goals without an incoming edge from a goal; evidence does not count."""
    inner = goal_edges(nodes, edges).select("gid", F.col("target").alias("id"))
    return nodes.where(F.col("kind") == GOAL).join(inner, ["gid", "id"], "left_anti")


def confidence_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without confidence whose sources all have one; without sources that is so."""
    have = nodes.select("gid", F.col("id").alias("source"), (F.col("confidence") >= 0).alias("_set"))
    waiting = edges.join(have, ["gid", "source"]).where("not _set").select("gid", F.col("target").alias("id"))
    return nodes.where(F.col("confidence") < 0).join(waiting, ["gid", "id"], "left_anti")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("gid", "id")
    known = edges.join(ids.withColumnRenamed("id", "source"), ["gid", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["gid", "target"], "left_semi")
    return edges.exceptAll(known.select(edges.columns))


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("gid", "id").count().where("count > 1")


def roots(nodes: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(gid, root): the id that is given (``named``: gid, root), else the one goal called ROOT_NAME."""
    by_name = nodes.where((F.col("kind") == GOAL) & (F.col("goal_name") == ROOT_NAME)).groupBy("gid").agg(F.min("id").alias("_by_name"), F.count(F.lit(1)).alias("_n")) if "goal_name" in nodes.columns else None
    if by_name is None:
        return named
    unique = by_name.where("_n = 1").select("gid", "_by_name")
    if named is None:
        return unique.withColumnRenamed("_by_name", "root")
    return named.join(unique, "gid", "full").select("gid", F.coalesce("root", "_by_name").alias("root"))


def top_goals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Goals without an outgoing edge to a goal."""
    out = goal_edges(nodes, edges).select("gid", F.col("source").alias("id"))
    return nodes.where(F.col("kind") == GOAL).join(out, ["gid", "id"], "left_anti")


def bfs_levels(start: DataFrame, links: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """(gid, origin, id, depth) of all that ``start`` (gid, origin, id) reaches over ``links`` (gid,
    here, there); the first visit sets the depth. Levels and seen nodes are written between rounds."""
    level, n = cut_counted(start.select("gid", "origin", "id").distinct().withColumn("depth", F.lit(0)), "bfs")
    seen = level
    for depth in range(1, max_levels):
        step = level.select("gid", "origin", F.col("id").alias("here")).join(links, ["gid", "here"]).select("gid", "origin", F.col("there").alias("id")).distinct()
        level, n = cut_counted(step.join(seen.select("gid", "origin", "id"), ["gid", "origin", "id"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if not n:
            return seen
        seen = seen.unionByName(level)
    raise RuntimeError("more levels than max_levels")


def predecessor_levels(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels from target nodes (gid, id) down over incoming edges."""
    links = edges.select("gid", F.col("target").alias("here"), F.col("source").alias("there"))
    return bfs_levels(targets.select("gid", F.col("id").alias("origin"), "id"), links)


def _not_told(targets: DataFrame, told: DataFrame) -> DataFrame:
    """Targets above a cycle, for which levels are walked one by one."""
    return targets.select("gid", "id").join(told.select("gid", "id"), ["gid", "id"], "left_anti")


def max_cited_step(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, id, max_step): the greatest step number cited in a node's closure; -1 without one.

    The greatest step is carried up the edges once for all nodes, in rounds that grow with the logarithm
    of the depth; only above cycles are closures walked.
    """
    greatest = Rule({"most": (lambda x: x, "max", -FAR)}, lambda p: F.greatest(p["most"], p["value"]), lambda p: plain(F.lit(1.0), F.lit(0.0), low=F.greatest(p["most"], p["value"])), CLAMPED, ("value",))
    with Scratch(nodes.sparkSession) as scratch:
        own = nodes.select("gid", "id", F.coalesce(F.array_max("step_numbers").cast("double"), F.lit(-1.0)).alias("value"))
        bare = scratch.cut(own.join(edges.select("gid", F.col("target").alias("id")), ["gid", "id"], "left_anti"), "cited-bare")
        values = evaluate(own, edges, bare, greatest, keep=scratch.cut)
        told = targets.select("gid", "id").join(bare.unionByName(values), ["gid", "id"], "left")
        told, counts = scratch.cut_counted(told, "cited-told", lost=F.col("value").isNull().cast("int"))
        most = F.coalesce(F.col("value").cast("int"), F.lit(-1)).alias("max_step")
        if not counts["lost"]:
            return cut(told.select("gid", "id", most), "cited-most")
        cited = nodes.select("gid", "id", F.explode("step_numbers").alias("step"))
        walked = predecessor_levels(told.where("value is null").select("gid", "id").distinct(), edges).join(cited, ["gid", "id"]).groupBy("gid", F.col("origin").alias("id")).agg(F.max("step").cast("double").alias("_walked"))
        return cut(told.join(walked, ["gid", "id"], "left").select("gid", "id", F.coalesce("value", "_walked").alias("value")).select("gid", "id", most), "cited-most")


@F.pandas_udf(ArrayType(IntegerType()))
def _set_bits(bits: pd.Series) -> pd.Series:
    return bits.map(lambda own: np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8), bitorder="little")))


def cited_steps(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, id, steps): the sorted set of step numbers cited in a node's closure.

    Sets are bitmaps, united up the edges for all nodes at once (``contract.gather``); steps are whole
    numbers from 0. Only above cycles are closures walked.
    """
    cited = nodes.select("gid", "id", F.explode("step_numbers").alias("step"))
    at = F.col("step") + 1  # Spark's buckets begin at 1
    own = cited.groupBy("gid", "id", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bitmaps, told = gather(own, edges)
    wanted = bitmaps.join(targets.select("gid", "id").distinct(), ["gid", "id"])
    steps = F.transform(_set_bits("bits"), lambda bit: (bit + (F.col("bucket") - 1) * 32768).cast("int"))
    sets = wanted.select("gid", "id", "bucket", steps.alias("own")).groupBy("gid", "id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "own"))), lambda x: x["own"])).alias("steps"))
    alone = nodes.select("gid", "id").join(edges.select("gid", F.col("source").alias("id")).unionByName(edges.select("gid", F.col("target").alias("id"))), ["gid", "id"], "left_anti")
    lost = _not_told(targets, told.unionByName(alone))
    walked = predecessor_levels(lost, edges).join(cited, ["gid", "id"]).select("gid", "origin", "step").distinct()
    walked = walked.groupBy("gid", F.col("origin").alias("id")).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return targets.select("gid", "id").join(sets.unionByName(walked), ["gid", "id"], "left").select("gid", "id", F.coalesce("steps", F.array().cast("array<int>")).alias("steps"))


#: No step: greater than all.
_NO_STEP = 2**31 - 1


def cited_summary(targets: DataFrame, nodes: DataFrame, edges: DataFrame, first: int = 5) -> DataFrame:
    """(gid, id, n, total, first_steps): number, sum and the ``first`` smallest of the different steps cited
    in a node's closure, without its set.

    Graphs in which every node has one parent at most are cut in paths (each node and its child with most
    nodes below). On a path a step counts from the place where it is first met; a step of a path is one of
    the parent of the path's top, over at most as many paths as the logarithm of the nodes. Running sums
    along the paths give the rest. Other graphs, and nodes above cycles, take ``cited_steps``.
    """
    with Scratch(nodes.sparkSession) as scratch:
        links = scratch.cut(edges.select("gid", "source", "target").dropna().distinct(), "cited-links")
        shared = scratch.cut(links.groupBy("gid", F.col("source").alias("id")).count().where("count > 1").select("gid").distinct(), "cited-shared")
        links = links.join(shared, "gid", "left_anti")
        ids = links.select("gid", F.col("target").alias("id")).unionByName(links.select("gid", F.col("source").alias("id"))).unionByName(nodes.select("gid", "id").join(shared, "gid", "left_anti")).distinct()
        bare = scratch.cut(ids.join(links.select("gid", F.col("target").alias("id")), ["gid", "id"], "left_anti").withColumn("value", F.lit(1.0)), "cited-bare")
        below = Rule({"all": (lambda x: x, "sum", 0.0)}, lambda p: p["all"] + 1, lambda p: plain(F.lit(1.0), p["all"] + 1), CLAMPED)
        sizes = bare.unionByName(evaluate(bare.select("gid", "id"), links, bare, below, keep=scratch.cut))
        sized = links.join(sizes.select("gid", F.col("id").alias("source"), "value"), ["gid", "source"])
        # nodes above a cycle have no size and are left out; so are edges into them
        chosen = sized.groupBy("gid", F.col("target").alias("id")).agg(F.max(F.struct("value", "source")).alias("most")).join(sizes.select("gid", "id"), ["gid", "id"], "left_semi")
        one_more = F.array(*plain(F.lit(1.0), F.lit(1.0)))
        rows, counts = scratch.cut_counted(chosen.select("gid", "id", F.col("most.source").alias("at"), one_more.alias("f")), "cited-rows", n=F.lit(1))
        followed = follow(rows, counts["n"], CLAMPED, scratch).select("gid", "id", F.col("end").alias("path"), F.col("f")[1].cast("long").alias("pos"))
        placed = scratch.cut(followed.unionByName(bare.select("gid", "id", F.col("id").alias("path"), F.lit(0).cast("long").alias("pos"))), "cited-placed")
        # the top of each path, and where the node above it is
        up = links.select("gid", F.col("source").alias("id"), F.col("target").alias("above")).join(rows.select("gid", F.col("at").alias("id"), F.col("id").alias("above")), ["gid", "id", "above"], "left_anti")
        up = up.join(placed.select("gid", "id", "path"), ["gid", "id"]).join(placed.select("gid", F.col("id").alias("above"), F.col("path").alias("to"), F.col("pos").alias("at")), ["gid", "above"])
        up = scratch.cut(up.select("gid", "path", "to", "at"), "cited-up")
        cited = nodes.select("gid", "id", F.explode("step_numbers").alias("step")).distinct().join(placed, ["gid", "id"])
        level, counts = scratch.cut_counted(cited.groupBy("gid", "path", "step").agg(F.min("pos").alias("pos")), "cited-level", n=F.lit(1))
        met = level
        while counts["n"]:
            moved = level.select("gid", "path", "step").join(up, ["gid", "path"]).groupBy("gid", F.col("to").alias("path"), "step").agg(F.min("at").alias("pos"))
            # a step that the path had already handed up goes no further, but may be met earlier on the path
            moved = moved.join(met.select("gid", "path", "step", F.col("pos").alias("_had")), ["gid", "path", "step"], "left")
            moved = scratch.cut(moved, "cited-moved")
            met = scratch.cut(met.unionByName(moved.drop("_had")).groupBy("gid", "path", "step").agg(F.min("pos").alias("pos")), "cited-met")
            level, counts = scratch.cut_counted(moved.where("_had is null").drop("_had"), "cited-level", n=F.lit(1))
        events = met.select("gid", "path", "pos", F.lit(0).alias("kind"), F.col("step").cast("int").alias("step"), F.lit(None).cast("string").alias("id"))
        events = events.unionByName(placed.select("gid", "path", "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("step"), "id"))
        told = scratch.cut(_summed(events, first, scratch), "cited-summary")
        wanted = targets.select("gid", "id").join(told, ["gid", "id"], "left")
        wanted, counts = scratch.cut_counted(wanted, "cited-wanted", lost=F.col("n").isNull().cast("int"))
        columns = ["gid", "id", "n", "total", "first_steps"]
        if not counts["lost"]:
            return cut(wanted.select(*columns), "cited-summaries")
        lost = wanted.where("n is null").select("gid", "id")
        sets = cited_steps(lost, *[df.join(lost.select("gid").distinct(), "gid", "left_semi") for df in (nodes, edges)])
        whole = sets.select("gid", "id", F.size("steps").cast("long").alias("n"), F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.slice("steps", 1, first).alias("first_steps"))
        return cut(wanted.where("n is not null").select(*columns).unionByName(whole), "cited-summaries")


def _summed(events: DataFrame, first: int, scratch: Scratch) -> DataFrame:
    """(gid, id, n, total, first_steps) along the paths of ``events`` (gid, path, pos, kind: 0 a step, 1 a
    node). Rows are dealt by ranges, summed within each, and moved by what the ranges before hold, so no
    task holds a path. The smallest steps are sorted in by ``first`` running minima: each hands on the
    greater of the new step and the one that it displaces."""
    by = ["gid", "path", "pos", "kind"]
    rows = scratch.cut(events.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "cited-events")
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_s0", F.coalesce("step", F.lit(_NO_STEP)))
    inside = Window.partitionBy("gid", "path", "_part").orderBy("_at")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count("step").over(running)).withColumn("_total", F.coalesce(F.sum("step").over(running), F.lit(0).cast("long")))

    def least(df: DataFrame, order, upto, name: str) -> DataFrame:
        for i in range(first):
            df = df.withColumn(f"{name}{i}", F.min(f"_s{i}").over(upto))
            if i + 1 < first:
                df = df.withColumn(f"_s{i + 1}", F.greatest(f"_s{i}", F.coalesce(F.lag(f"{name}{i}").over(order), F.lit(_NO_STEP))))
        return df

    rows = scratch.cut(least(rows, inside, running, "_m").select("gid", "path", "kind", "id", "_at", "_part", "_n", "_total", *[f"_m{i}" for i in range(first)]), "cited-running")
    parts = rows.groupBy("gid", "path", "_part").agg(F.max("_n").alias("_n"), F.max("_total").alias("_total"), *[F.min(f"_m{i}").alias(f"_m{i}") for i in range(first)])
    # as many rows as ranges have paths; only paths over several ranges have something before
    several = parts.groupBy("gid", "path").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    several = scratch.cut(parts.join(several, ["gid", "path"], "left_semi"), "cited-parts")
    before = Window.partitionBy("gid", "path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = F.slice(F.array_sort(F.flatten(F.collect_list(F.array(*[f"_m{i}" for i in range(first)])).over(before))), 1, first)
    held = several.select("gid", "path", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pn"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_pt"), held.alias("_pm"))
    found = rows.where("kind = 1").join(held, ["gid", "path", "_part"], "left")
    own = F.array(*[f"_m{i}" for i in range(first)])
    smallest = F.slice(F.array_sort(F.filter(F.concat(own, F.coalesce("_pm", F.array().cast("array<int>"))), lambda s: s < _NO_STEP)), 1, first)
    return found.select("gid", "id", (F.col("_n") + F.coalesce("_pn", F.lit(0))).alias("n"), (F.col("_total") + F.coalesce("_pt", F.lit(0))).alias("total"), smallest.alias("first_steps"))


def node_depths(nodes: DataFrame, edges: DataFrame, root: DataFrame, strict: bool = True) -> DataFrame:
    """(gid, id, depth): shortest distance from the root (gid, root), edges taken both ways. A node that
    is not reached is an error, or (not ``strict``) absent; see ``unreachable``."""
    found = _distances(edges, root)
    if not strict:
        return found
    lost = F.raise_error(F.concat(F.lit("not reached from the root of graph "), F.col("gid").cast("string"), F.lit(": "), F.col("id"))).cast("int")
    return nodes.select("gid", "id").join(found, ["gid", "id"], "left").select("gid", "id", F.coalesce("depth", lost).alias("depth"))


def _distances(edges: DataFrame, root: DataFrame) -> DataFrame:
    ways = edges.select("gid", F.col("source").alias("here"), F.col("target").alias("there"))
    both = ways.unionByName(ways.select("gid", F.col("there").alias("here"), F.col("here").alias("there")))
    return bfs_levels(root.select("gid", F.col("root").alias("origin"), F.col("root").alias("id")), both).select("gid", "id", "depth")


def unreachable(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    return nodes.join(depths, ["gid", "id"], "left_anti")


def layers(depths: DataFrame) -> DataFrame:
    """Depth 0, 1, 2 and all that is deeper as 3."""
    return depths.withColumn("layer", F.least("depth", F.lit(3)))


def graph_stats(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    """One row per graph: counts of nodes, goals, evidence, edges and goal leaves, mean confidences
    (NaN where none is set), the greatest depth over goals (of the graph of goals alone), and counts and
    means by layer over all nodes. A node that is not reached from the root is an error."""
    mean = lambda c: F.coalesce(F.avg(F.expr(f"nullif({c}, -1D)")), F.lit(float("nan")))
    # both graphs are walked at once, told apart by a part of their key
    scoped = lambda df, goals, *columns: df.select(F.struct("gid", F.lit(goals).alias("goals")).alias("gid"), *columns)
    ends = lambda goals, e: scoped(e, goals, "source", "target")
    found = _distances(ends(False, edges).unionByName(ends(True, goal_edges(nodes, edges))), scoped(root, False, "root").unionByName(scoped(root, True, "root")))
    wanted = scoped(nodes, False, "id", "confidence").unionByName(scoped(nodes.where(F.col("kind") == GOAL), True, "id", "confidence"))
    lost = F.raise_error(F.concat(F.lit("not reached from the root of graph "), F.col("gid.gid").cast("string"), F.lit(": "), F.col("id"))).cast("int")
    placed = layers(wanted.join(found, ["gid", "id"], "left").select(F.col("gid.gid").alias("gid"), F.col("gid.goals").alias("goals"), "confidence", F.coalesce("depth", lost).alias("depth")))
    per_node = nodes.groupBy("gid").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == GOAL).alias("goals"), F.count_if(F.col("kind") == EVIDENCE).alias("evidence"), mean("confidence").alias("confidence"))
    per_edge = edges.groupBy("gid").agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("relationship_type") == r).alias(r) for r in (*GOAL_RELATIONS, *EVIDENCE_RELATIONS)])
    per_leaf = goal_leaves(nodes, edges).groupBy("gid").agg(F.count(F.lit(1)).alias("goal_leaves"), mean("confidence").alias("goal_leaves_conf"))
    at = lambda k: ~F.col("goals") & (F.col("layer") == k)
    per_layer = placed.groupBy("gid").agg(
        F.max(F.when(F.col("goals"), F.col("depth"))).alias("max_depth"),
        *[F.count_if(at(k)).alias(f"layer_{k}") for k in range(4)],
        *[F.coalesce(F.avg(F.nullif(F.when(at(k), F.col("confidence")), F.lit(-1.0))), F.lit(float("nan"))).alias(f"layer_{k}_conf") for k in range(4)],
    )
    out = per_node.join(per_edge, "gid", "left").join(per_leaf, "gid", "left").join(per_layer, "gid", "left")
    return out.fillna(0, [c for c in out.columns if c != "gid" and not c.endswith("conf") and c != "confidence"])


def stats_summary(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means of every statistic (NaN left out, a missing one is 0), the greatest depth and its 95th
    percentile (nearest rank)."""
    keys = keys or []
    names = [c for c in stats.columns if c not in ("gid", *keys)]
    means = stats.groupBy(*keys).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"mean_{c}") for c in names], F.max("max_depth").alias("max_max_depth"))
    p95 = nearest_percentile(stats, keys, "max_depth", 0.95, "p95_depth")
    return means.join(p95, keys) if keys else means.crossJoin(p95)  # one row each


def predecessor_contexts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, id, predecessors): direct incoming (node, relation) in edge order."""
    who = edges.groupBy("gid", F.col("target").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("source").alias("node"), F.col("relationship_type").alias("relation")))).alias("p"))
    plain = F.transform("p", lambda x: F.struct(x["node"].alias("node"), x["relation"].alias("relation")))
    return nodes.select("gid", "id").join(who, ["gid", "id"], "left").select("gid", "id", plain.alias("predecessors"))


def render_compact(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    """(gid, text): node, claim and parents level by level from the root, blocks joined by a blank
    line. Goals go by their name, evidence by its id. A level is in the order of its first links: by
    the place of the parent, then of the edge. Graphs with nodes that are not reached are an error."""
    start = root.select("gid", F.col("root").alias("id"), F.array(F.lit(0).cast("long")).alias("at"))
    level, seen, depth = cut(start, "render-level"), None, 0
    while not level.isEmpty():
        placed = level.withColumn("depth", F.lit(depth))
        seen = placed if seen is None else seen.unionByName(placed)
        step = level.select("gid", F.col("id").alias("target"), "at").join(edges, ["gid", "target"])
        reached = step.groupBy("gid", F.col("source").alias("id")).agg(F.min(F.concat("at", F.array(F.col("pos").cast("long")))).alias("at"))
        level, depth = cut(reached.join(seen.select("gid", "id"), ["gid", "id"], "left_anti"), "render-level"), depth + 1
    name = F.when(F.col("kind") == GOAL, F.col("goal_name")).otherwise(F.col("id"))
    named = nodes.withColumn("_name", name)
    above = edges.join(named.select("gid", F.col("id").alias("target"), "_name"), ["gid", "target"]).groupBy("gid", F.col("source").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_name"))), lambda x: x["_name"]), ", ").alias("parents"))
    rows = named.join(seen if seen is not None else start.withColumn("depth", F.lit(0)), ["gid", "id"], "left").join(above, ["gid", "id"], "left")
    block = F.concat(F.lit("Node: "), F.col("_name"), F.lit("\nClaim: "), F.coalesce("auditable_claim", F.lit("<no claim>")), F.lit("\nParents: "), F.coalesce("parents", F.lit("None")))
    lost = F.when(F.col("depth").isNull(), F.raise_error(F.lit("a node is not reached from the root")).cast("int")).otherwise(F.col("depth"))
    listed = rows.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct(lost.alias("depth"), "at", "id", block.alias("block")))).alias("b"))
    return listed.select("gid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("text"))


def render_nested(nodes: DataFrame, edges: DataFrame, root: DataFrame, fields: dict[str, list[str]] | None = None, max_depth: int = 1000) -> DataFrame:
    """(gid, text): an indented outline from the root goal, sub-goals before evidence, without ids.

    Nodes are found path by path, a node under several parents once under each, and every path knows
    its place among its siblings; the outline is the paths in order. Cycles, nodes that are not
    reached and edges whose label does not fit their ends are errors.
    """
    fields = checked_node_fields(NODE_FIELDS if fields is None else fields)
    kinds = nodes.select("gid", "id", "kind")
    ends = edges.join(kinds.withColumnRenamed("id", "source"), ["gid", "source"]).join(kinds.select("gid", F.col("id").alias("target"), F.col("kind").alias("_above")), ["gid", "target"])
    section = F.when(F.col("kind") == GOAL, 0).otherwise(1)
    fits = (F.col("_above") == GOAL) & F.when(F.col("kind") == GOAL, F.col("relationship_type").isin(*GOAL_RELATIONS)).otherwise(F.col("relationship_type").isin(*EVIDENCE_RELATIONS))
    checked = F.when(F.coalesce(fits, F.lit(False)), section).otherwise(F.raise_error(F.lit("the label of an edge does not fit its ends")).cast("int"))
    order = Window.partitionBy("gid", "target", "section").orderBy("pos", "source")
    links = ends.withColumn("section", checked)
    links = cut(links.select("gid", "target", "source", "relationship_type", "section", (F.row_number().over(order) - 1).alias("rank")), "nested-links")
    step = F.struct("section", "rank")
    level = cut(root.select("gid", F.col("root").alias("id"), F.array().cast("array<struct<section:int,rank:int>>").alias("at"), F.array(F.col("root")).alias("path"), F.lit(None).cast("string").alias("relation")), "nested-level")
    seen = level
    for _ in range(max_depth):
        below = level.withColumnRenamed("id", "target").join(links, ["gid", "target"])
        no_cycle = F.when(~F.array_contains("path", F.col("source")), F.col("source")).otherwise(F.raise_error(F.lit("the graph has a cycle")).cast("string"))
        level = cut(below.select("gid", no_cycle.alias("id"), F.concat("at", F.array(step)).alias("at"), F.concat("path", F.array("source")).alias("path"), F.col("relationship_type").alias("relation")), "nested-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    else:
        raise ValueError("the graph has a cycle or is deeper than max_depth")
    rows = nodes.join(seen, ["gid", "id"], "left")
    goal = F.col("kind") == GOAL
    reached = F.when(F.col("at").isNotNull(), F.size("at")).otherwise(F.raise_error(F.lit("a node is not reached from the root")).cast("int"))
    indent, inner = F.repeat(F.lit(" "), 4 * F.col("_d")), F.repeat(F.lit(" "), 4 * F.col("_d") + 2)

    def line(label: str, value: Column) -> Column:
        shown = F.when(F.coalesce(value, F.lit("None")) == "", F.lit("(empty)")).otherwise(F.coalesce(value, F.lit("None")))
        return F.concat(inner, F.lit(f"{label}: "), F.replace(shown, F.lit("\n"), F.concat(F.lit("\n"), inner, F.lit("  "))))

    def extra(kind: str, name: str) -> Column:
        value = F.array_join(F.col(name).cast("array<string>"), ", ") if name == "step_numbers" else F.col(name)
        return F.when(F.col("kind") == kind, line(name.replace("_", " ").title(), value))

    last = F.element_at("at", -1)
    first_here = F.when((F.col("_d") > 0) & (last["rank"] == 0), F.concat(F.repeat(F.lit(" "), 4 * F.col("_d") - 2), F.when(last["section"] == 0, "SUBGOALS").otherwise("EVIDENCE")))
    link = F.when(F.col("_d") > 0, F.concat(F.repeat(F.lit(" "), 4 * F.col("_d") - 2), F.lit("- Connection: "), F.col("relation")))
    heading = F.concat(indent, F.when(F.col("_d") == 0, "ROOT GOAL").when(goal, "GOAL").otherwise("EVIDENCE"))
    name = F.when(goal, F.col("goal_name")).otherwise(F.col("evidence"))
    block = F.concat_ws("\n", first_here, link, heading, line("Name", name), line("Claim", F.col("auditable_claim")), *[extra(kind, n) for kind, names in fields.items() for n in names])
    told = rows.withColumn("_d", reached).withColumn("_block", block)
    listed = told.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("at", "_block"))).alias("b"))
    return listed.select("gid", F.array_join(F.transform("b", lambda x: x["_block"]), "\n").alias("text"))


def first_child_rank(edges: DataFrame) -> DataFrame:
    """Edges with the child's place under its parent, in edge order."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("gid", "target").orderBy("pos", "source")))
