"""Claim graphs built from recorded strategy and evidence actions, for all graphs at once.

A goal takes one strategy and names are unique in a graph, so a log of actions needs no replay in
order: the children of all actions are the new nodes, and what an order would have refused is found
by joins. Each function has a companion that lists the errors; with errors the result is undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.operators.graphs import EVIDENCE, EVIDENCE_RELATIONS, GOAL, goal_edges, leaves

DIVIDE, PARTICULARIZE = "divide_and_conquer", "particularize"
#: Columns of a log of strategy actions; ``weight`` is the parent's confidence in its children, if given.
ACTIONS = "gid, seq, kind, target, sub_goals array<struct<identifier, auditable_claim, reasoning>>, weight"


def _new_id(gid: Column, *parts: Column) -> Column:
    """An id that depends on the graph and the name alone, so a job that runs again gives it again."""
    return F.sha2(F.concat_ws("\x1f", gid.cast("string"), *parts), 256)


def _filled(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, null where ``df`` lacks one."""
    kinds = {f.name: f.dataType for f in like.schema.fields}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in like.columns])


def _children(actions: DataFrame) -> DataFrame:
    each = actions.select("gid", "seq", "kind", "target", F.posexplode("sub_goals").alias("place", "g"))
    return each.select("gid", "seq", "kind", "target", "place", F.col("g.identifier").alias("goal_name"), F.col("g.auditable_claim").alias("auditable_claim"), F.col("g.reasoning").alias("reasoning"))


def apply_actions(nodes: DataFrame, edges: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with every action's sub-goals under its target goal, which is found by name; a
    given ``weight`` becomes the target's ``confidence_in_children``. New ends come after the old ones,
    in the order of the actions."""
    kids = _children(actions).withColumn("id", _new_id(F.col("gid"), F.col("goal_name")))
    fresh = kids.withColumn("kind", F.lit(GOAL)).withColumn("confidence", F.lit(-1.0)).withColumn("confidence_in_children", F.lit(-1.0))
    all_nodes = nodes.unionByName(_filled(fresh, nodes))
    if "confidence_in_children" in nodes.columns:
        given = actions.where("weight is not null").select("gid", F.col("target").alias("goal_name"), F.col("weight").cast("double").alias("_w"))
        weighed = all_nodes.join(given, ["gid", "goal_name"], "left")
        all_nodes = weighed.select(*[F.coalesce("_w", c).alias(c) if c == "confidence_in_children" else F.col(c) for c in nodes.columns])
    named = all_nodes.where(F.col("kind") == GOAL).select("gid", F.col("goal_name").alias("target"), F.col("id").alias("_to"))
    last = edges.groupBy("gid").agg((F.max("pos") + 1).alias("_from"))
    order = Window.partitionBy("gid").orderBy("seq", "place")
    placed = kids.join(named, ["gid", "target"]).join(last, "gid", "left").withColumn("pos", F.row_number().over(order) - 1 + F.coalesce("_from", F.lit(0)))
    relation = F.when(F.col("kind") == DIVIDE, "decomposes_from").otherwise("particularizes")
    new = placed.select("gid", F.col("id").alias("source"), F.col("_to").alias("target"), relation.alias("relationship_type"), "pos")
    return all_nodes, edges.unionByName(_filled(new, edges))


def action_errors(nodes: DataFrame, edges: DataFrame, actions: DataFrame) -> DataFrame:
    """(gid, seq, error): unknown or ambiguous targets, targets that came later than the action, goals
    with more than one strategy, names used twice, and too few or too many sub-goals."""
    goals = nodes.where(F.col("kind") == GOAL).select("gid", "goal_name", F.lit(-1).cast("long").alias("since"))
    kids = _children(actions).select("gid", "goal_name", F.col("seq").cast("long").alias("since"))
    known = goals.unionByName(kids).groupBy("gid", F.col("goal_name").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.min("since").alias("since"))
    busy = goal_edges(nodes, edges).join(nodes.select("gid", F.col("id").alias("target"), F.col("goal_name")), ["gid", "target"]).select("gid", F.col("goal_name").alias("target")).distinct().withColumn("busy", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("gid", "target").orderBy("seq"))
    twice = known.where("n > 1").select("gid", F.col("target").alias("goal_name"), F.col("since").alias("first"))
    reused = _children(actions).join(twice, ["gid", "goal_name"]).groupBy("gid", "seq").agg(F.lit("a goal name is used twice").alias("error"))
    told = actions.withColumn("nth", nth).join(known, ["gid", "target"], "left").join(busy, ["gid", "target"], "left")
    size = F.size("sub_goals")
    found = F.array_compact(
        F.array(
            F.when(F.col("n").isNull() | (F.col("since") >= F.col("seq")), F.lit("no such target goal")),
            F.when(F.col("n") > 1, F.lit("several target goals of that name")),
            F.when((F.col("nth") > 1) | F.col("busy"), F.lit("the goal has more than one strategy")),
            F.when((F.col("kind") == DIVIDE) & (size < 2), F.lit("a decomposition has two sub-goals or more")),
            F.when((F.col("kind") == PARTICULARIZE) & (size != 1), F.lit("a particularization has one goal")),
        )
    )
    return told.select("gid", "seq", F.explode(found).alias("error")).unionByName(reused)


def apply_evidence(nodes: DataFrame, edges: DataFrame, catalog: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the evidence that links use, joined to the leaf goals that they name.

    ``catalog``: gid, evidence_key, evidence, step_numbers, auditable_claim, contribution; ``links``:
    gid, pos, evidence_key, target (a goal's name), relationship_type. Unused evidence is left out.
    """
    used = catalog.join(links.select("gid", "evidence_key"), ["gid", "evidence_key"], "left_semi")
    fresh = used.withColumn("id", _new_id(F.col("gid"), F.lit("evidence"), F.col("evidence_key"))).withColumn("kind", F.lit(EVIDENCE)).withColumn("confidence", F.lit(-1.0))
    goals = leaves(nodes, edges).where(F.col("kind") == GOAL).select("gid", F.col("goal_name").alias("target"), F.col("id").alias("_to"))
    ends = links.join(fresh.select("gid", "evidence_key", F.col("id").alias("source")), ["gid", "evidence_key"]).join(goals, ["gid", "target"])
    last = edges.groupBy("gid").agg((F.max("pos") + 1).alias("_from"))
    new = ends.join(last, "gid", "left").select("gid", "source", F.col("_to").alias("target"), "relationship_type", (F.col("pos") + F.coalesce("_from", F.lit(0))).alias("pos"))
    return nodes.unionByName(_filled(fresh, nodes)), edges.unionByName(_filled(new, edges))


def evidence_errors(nodes: DataFrame, edges: DataFrame, catalog: DataFrame, links: DataFrame, labels: tuple[str, ...] = EVIDENCE_RELATIONS) -> DataFrame:
    """(gid, item, error): keys used twice, links that repeat, unknown keys, goals or labels, and leaf
    goals of one name."""
    goals = leaves(nodes, edges).where(F.col("kind") == GOAL)
    named = goals.select("gid", F.col("goal_name").alias("target"))
    say = lambda df, item, error: df.select("gid", F.col(item).alias("item"), F.lit(error).alias("error"))
    parts = [
        say(catalog.groupBy("gid", "evidence_key").count().where("count > 1"), "evidence_key", "an evidence key is used twice"),
        say(links.groupBy("gid", "evidence_key", "target", "relationship_type").count().where("count > 1"), "evidence_key", "an evidence link repeats"),
        say(links.join(catalog.select("gid", "evidence_key"), ["gid", "evidence_key"], "left_anti"), "evidence_key", "unknown evidence key"),
        say(links.join(named, ["gid", "target"], "left_anti"), "target", "unknown target goal"),
        say(links.where(~F.col("relationship_type").isin(*labels)), "relationship_type", "a label that is not configured"),
        say(named.groupBy("gid", "target").count().where("count > 1"), "target", "several leaf goals of one name"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
