"""Hand-computed values for metrics, propagation, calibration, graphs, trajectories and text functions."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verity.functions import permute, scores, text
from verity.functions.summaries import observation_summary
from verity.operators import acp, audit, calibration, contract, graph_edit, graphs, metrics, propagate, quality, reports, trajectory
from verity.plans import runner, tables
from verity.sources import runs as sources

GOAL, EVIDENCE = graphs.GOAL, graphs.EVIDENCE


def results(spark, confidences, outcomes, run="r"):
    rows = [(run, str(i), "m", i, float(c), int(y)) for i, (c, y) in enumerate(zip(confidences, outcomes, strict=True))]
    return spark.createDataFrame(rows, "run string, instance_id string, model string, ord long, estimated_confidence double, resolved int")


def only(df, column=None):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column] if column else rows[0][-1]


def tree(spark, nodes, edges):
    n = spark.createDataFrame([("g", i, k, c, w) for i, k, c, w in nodes], "gid string, id string, kind string, confidence double, confidence_in_children double")
    e = spark.createDataFrame([("g", s, t, r, p) for p, (s, t, r) in enumerate(edges)], "gid string, source string, target string, relationship_type string, pos int")
    return n, e


def goals(**confidences):
    return [(k, GOAL, float(c), -1.0) for k, c in confidences.items()]


def under(parent, *children):
    return [(c, parent, "decomposes_from") for c in children]


def values(df):
    return {r["id"]: r["confidence"] for r in df.collect()}


# ---------------------------------------------------------------- metrics


def test_metric_goldens(spark):
    bundle = lambda c, y: only(metrics.run_metrics(results(spark, c, y)).select(F.struct("*").alias("x")))
    got = bundle([0.5, 0.5], [1, 0])
    assert got["beh_align_score"] == pytest.approx((0.5 + 0.5 + math.log(0.5)) / 2)
    got = bundle([0.8, 0.2], [1, 0])
    assert got["nll"] == pytest.approx(-math.log(0.8)) and got["brier_skill"] == pytest.approx(0.84)
    got = bundle([0.8, 0.7], [1, 1])
    assert math.isnan(got["brier_skill"]) and math.isnan(got["auroc"])
    assert bundle([0.2, 0.8], [0, 1])["adaptive_ece"] == pytest.approx(0.2)
    assert bundle([0.1, 0.9], [0, 1])["auroc"] == 1.0


@pytest.mark.parametrize(("outcomes", "want"), [([0, 1, 1], 5 / 18), ([1, 0, 1], 4 / 9)])
def test_accuracy_curve_breaks_ties_by_order(spark, outcomes, want):
    assert only(metrics.auarc(results(spark, [0.8, 0.8, 0.2], outcomes), ["run"])) == pytest.approx(want)


def test_accuracy_curve_of_one_row(spark):
    assert only(metrics.auarc(results(spark, [0.4], [1]), ["run"])) == 0.0


def test_binned_errors(spark):
    df = results(spark, [0.1, 0.2, 0.3, 0.9], [0, 1, 0, 1])
    assert only(metrics.adaptive_calibration_error(df, ["run"], 2)) == pytest.approx(0.225)
    assert only(metrics.expected_calibration_error(results(spark, [0, 0.5, 1], [1, 0, 1]), ["run"], 2)) == pytest.approx(0.5)
    edges = results(spark, [0.3, 0.6, 0.7], [1, 1, 1])
    by = {r["estimated_confidence"]: r["b"] for r in edges.select("estimated_confidence", scores.bin_index("estimated_confidence", 10).alias("b")).collect()}
    assert by == {0.3: 2, 0.6: 5, 0.7: 6}
    outside = results(spark, [0.5, 1.5], [1, 1])
    assert only(metrics.expected_calibration_error(outside, ["run"], 1)) == pytest.approx(0.25)


def test_sweep_and_selection(spark):
    df = results(spark, [0.1, 0.4, 0.6, 0.9], [0, 1, 0, 1])
    row = reports.ece_sweep(df, (2, 4)).first()
    assert row["ece_2"] == pytest.approx(0.25) and row["ece_4"] == pytest.approx((0.1 + 0.6 + 0.6 + 0.1) / 4)
    with pytest.raises(ValueError):
        reports.ece_sweep(df, (2, 2))
    assert only(metrics.selective_utility(df, ["run"], 0.5)) == pytest.approx((0 + 0 - 1 + 1) / 4)
    with pytest.raises(ValueError):
        metrics.selective_utility(df, ["run"], 1.0)


def test_shared_subset_min_n_and_usage(spark):
    both = results(spark, [0.1, 0.2, 0.3], [0, 1, 1], "a").unionByName(results(spark, [0.5, 0.6], [0, 1], "b"))
    assert sorted((r["run"], r["instance_id"]) for r in reports.shared_subset(both).collect()) == [("a", "0"), ("a", "1"), ("b", "0"), ("b", "1")]
    assert {r["run"] for r in reports.min_n(both, 3).collect()} == {"a"}
    usage = spark.createDataFrame([("a", "openai/qwen38-27b", 2_000_000.0, 1_000_000.0, None), ("b", "other", None, None, 0.0)], "run string, model string, mean_total_tokens double, mean_generated_tokens double, mean_cost double")
    priced = {r["run"]: r["mean_cost"] for r in reports.with_cost(usage, "model").collect()}
    assert priced["a"] == pytest.approx(2.689) and priced["b"] == 0.0
    shown = {r["run"]: tuple(r)[2:] for r in reports.usage_labels(reports.with_cost(usage, "model")).collect()}
    assert shown == {"a": ("2000.0K", "1000.0K", "$2.69"), "b": ("N/A", "N/A", "$0.00")}


def test_estimator_models(spark):
    rows = [('{"estimator": {"estimator_type": "oh_gsn", "graph_generator": {"agent": {"model_name": "g"}}}}',), ('{"estimator": {"estimator_type": "replay"}}',), ('{"estimator": {"estimator_type": "gsn_aggregate"}}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(reports.estimator_model(F.col("c"))).collect()]
    assert got == ["g", "replay", "N/A"]


def test_nearest_percentile(spark):
    df = spark.range(1, 14).withColumnRenamed("id", "v")
    assert only(reports.nearest_percentile(df, [], "v", 0.95, "p")) == 12
    assert only(reports.nearest_percentile(spark.range(1, 34).withColumnRenamed("id", "v"), [], "v", 0.95, "p")) == 31


# ---------------------------------------------------------------- propagation


def test_product_tree(spark):
    n, e = tree(spark, goals(a=0.1, b=0.2, c=0.3, d=0.9, e=0.8, f=0.5), [*under("a", "b", "c"), *under("c", "d", "e"), ("f", "b", "particularizes")])
    got = values(propagate.aggregate(n, e, "product"))
    assert got == pytest.approx({"a": 0.36, "b": 0.5, "c": 0.72, "d": 0.9, "e": 0.8, "f": 0.5})


def chain(spark, n):
    """Goals g0 (root) to g(n-1), each with a leaf of its own and the next goal below it."""
    rows = [("g", f"g{i}", GOAL, -1.0, 0.7) for i in range(n)] + [("g", f"l{i}", GOAL, 0.6 + (i * 37 % 40) / 100, -1.0) for i in range(n)]
    links = [("g", f"g{i + 1}", f"g{i}", "decomposes_from") for i in range(n - 1)] + [("g", f"l{i}", f"g{i}", "decomposes_from") for i in range(n)]
    return spark.createDataFrame(rows, "gid string, id string, kind string, confidence double, confidence_in_children double"), spark.createDataFrame(links, "gid string, source string, target string, relationship_type string"), [r[3] for r in rows[n:]]


def test_a_chain_of_ten_thousand_goals_in_few_rounds(spark):
    n = 10_000
    nodes, edges, leaf = chain(spark, n)
    known = nodes.where("confidence >= 0").select("gid", "id", F.col("confidence").alias("value"))
    got = {r["id"]: r["value"] for r in contract.evaluate(nodes, edges, known, contract.RULES["arithmetic_mean"], max_rounds=40).collect()}
    want, v = {}, leaf[-1]
    for i in reversed(range(n)):
        v = want[f"g{i}"] = leaf[-1] if i == n - 1 else (leaf[i] + v) / 2
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("method", sorted(propagate.COMBINE))
def test_contraction_equals_the_level_loop(spark, method):
    """Chains, shared children, repeated edges, a cycle, an unset leaf, zeros and ones."""
    rows = goals(a=-1, b=-1, c=-1, d=-1, e=-1, f=-1, p=-1, q=-1, u=-1, w=-1, x=0.9, y=0.0, z=1.0, t=0.4, unset=-1)
    links = [*under("a", "b", "x"), *under("b", "c"), *under("c", "d", "t"), *under("d", "e", "x", "x"), *under("e", "f"), *under("f", "y" if method != "union_bound" else "t", "z"), *under("p", "q"), *under("q", "p", "x"), *under("u", "w", "d"), *under("w", "unset")]
    n, e = tree(spark, rows, links)
    plain = values(propagate.bottom_up(n, e, propagate.COMBINE[method]))
    assert values(propagate.aggregate(n, e, method)) == pytest.approx(plain)
    assert plain["p"] == plain["u"] == -1 and plain["a"] != -1


def test_messages_along_a_chain_equal_a_walk(spark):
    n = 60
    nodes, edges, leaf = chain(spark, n)
    got = values(propagate.belief_propagation(nodes, edges, 1))
    up, others = {}, lambda i: 1.0 if i == n - 1 else 3.0
    for i in reversed(range(n)):
        t = leaf[i] * (up[i + 1] if i < n - 1 else 1.0)
        up[i] = t / (t + (1 - t) / others(i))
    down = 0.5
    for i in range(n):
        assert got[f"g{i}"] == pytest.approx(down * up[i] / (down * up[i] + (1 - down) * (1 - up[i])))
        share = (1 - down) / others(i)
        hand = lambda w, d=down, s=share: (d * w + s * (1 - w)) / (d * w + s * (1 - w) + s)
        below = hand(up[i + 1] if i < n - 1 else 1.0)
        assert got[f"l{i}"] == pytest.approx(below * leaf[i] / (below * leaf[i] + (1 - below) * (1 - leaf[i])))
        down = hand(leaf[i])


def test_cycles_stay_or_are_unset(spark):
    n, e = tree(spark, goals(a=0.7, b=0.8), [*under("a", "b"), *under("b", "a")])
    assert values(propagate.aggregate(n, e, "product")) == {"a": 0.7, "b": 0.8}
    assert values(propagate.product_leaf_temperature(n, e, 2.0)) == {"a": -1.0, "b": -1.0}


@pytest.mark.parametrize(
    ("method", "parameters", "leaves", "want"),
    [
        ("product_leaf_claim_dropout", {"dropout": 0.5}, [0.8, 0.2], 0.54),
        ("product_leaf_adaptive_claim_dropout", {"expected_leaves": 2}, [0.8, 0.6, 0.4, 0.2], 0.9 * 0.8 * 0.7 * 0.6),
        ("product_leaf_adaptive_claim_dropout", {"expected_leaves": 4}, [0.8, 0.6, 0.4, 0.2], 0.8 * 0.6 * 0.4 * 0.2),
        ("product_leaf_temperature_scaled", {"temperature": 2.0}, [0.8, 0.2], 2 / 9),
        ("geometric_mean", {}, [0.9, 0.4], 0.6),
        ("geometric_mean", {}, [1e-100] * 10, 1e-100),
        ("geometric_mean", {}, [0.9, 0.0], 0.0),
        ("geometric_mean_leaves", {}, [0.9, 0.4], 0.6),
        ("arithmetic_mean", {}, [0.9, 0.4], 0.65),
        ("minimum", {}, [0.9, 0.4], 0.4),
        ("maximum", {}, [0.9, 0.4], 0.9),
        ("union_bound", {}, [0.9, 0.8], 0.7),
        ("union_bound", {}, [0.4, 0.3], 0.0),
        ("product", {}, [0.5, 0.0], 0.0),
        ("temperature_scale_final", {"temperature": 2.0}, [0.1, 0.1], 2 / 3),
    ],
)
def test_aggregations(spark, method, parameters, leaves, want):
    names = [f"l{i}" for i in range(len(leaves))]
    n, e = tree(spark, goals(root=0.8, **dict(zip(names, leaves, strict=True))), under("root", *names))
    root = spark.createDataFrame([("g", "root")], "gid string, root string")
    assert values(propagate.aggregate_graphs(n, e, root, method, **parameters))["root"] == pytest.approx(want)


def test_aggregation_parameters_and_rationales(spark):
    n, e = tree(spark, goals(root=0.8, x=0.5), under("root", "x"))
    root = spark.createDataFrame([("g", "root")], "gid string, root string")
    for method, parameters in (("product", {"temperature": 2.0}), ("temperature_scale_final", {}), ("temperature_scale_final", {"temperature": 0.0}), ("unknown", {})):
        with pytest.raises(ValueError):
            propagate.aggregate_graphs(n, e, root, method, **parameters)
    noted = n.withColumn("confidence_rationale", F.lit("old"))
    got = {r["id"]: r["confidence_rationale"] for r in propagate.aggregate_graphs(noted, e, root, "minimum").collect()}
    assert got == {"root": "*OUTDATED: aggregated: minimum*: old", "x": "old"}


def test_belief_propagation_goldens(spark):
    n, e = tree(spark, goals(root=-1, leaf=0.95), [("leaf", "root", "particularizes")])
    assert values(propagate.belief_propagation(n, e, 2))["root"] == pytest.approx(0.65 / 0.97)
    rows = goals(success=-1, answer=-1, correct=-1, answer2=1.0, format=-1, content=-1, format2=1.0, x=0.95, y=0.9)
    links = [*under("success", "answer", "correct"), ("answer2", "answer", "particularizes"), *under("correct", "format", "content"), ("format2", "format", "particularizes"), *under("content", "x", "y"), ("e", "success", "supports")]
    n, e = tree(spark, [*rows, ("e", EVIDENCE, 0.1, -1.0)], links)
    got = values(propagate.belief_propagation(n, e, 1))
    assert got["success"] == pytest.approx(0.993758071, abs=1e-9) and got["e"] == 0.1
    assert propagate.tree_errors(n, e).count() == 0


def test_tree_errors(spark):
    n, e = tree(spark, goals(a=1, b=1, c=1, d=1), [*under("a", "b"), *under("c", "b"), ("d", "a", "particularizes")])
    assert {r["error"] for r in propagate.tree_errors(n, e).collect()} == {"several parents", "several roots", "mixed relations"}


def test_interpolation(spark):
    n, e = tree(spark, [("r", GOAL, 0.4, 0.75), ("a", GOAL, 0.8, -1.0), ("b", GOAL, 0.5, -1.0)], under("r", "a", "b"))
    assert values(propagate.product_interpolated(n, e))["r"] == pytest.approx(0.75 * 0.4 + 0.25 * 0.4)
    assert values(propagate.product_interpolated(n, e, 0.8))["r"] == pytest.approx(0.75 * 0.4 + 0.25 * 0.8)
    n, e = tree(spark, goals(r=0.4, a=0.8), under("r", "a"))
    with pytest.raises(PySparkException):
        values(propagate.product_interpolated(n, e))


def test_population_waves(spark):
    n, e = tree(spark, [*goals(r=-1, a=-1, b=0.5), ("e", EVIDENCE, -1.0, -1.0)], [*under("r", "a", "b"), ("e", "a", "supports")])
    seen = []

    def score(rows):
        seen.append(sorted(r["id"] for r in rows.collect()))
        return rows.select("gid", "id", F.lit(0.25).alias("confidence"))

    assert values(propagate.populate(n, e, score)) == {"r": 0.25, "a": 0.25, "b": 0.5, "e": 0.25}
    assert seen == [["e"], ["a"], ["r"]]
    assert values(propagate.populate(n, e, score, "goal_leaves_product"))["r"] == pytest.approx(0.125)
    cyclic = tree(spark, goals(a=-1, b=-1), [*under("a", "b"), *under("b", "a")])
    with pytest.raises(ValueError):
        propagate.populate(*cyclic, score)


# ---------------------------------------------------------------- calibration


def test_temperature_fits(spark):
    c, y = [0.8] * 4 + [0.2] * 4, [1, 1, 1, 0, 1, 0, 0, 0]
    want = (math.log(0.8 / 0.2)) / math.log(0.75 / 0.25)
    assert calibration.fit_temperature(results(spark, [*c, 1.0], [*y, 1])) == pytest.approx(want, rel=1e-6)
    assert calibration.fit_temperature(results(spark, c, y), "brier") == pytest.approx(want, rel=1e-6)
    with pytest.raises(ValueError):
        calibration.fit_temperature(results(spark, [0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1]))
    with pytest.raises(ValueError):
        calibration.fit_temperature(results(spark, [0.9, 1.0, 0.2], [1, 0, 0]))
    with pytest.raises(ValueError):
        calibration.Calibration("temperature")
    scaled = calibration.calibrate(results(spark, [0.8, 1.0], [1, 1]), 2.0)
    again = calibration.calibrate(scaled, 2.0)
    assert [r["estimated_confidence"] for r in again.orderBy("ord").collect()] == pytest.approx([2 / 3, 1.0])


# ---------------------------------------------------------------- graphs


def claims(spark):
    nodes = [("r", GOAL, "Root", "all", "why"), ("a", GOAL, "A", "left", ""), ("b", GOAL, "B", "right\nside", "x"), ("e", EVIDENCE, None, "seen", None)]
    n = spark.createDataFrame([("g", i, k, name, c, r, "log" if k == EVIDENCE else None, [2, 3] if k == EVIDENCE else None, "" if k == EVIDENCE else None) for i, k, name, c, r in nodes], "gid string, id string, kind string, goal_name string, auditable_claim string, reasoning string, evidence string, step_numbers array<int>, contribution string")
    e = spark.createDataFrame([("g", "a", "r", "decomposes_from", 0), ("g", "b", "r", "decomposes_from", 1), ("g", "e", "a", "supports", 2), ("g", "e", "b", "proves", 3)], "gid string, source string, target string, relationship_type string, pos int")
    return n, e, spark.createDataFrame([("g", "r")], "gid string, root string")


def test_rendered_graphs(spark):
    n, e, root = claims(spark)
    assert only(graphs.render_compact(n, e, root), "text") == "Node: Root\nClaim: all\nParents: None\n\nNode: A\nClaim: left\nParents: Root\n\nNode: B\nClaim: right\nside\nParents: Root\n\nNode: e\nClaim: seen\nParents: A, B"
    want = """ROOT GOAL
  Name: Root
  Claim: all
  Reasoning: why
  SUBGOALS
  - Connection: decomposes_from
    GOAL
      Name: A
      Claim: left
      Reasoning: (empty)
      EVIDENCE
      - Connection: supports
        EVIDENCE
          Name: log
          Claim: seen
          Step Numbers: 2, 3
          Contribution: (empty)
  - Connection: decomposes_from
    GOAL
      Name: B
      Claim: right
        side
      Reasoning: x
      EVIDENCE
      - Connection: proves
        EVIDENCE
          Name: log
          Claim: seen
          Step Numbers: 2, 3
          Contribution: (empty)"""
    assert only(graphs.render_nested(n, e, root), "text") == want
    with pytest.raises(PySparkException):
        graphs.render_nested(n, e.where("pos <> 1"), root).collect()
    with pytest.raises(ValueError):
        graphs.render_nested(n, e, root, {GOAL: ["goal_name"]})


def test_depths_closures_and_cited_steps(spark):
    n, e, root = claims(spark)
    assert {r["id"]: r["depth"] for r in graphs.node_depths(n, e, root).collect()} == {"r": 0, "a": 1, "b": 1, "e": 2}
    assert {r["id"]: r["max_step"] for r in graphs.max_cited_step(n, n, e).collect()} == {"r": 3, "a": 3, "b": 3, "e": 3}
    alone = n.where("id <> 'e'")
    assert {r["id"]: r["max_step"] for r in graphs.max_cited_step(alone, alone, e.where("pos < 2")).collect()} == {"r": -1, "a": -1, "b": -1}
    assert {r["id"] for r in graphs.goal_leaves(n, e).collect()} == {"a", "b"} and {r["id"] for r in graphs.leaves(n, e).collect()} == {"e"}
    shared, links = tree(spark, goals(r=1, m=1, k=1, s=1), [*under("r", "m", "s"), *under("m", "k"), *under("k", "s")])
    depths = graphs.node_depths(shared, links, spark.createDataFrame([("g", "r")], "gid string, root string"))
    assert {r["id"]: r["depth"] for r in depths.collect()}["s"] == 1


def test_graph_edits(spark):
    n, e, _ = claims(spark)
    n, e = n.where("id = 'r'").withColumn("confidence", F.lit(-1.0)).withColumn("confidence_in_children", F.lit(-1.0)), e.where("false")
    kind = "gid string, seq int, kind string, target string, sub_goals array<struct<identifier:string,auditable_claim:string,reasoning:string>>, weight double"
    good = [("g", 0, graph_edit.DIVIDE, "Root", [("X", "x", ""), ("Y", "y", "")], 0.7), ("g", 1, graph_edit.PARTICULARIZE, "Y", [("Z", "z", "")], None)]
    actions = spark.createDataFrame(good, kind)
    assert graph_edit.action_errors(n, e, actions).count() == 0
    nodes, edges = graph_edit.apply_actions(n, e, actions)
    name = {r["id"]: r["goal_name"] for r in nodes.collect()}
    assert sorted(name.values()) == ["Root", "X", "Y", "Z"]
    got = [(name[r["source"]], name[r["target"]], r["relationship_type"]) for r in edges.orderBy("pos").collect()]
    assert got == [("X", "Root", "decomposes_from"), ("Y", "Root", "decomposes_from"), ("Z", "Y", "particularizes")]
    assert {r["goal_name"]: r["confidence_in_children"] for r in nodes.collect()}["Root"] == 0.7
    bad = [("g", 0, graph_edit.DIVIDE, "Root", [("X", "x", "")], None), ("g", 1, graph_edit.DIVIDE, "Root", [("X", "x", ""), ("Q", "q", "")], None), ("g", 2, graph_edit.DIVIDE, "None", [("V", "v", ""), ("W", "w", "")], None)]
    errors = {(r["seq"], r["error"]) for r in graph_edit.action_errors(n, e, spark.createDataFrame(bad, kind)).collect()}
    assert errors == {(0, "a decomposition has two sub-goals or more"), (1, "the goal has more than one strategy"), (0, "a goal name is used twice"), (1, "a goal name is used twice"), (2, "no such target goal")}
    catalog = spark.createDataFrame([("g", "k1", "log", [1], "c", "d"), ("g", "k2", "log", [2], "c", "d")], "gid string, evidence_key string, evidence string, step_numbers array<int>, auditable_claim string, contribution string")
    links = spark.createDataFrame([("g", 0, "k1", "X", "supports"), ("g", 1, "k1", "Z", "proves")], "gid string, pos int, evidence_key string, target string, relationship_type string")
    more, ends = graph_edit.apply_evidence(nodes, edges, catalog, links)
    assert more.count() == 5 and ends.where("relationship_type in ('supports', 'proves')").count() == 2
    assert graph_edit.evidence_errors(nodes, edges, catalog, links).count() == 0
    assert {r["error"] for r in graph_edit.evidence_errors(nodes, edges, catalog, links.withColumn("target", F.lit("Y"))).collect()} == {"unknown target goal"}


def test_quality_run(spark):
    rows = [("root", 0.5, "root"), ("first", 0.25, "1"), ("second", 1.0, "2"), ("l1", 0.5, "3"), ("l2", 1.0, "4"), ("concrete", 0.5, "5")]
    n = spark.createDataFrame([("g", i, GOAL, c, t) for i, c, t in rows], "gid string, id string, kind string, confidence double, auditable_claim string")
    e = spark.createDataFrame([("g", "first", "root", "decomposes_from", 0), ("g", "second", "root", "decomposes_from", 1), ("g", "l1", "first", "decomposes_from", 2), ("g", "l2", "first", "decomposes_from", 3), ("g", "concrete", "root", "particularizes", 4)], "gid string, source string, target string, relationship_type string, pos int")
    pairs = quality.claim_pairs(n, e)
    counts = {r["metric"]: r["count"] for r in pairs.groupBy("metric").count().collect()}
    assert counts == {quality.SUFFICIENCY: 2, quality.NECESSITY: 4, quality.PARTICULARIZATION: 2}
    assert pairs.where(f"metric = '{quality.SUFFICIENCY}' and parent = 'root'").first()["premise"] == "1 AND 2"
    siblings = quality.sibling_pairs(n, e).select("gid", "metric", "parent", F.concat_ws("-", "i", "j").alias("pair"), "direction", "premise", "hypothesis")
    labels = F.when(F.col("metric") == quality.SUFFICIENCY, F.when(F.col("parent") == "root", "entailment").otherwise("neutral"))
    labels = labels.when(F.col("metric") == quality.NECESSITY, F.when(F.col("pair") == 0, "entailment").otherwise("contradiction"))
    labels = labels.when(F.col("metric") == quality.SIBLINGS, F.when(F.col("direction") == 0, "neutral").otherwise("contradiction")).otherwise(F.when(F.col("direction") == 0, "entailment").otherwise("neutral"))
    told = pairs.drop("child_ids").withColumn("pair", F.col("pair").cast("string")).unionByName(siblings).withColumn("label", labels)
    got = {r["metric"]: r["score"] for r in quality.graph_scores(told, ["gid"]).collect()}
    assert got == {quality.SUFFICIENCY: 0.5, quality.NECESSITY: 0.5, quality.SIBLINGS: 1.0, quality.PARTICULARIZATION: 0.0}
    total = quality.total_entailments(told, ["gid"]).first()
    assert (total["entailments"], total["predictions"]) == (4, 8)
    mse = quality.aggregation_mse(n, e).first()
    assert mse["product_mse"] == pytest.approx(((0.5 - 0.25) ** 2 + (0.25 - 0.5) ** 2) / 2)
    done = spark.createDataFrame([("r", "g", "judge", 10, 5, 0.5)], "run string, gid string, evaluator_model string, total_tokens long, generated_tokens long, cost double")
    row = quality.quality_summary(done, quality.graph_scores(told.withColumn("run", F.lit("r")), ["run", "gid"])).first()
    assert (row["evaluator_model"], row["n"], row["failed"], row["observed_entailments"], row["expected_entailments"], row["sum_cost"]) == ("judge", 1, 0, 4, 8, 0.5)


def test_seeded_pair_sample(spark):
    import random

    got = quality.sample_pairs(spark.createDataFrame([("i", "m", 9)], "instance_id string, model string, n int"), 4).first()["picked"]
    assert got == sorted(random.Random("i:m:non_redundant_siblings").sample(range(9), 4))


# ---------------------------------------------------------------- trajectories


def log(spark, rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], "traj string, idx int, kind string, role string, tool_call_id string, tool_name string, arguments string, text string, summary string, response_id string")


def test_rendering_and_condensing(spark):
    events = log(
        spark,
        [
            ("message", "user", None, None, None, " do it ", None, None),
            ("action", None, "x", "terminal", '{"command": "ls"}', "look", "list files", "1"),
            ("action", None, "y", "think", "{}", "", None, "1"),
            ("observation", None, "x", "terminal", None, "a.txt\n", None, None),
            ("observation", None, "y", "think", None, "", None, None),
        ],
    )
    want = "<message role=user>\n<content>\ndo it\n</content>\n</message>\n\n<action steps=1,2>\n<content>\nlook\n</content>\n<tool_calls>\n<tool_call step=1>\nterminal({\"command\": \"ls\"}) [id=tool_call_0001]\n</tool_call>\n<tool_call step=2>\nthink({}) [id=tool_call_0002]\n</tool_call>\n</tool_calls>\n</action>\n\n<observation step=1 tool_call_id=tool_call_0001>\n<content>\na.txt\n</content>\n</observation>\n\n<observation step=2 tool_call_id=tool_call_0002>\n<content>\n<empty>\n</content>\n</observation>"
    assert only(trajectory.render(events), "text") == want
    assert only(trajectory.render(events, start_at_first_action=True), "text") == want.split("</message>\n\n")[1]
    cited = spark.createDataFrame([("t", 2)], "traj string, step int")
    got = only(trajectory.render(trajectory.condense(events, cited), start_at_first_action=False), "text")
    assert "<summarized_action step=1>\nlist files\n</summarized_action>" in got
    assert "<summarized_observation step=1>\nTool: terminal\nExit code: None\nOutput:\na.txt\n</summarized_observation>" in got
    assert "<action step=2>" in got and "<observation step=2 tool_call_id=tool_call_0001>" in got


def test_observation_summaries(spark):
    rows = [("terminal", "grep x\nfound", "grep x", "grep x", 0, None, None, None), ("terminal", "", None, "grep -r x", 1, None, None, None), ("terminal", "", None, "ls", None, None, None, None), ("file_editor", "ok", None, "edit", None, "/f", "a\nb\nc", "a\nX\nc"), ("other", "y" * 301, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "tool string, result string, echoed string, asked string, code int, path string, old string, new string")
    told = observation_summary(F.col("tool"), F.col("result"), command=F.col("echoed"), asked=F.col("asked"), exit_code=F.col("code"), operation=F.col("asked"), path=F.col("path"), failed=F.lit(False), old=F.col("old"), new=F.col("new"))
    assert [r[0] for r in df.select(told).collect()] == [
        "Tool: terminal\nExit code: 0\nOutput:\nfound",
        "Tool: terminal\nNo matches; exit code 1.",
        "Tool: terminal\nNo output; exit code unavailable.",
        "Tool: file_editor\nOperation: edit\nPath: /f\nStatus: success\nChanged lines: 2",
        "Tool: other\nResult: " + "y" * 300 + "...",
    ]


def test_records_become_events(spark):
    kind = "traj string, idx int, type string, text string, tool_call_id string, kind string, title string, status string, output string"
    rows = [
        ("t", 0, "user_message", "hello", None, None, None, None, None),
        ("t", 1, "agent_thought", "hm", None, None, None, None, None),
        ("t", 2, "tool_call", None, "c1", "execute", "List: $ ls -l", "failed", "no such"),
        ("t", 3, "tool_call", None, "c2", "read", "Reading /a b", "completed", "text"),
        ("t", 4, "tool_call", None, "c3", "other", "Use it", "completed", "Tool: invoke_skill\nResult:\n[skill: pdf] ready"),
        ("t", 5, "agent_message", "done\nCritic: no", None, None, None, None, None),
    ]
    events = trajectory.acp_to_events(spark.createDataFrame(rows, kind)).orderBy("idx").collect()
    assert [(r["kind"], r["tool_name"], r["tool_call_id"]) for r in events] == [("message", None, None), ("action", "think", "acp-think-0001"), ("observation", "think", "acp-think-0001"), ("action", "terminal", "c1"), ("observation", "terminal", "c1"), ("action", "file_editor", "c2"), ("observation", "file_editor", "c2"), ("action", "invoke_skill", "c3"), ("observation", "invoke_skill", "c3"), ("action", "finish", "acp-finish-0006")]
    assert [r["arguments"] for r in events if r["kind"] == "action"] == ['{"thought": "hm"}', '{"command": "ls -l"}', '{"path": "/a b", "command": "view"}', '{"name": "pdf"}', '{"message": "done"}']
    assert events[3]["summary"] == "List" and events[4]["is_error"] and events[8]["text"] == "[skill: pdf] ready"
    assert [r["parent_id"] for r in events] == [None, *[r["event_id"] for r in events[:-1]]]


def test_snapshots(spark):
    kind = "traj string, idx int, tool_call_id string, status string, title string, call_kind string, content string, input string"
    rows = [("t", 0, "a", "completed", "", "tool", "out", None), ("t", 1, "a", "pending", "Reading x", "read", None, None), ("t", 2, "b", "pending", "B", "edit", None, "in"), ("t", 3, "b", "completed", None, None, "done", None)]
    calls = spark.createDataFrame(rows, kind)
    merged = trajectory.merge_adjacent_snapshots(calls).orderBy("idx").collect()
    assert [(r["idx"], r["title"], r["call_kind"], r["conflict"]) for r in merged] == [(0, "Reading x", "read", False), (2, "B", "edit", True), (3, None, None, False)]
    index = {r["tool_call_id"]: r for r in trajectory.snapshot_index(calls).collect()}
    assert not index["a"]["valid"] and index["b"]["valid"] and index["b"]["title"] == "B" and index["b"]["step"] == 2
    short = trajectory.condense_calls(calls.where("tool_call_id = 'b'"), spark.createDataFrame([], "traj string, step int")).orderBy("idx").collect()
    assert [r["summary"] for r in short] == ["<summarized_action step=1>\nTool: edit\nTitle: B\n</summarized_action>", "<summarized_observation step=1>\nTool: edit\nStatus: completed\nOutput:\ndone\n</summarized_observation>"]


def test_branch_and_prefix(spark):
    rows = [("t", 0, "e0", None, "message"), ("t", 1, "e1", "e0", "action"), ("t", 2, "x", "e0", "action"), ("t", 3, "e3", "e1", "observation"), ("t", 4, "e4", "e3", "action")]
    events = spark.createDataFrame(rows, "traj string, idx int, event_id string, parent_id string, kind string")
    branch = trajectory.active_branch(events, spark.createDataFrame([("t", "e4")], "traj string, event_id string")).orderBy("place")
    assert [r["event_id"] for r in branch.collect()] == ["e0", "e1", "e3", "e4"]
    assert trajectory.default_leaf(events).count() == 0
    straight = branch.drop("place").withColumn("action_id", F.when(F.col("event_id") == "e3", "e1")).withColumn("tool_call_id", F.when(F.col("kind") == "action", F.col("event_id")))
    assert [r["event_id"] for r in trajectory.prefix_after_actions(straight, 1).orderBy("idx").collect()] == ["e0", "e1", "e3"]
    assert [r["event_id"] for r in trajectory.prefix_after_actions(straight, 0).collect()] == ["e0"]
    assert trajectory.prefix_after_actions(straight, 5).count() == 4


EVENT = "traj string, idx int, event_id string, kind string, action_id string, tool_call_id string"


def call_log(spark, *events):
    """Of one log: (id, kind, action id, call id)."""
    return spark.createDataFrame([("t", i, *e) for i, e in enumerate(events)], EVENT)


def test_prefix_of_overlapping_actions(spark):
    a1, a2, a3 = ("a1", "action", None, "c1"), ("a2", "action", None, "c2"), ("a3", "action", None, "c1")
    o1, o2, o3 = ("o1", "observation", "a1", None), ("o2", "observation", "a2", None), ("o3", "observation", "a3", None)
    ids = lambda events, k: [r["event_id"] for r in trajectory.prefix_after_actions(events, k).orderBy("idx").collect()]
    both = call_log(spark, a1, a2, o1, o2, a3, o3)
    assert ids(both, 1) == ["a1", "a2", "o1"]
    assert ids(both, 2) == ["a1", "a2", "o1", "o2"]
    assert ids(both, 0) == [] and ids(both, 4) == ids(both, -1) == ["a1", "a2", "o1", "o2", "a3", "o3"]
    # an error names the call, and a call that is named again is the latest action's
    late = ("e", "error", None, "c1")
    assert ids(call_log(spark, a1, o1, a2, o2, late, a3, o3), 1) == ["a1", "o1", "a2", "o2", "e"]
    assert ids(call_log(spark, a1, o1, a3, late, a2, o2), 1) == ["a1", "o1"]
    assert {r["event_id"]: r["of_step"] for r in trajectory.with_action(call_log(spark, a1, o1, a3, late), "traj").collect()} == {"o1": 1, "e": 2}


def test_what_stands_against_a_prefix(spark):
    a1, a2, o1, o2 = ("a1", "action", None, "c1"), ("a2", "action", None, "c2"), ("o1", "observation", "a1", None), ("o2", "observation", "a2", None)
    problem = lambda k, *events: trajectory.prefix_cuts(call_log(spark, *events), k).first()["problem"]
    assert problem(1, a1, o1, a2) is None and problem(2, a1, o1, a2) == trajectory.MISSING
    assert problem(1, o1, a1) == trajectory.UNKNOWN_ACTION and problem(0, o1, a1) == trajectory.UNKNOWN_ACTION
    assert problem(1, a1, o1, o2) == trajectory.UNKNOWN_ACTION and problem(9, a1, o1, o2) == trajectory.UNKNOWN_ACTION
    assert problem(1, a1, o1, ("e", "error", None, "c9")) == trajectory.UNKNOWN_CALL
    assert problem(0, ("e", "error", None, "c9"), a1) is None and problem(0, a1, o1) is None
    assert problem(3, a1, a2) is None  # too few actions: whole
    for events, what in ((call_log(spark, a1, a2, o1), trajectory.MISSING), (call_log(spark, a1, o2), trajectory.UNKNOWN_ACTION)):
        with pytest.raises(Exception, match=what):
            trajectory.prefix_after_actions(events, 2 if what == trajectory.MISSING else 1).count()
    with pytest.raises(Exception, match="no action before it"):
        trajectory.observations_with_action(call_log(spark, o1, a1)).collect()
    with pytest.raises(Exception, match="no call before it"):
        trajectory.errors_with_action(call_log(spark, ("e", "error", None, "c1"), a1)).collect()
    with pytest.raises(ValueError, match="-1 or more"):
        trajectory.prefix_after_actions(call_log(spark, a1), -2)


def test_action_probabilities(spark):
    rows = [("t", 1, math.log(0.9))] * 10 + [("t", 2, math.log(0.8))] * 3
    row = trajectory.log_prob_modes(trajectory.step_log_probs(spark.createDataFrame(rows, "traj string, step int, lp double"))).first()
    assert row["first_total"] == pytest.approx(0.9**10) and row["last_total"] == pytest.approx(0.8**3)
    assert (row["first_mean"], row["mean_mean"], row["last_mean"]) == pytest.approx((0.9, 0.85, 0.8))
    spans = trajectory.token_spans(spark.createDataFrame([("t", i, w) for i, w in enumerate(("ab", "c", "def"))], "traj string, pos int, token string"))
    hit = trajectory.overlapping(spans, spark.createDataFrame([("t", 0, 2, 4)], "traj string, region int, rs int, re int"))
    assert sorted(r["pos"] for r in hit.collect()) == [1, 2]


# ---------------------------------------------------------------- functions


def test_reply_parsing(spark):
    rows = spark.createDataFrame([("x\nConfidence: 82%",), ("Confidence: 0.9%",), ("Confidence: 120%",), ("Confidence: 7%\nmore",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.confidence_percent("t")).collect()] == [0.82, None, None, None, None]


def test_votes_and_softmax(spark):
    ask = lambda answers: spark.createDataFrame([(answers,)], "a array<string>").select(scores.vote("a", 10)).first()[0]
    assert ask([" True"] * 7 + ["false", "?", None]) == pytest.approx(0.875)
    with pytest.raises(PySparkException):
        ask(["true"] * 7 + ["x"] * 3)
    top = spark.createDataFrame([(["True", " true", "False", "FALSE"], [math.log(p) for p in (0.4, 0.2, 0.2, 0.1)])], "t array<string>, p array<double>")
    assert top.select(scores.true_share("t", "p")).first()[0] == pytest.approx(2 / 3)


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.excerpt(F.lit("a" * 149 + " " + "b" * 100 + " " + "c" * 149))) == "a" * 149 + "\n...\n" + "c" * 149
    assert one(text.prefix(F.lit("ab  cd"), 4)) == "ab..."
    assert len(one(text.content(F.lit("x" * 50_001)))) == 50_000
    assert one(text.short_id(F.lit("x" * 65))).startswith("fc_") and one(text.short_id(F.lit("x" * 64))) == "x" * 64
    assert one(text.without_echo(F.lit("a\nb\n  out"), F.lit("a\n\nb"))) == "out"
    assert [one(text.safe_relative_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", "a..b")] == [True, False, False, True]
    assert one(text.json_object(a=F.lit('x"\n'), b=F.lit(None).cast("string"))) == '{"a": "x\\"\\n"}'
    diff = spark.createDataFrame([("a\nb\nc", "a\nc"), (None, "x\ny"), ("a", "a"), ("a", None)], "o string, n string")
    assert [r[0] for r in diff.select(text.changed_lines("o", "n")).collect()] == ["2", "1-2", None, None]
    assert one(scores.temperature_scale(F.lit(1.0), 3.0)) == 1.0


# ---------------------------------------------------------------- sources, runner, audit


def test_slices_and_samples(spark):
    df = spark.range(10).withColumnRenamed("id", "ord")
    for part in ("2:7", ":-3", "::3", "8:2:-2", "-4:"):
        got = sorted(r["ord"] for r in sources.row_slice(df, sources.parse_slice(part), 10).collect())
        assert got == sorted(range(10)[sources.parse_slice(part)])
    with pytest.raises(ValueError):
        sources.parse_slice("__import__('os')")
    with pytest.raises(ValueError):
        sources.row_slice(df, slice(0, 11), 10)
    assert sources.sample(df, 4, 10).count() == 4


def test_graph_documents_round_trip(spark, tmp_path):
    doc = '{"nodes": [{"id": "r", "kind": "GSNGoalNode", "confidence": 0.5}, {"id": "e", "kind": "EvidenceNodeV2", "confidence": -1, "step_numbers": [1]}], "edges": [{"source": "e", "target": "r", "relationship_type": "proves"}, {"source": "lost", "target": "r", "relationship_type": null}], "goal_zero_node_id": "r"}'
    (tmp_path / "i" / "m").mkdir(parents=True)
    (tmp_path / "i" / "m" / "graph.json").write_text(doc)
    docs = sources.json_documents(spark, str(tmp_path), sources.GRAPH, "graph.json")
    nodes, edges = sources.graph_tables(docs, F.lit("g"))
    assert nodes.count() == 2 and [r["source"] for r in graphs.dangling_edges(nodes, edges).collect()] == ["lost"]


def test_archives(spark, tmp_path):
    import io
    import json
    import tarfile

    def archive(name, members):
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as tar:
            for path, body in members:
                info = tarfile.TarInfo(path)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))

    event = lambda i, own: (f"events/event-{i:05d}-id{i}.json", json.dumps({"id": own, "kind": "action"}).encode())
    archive("good", [("base_state.json", b"{}"), event(0, "id0"), event(1, "id1")])
    archive("bad", [event(0, "id0"), event(2, "other")])
    events = sources.archives(spark, str(tmp_path))
    errors = {(r["path"].rsplit("/", 1)[-1], r["error"].split(":")[0]) for r in sources.archive_errors(events).collect()}
    assert errors == {("bad.tar.gz", "payload id differs"), ("bad.tar.gz", "base states other than one")}


def test_runner_isolates_items(spark):
    def make():
        tries = {}

        def scorer(row):
            tries[row["instance_id"]] = tries.get(row["instance_id"], 0) + 1
            if row["instance_id"] == "1":
                raise KeyError("lost")
            if row["instance_id"] == "2" and tries["2"] < 3:
                raise ValueError("again")
            return {"confidence": 0.5, "total_tokens": 1, "generated_tokens": 1, "cost": 0.0}

        return scorer

    rows = results(spark, [0.1] * 4, [0] * 4).select("instance_id", "model", "ord")
    saved = spark.createDataFrame([("3", "m", 0.9, 1, 1, 0.1)], "instance_id string, model string, confidence double, total_tokens long, generated_tokens long, cost double")
    done, failed = runner.run_estimates(rows, saved, make)
    assert [(r["instance_id"], r["estimated_confidence"]) for r in done.collect()] == [("0", 0.5), ("2", 0.5), ("3", 0.9)]
    assert [(r["instance_id"], r["error"]) for r in failed.collect()] == [("1", "KeyError: 'lost'")]
    with pytest.raises(ValueError):
        runner.replay(rows, saved)


def test_run_audit(spark):
    data = results(spark, [0.1, 0.2, 0.3], [0, 1, 0]).select("instance_id", "model", "resolved", F.lit("b").alias("benchmark"))
    got = results(spark, [0.1, 0.2], [0, 0]).withColumn("benchmark", F.lit("b"))
    out = got.select("instance_id", "model", F.col("estimated_confidence").alias("confidence"))
    failures = spark.createDataFrame([("2", "m", "x" * 200)], "instance_id string, model string, error string")
    roots = spark.createDataFrame([("0", "m", "r", 0.1), ("1", "m", "r", 0.9)], "instance_id string, model string, root string, confidence double")
    stored = metrics.run_metrics(got).drop("run")
    found = audit.audit_run(data, got, out, failures, stored, roots)
    codes = {(r["code"], r["severity"]) for r in found.collect()}
    assert codes == {("missing_prediction", "error"), ("missing_output", "error"), ("result_dataset_mismatch", "error"), ("recorded_failures", "error"), ("graph_output_confidence_mismatch", "error")}
    status = {r["instance_id"]: r["status"] for r in audit.roll_up(found, data).collect()}
    assert status == {"0": "ok", "1": "error", "2": "error"}
    assert {r["code"] for r in audit.audit_run(data, None, out).collect()} >= {"missing_results", "missing_prediction"}
    target = {"dataset": {"path": "p", "split": "s"}, "estimator": {"estimator_type": "replay"}}
    changed = audit.audit_config(spark, "a", "b", target, {**target, "estimator": {"estimator_type": "oh_gsn"}}, "q", "s")
    assert {r["code"] for r in changed.collect()} == {"saved_config_field_mismatch", "dataset_argument_config_mismatch"}


def test_trajectory_audit(spark):
    kind = "instance_id string, model string, problem_statement string, conversation_archive_path string, benchmark string, resolved boolean, trajectory_type string, text string, condensed string, finishes int"
    full, short = "<action step=1>\n<observation step=1>", "<summarized_action step=1>\n<summarized_observation step=1>"
    rows = [("a", "m", "p", "x.tar.gz", "b", True, None, full, short, 1), ("b", "m", "p", "../x", None, None, "acp", "<action step=1>", short, 0)]
    found = {(r["instance_id"], r["severity"], r["code"]) for r in audit.audit_trajectories(spark.createDataFrame(rows, kind)).collect()}
    assert found == {("b", "error", "unsafe_path"), ("b", "error", "unpaired_actions"), ("b", "error", "condensed_observations"), ("b", "warning", "missing_benchmark"), ("b", "warning", "missing_label"), ("b", "warning", "finish_count")}


def test_outputs_and_inputs_of_calls(spark):
    kind = "cmd boolean, f string, b array<struct<type:string,content:struct<type:string,text:string>,path:string,old_text:string,new_text:string>>, c string, r string, k string"
    words, diff = lambda t: ("content", ("text", t), None, None, None), lambda p, a, b: ("diff", None, p, a, b)
    rows = [
        (True, "ok", [], None, None, "execute"),
        (True, "", [], None, "{}", "execute"),
        (False, None, [words("a  \nb "), words("c")], "[]", "x", "read"),
        (False, None, [diff("p", None, "n"), diff("q", "o", "n")], "[]", None, "edit"),
        (False, None, [words("a"), diff("p", None, "n")], '[{"b": 1, "a": 2}]', None, "edit"),
        (False, None, [], None, '{"b": 1, "a": [2]}', "read"),
        (False, None, None, None, None, "fetch"),
    ]
    df = spark.createDataFrame(rows, kind)
    got = [r[0] for r in df.select(text.resolved_output(*[F.col(x) for x in ("cmd", "f", "b", "c", "r", "k")])).collect()]
    assert got[:4] == ["ok", "<empty>", "a\nb\nc", "Path: p\nNew text:\nn\n\nPath: q\nOld text:\no\nNew text:\nn"]
    assert got[4:] == ['[\n  {\n    "a": 2,\n    "b": 1\n  }\n]', '{\n  "a": [\n    2\n  ],\n  "b": 1\n}', text.WEB_NOTE]
    for odd in ((True, None, [], None, None, "execute"), (False, None, [], None, None, "read")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([odd], kind).select(text.resolved_output(*[F.col(x) for x in ("cmd", "f", "b", "c", "r", "k")])).collect()
    asked = spark.createDataFrame([('{"call_id": 1, "path": "p", "description": "d"}', "t"), ("[1]", "t"), (None, "t")], "i string, t string")
    assert [json.loads(r[0]) for r in asked.select(text.call_input("i", "t")).collect()] == [{"path": "p", "summary": "d"}, {"input": [1], "summary": "t"}, {"summary": "t"}]


def test_graph_stats_with_evidence_and_nodes_that_are_not_reached(spark):
    n, e, root = claims(spark)
    n = n.withColumn("confidence", F.when(F.col("kind") == GOAL, 0.5).otherwise(-1.0))
    stats = graphs.graph_stats(n, e, root).first().asDict()
    assert stats["nodes"] == 4 and stats["goals"] == 3 and stats["evidence"] == 1
    assert [stats[f"layer_{k}"] for k in range(4)] == [1, 2, 1, 0] and stats["max_depth"] == 1
    with pytest.raises(PySparkException):
        graphs.graph_stats(n, e.where("pos < 2"), root).collect()


def test_tables_too_large_to_render(spark):
    with pytest.raises(ValueError):
        reports.markdown(spark.range(11), most=10)
    assert reports.delimited(spark.range(2)).count("\n") == 2


def test_running_sums_of_keys_with_ties_and_nulls(spark):
    rows = [(k, o, o % 3) for k in (None, "a", "b") for o in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, x int").repartition(7)
    got = {(r["k"], r["o"]): (r["s"], r["s_all"]) for r in tables.running(df, ["k"], ["o"], {"s": F.col("x")}).collect()}
    assert got == {(k, o): (sum(i % 3 for i in range(o + 1)), sum(i % 3 for i in range(200))) for k, o, _ in rows}


# ---------------------------------------------------------------- permutations, pairs, regions, closures


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_every_place_is_taken_once(spark, n):
    df = spark.range(n).withColumn("p", permute.permuted(F.col("id"), F.lit(n).cast("long"), 7)).withColumn("q", permute.permuted(F.col("id"), F.lit(n).cast("long"), 8))
    rows = df.collect()
    assert sorted(r["p"] for r in rows) == sorted(r["q"] for r in rows) == list(range(n))
    if n > 50:
        assert sum(r["p"] == r["q"] for r in rows) < n / 5 and sum(r["p"] == r["id"] for r in rows) < n / 5


def test_drawn_rows(spark):
    df = spark.range(40).select((F.col("id") * 3).alias("ord"))
    plain = sources.drawn(df, 40, shuffle=False, first=5)
    assert sorted((r["_place"], r["ord"]) for r in plain.collect()) == [(i, 3 * i) for i in range(5)]
    once, again = ({r["ord"]: r["_place"] for r in sources.drawn(df, 40, seed=7, **w).collect()} for w in ({"first": 10}, {"again": 10}))
    assert sorted(once.values()) == sorted(again.values()) == list(range(10)) and set(once) != set(again)
    assert {r["ord"] for r in sources.sample(sources.numbered(df), 10, 40, 7).collect()} == set(once)
    for wrong in ({"first": 41}, {"again": -1}, {"first": 1, "again": 1}):
        with pytest.raises(ValueError):
            sources.drawn(df, 40, **wrong)


def test_pairs_are_told_by_their_place(spark):
    for n in (2, 3, 7, 50):
        total = n * (n - 1) // 2
        i, j = quality.pair_at(F.col("id"), F.lit(n).cast("long"))
        got = [(r["i"], r["j"]) for r in spark.range(total).select("id", i.alias("i"), j.alias("j")).orderBy("id").collect()]
        assert got == [(a, b) for a in range(n) for b in range(a + 1, n)]
    n = 100_000
    i, j = quality.pair_at(F.col("k"), F.lit(n).cast("long"))
    places = [0, n - 2, n - 1, n * (n - 1) // 2 - 1, n * (n - 1) // 2 - 2, 2_345_678_901]
    for r in spark.createDataFrame([(k,) for k in places], "k long").select("k", i.alias("i"), j.alias("j")).collect():
        assert 0 <= r["i"] < r["j"] < n and r["i"] * (2 * n - r["i"] - 1) // 2 + r["j"] - r["i"] - 1 == r["k"]


def test_a_wide_parent_costs_only_its_sample(spark):
    n = 100_000
    nodes = spark.range(n).select(F.lit("g").alias("gid"), F.concat(F.lit("c"), F.col("id")).alias("id"), F.lit(GOAL).alias("kind"), F.concat(F.lit("claim "), F.col("id")).alias("auditable_claim"))
    nodes = nodes.unionByName(spark.createDataFrame([("g", "r", GOAL, "root")], nodes.schema))
    edges = spark.range(n).select(F.lit("g").alias("gid"), F.concat(F.lit("c"), F.col("id")).alias("source"), F.lit("r").alias("target"), F.lit("decomposes_from").alias("relationship_type"), F.col("id").alias("pos"))
    got = quality.sampled_sibling_pairs(nodes, edges, 100).collect()
    assert len(got) == 200 and len({(r["i"], r["j"]) for r in got}) == 100
    assert all(r["id_a"] == f"c{r['i']}" and r["premise"] == f"claim {r['i' if r['direction'] == 0 else 'j']}" for r in got)
    # the places that the other library's generator would draw
    drawn = quality.sample_pairs(spark.createDataFrame([("i", "m", 10)], "instance_id string, model string, n int"), 4).select(F.lit("g").alias("gid"), F.explode("picked").alias("place")).withColumn("place", F.col("place").cast("long"))
    few, links = nodes.where("id in ('r', 'c0', 'c1', 'c2', 'c3', 'c4')"), edges.where("pos < 5")
    every = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    want = {every[r["place"]] for r in drawn.collect()}
    assert {(r["i"], r["j"]) for r in quality.sampled_sibling_pairs(few, links, 4, drawn).collect()} == want


def test_regions_meet_only_what_is_near(spark):
    tokens = [("t", p, "x" * (p % 4)) for p in range(400)] + [("u", 0, "y" * 900), ("u", 1, ""), ("u", 2, "z")]
    spans = trajectory.token_spans(spark.createDataFrame(tokens, "traj string, pos int, token string"))
    regions = [("t", k, k * 11, k * 11 + (k % 5) * 7) for k in range(60)] + [("u", 0, 0, 2000), ("u", 1, 899, 901), ("u", 2, 900, 900), ("u", 3, 450, 450)]
    got = trajectory.overlapping(spans, spark.createDataFrame(regions, "traj string, region int, rs int, re int"), width=16)
    plain = [(s["traj"], s["pos"], r) for s in spans.collect() for key, r, low, high in regions if key == s["traj"] and s["end"] > low and s["start"] < high]
    assert sorted((r["traj"], r["pos"], r["region"]) for r in got.collect()) == sorted(plain)


def test_closures_above_cycles_and_of_shared_nodes(spark):
    steps = {"a": [], "b": [3], "c": [40_000, 1], "d": [0], "e": [7, 3], "p": [5], "q": [6], "top": [], "alone": [2], "bare": None}
    n = spark.createDataFrame([("g", k, v) for k, v in steps.items()], "gid string, id string, step_numbers array<int>")
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "d"), ("p", "q"), ("q", "p"), ("q", "top"), ("a", "top"), ("bare", "top")]
    e = spark.createDataFrame([("g", s, t) for s, t in links], "gid string, source string, target string")
    below = {k: {k} for k in steps}
    for _ in steps:
        for s, t in links:
            below[t] |= below[s]
    want = {k: sorted({x for m in v for x in steps[m] or []}) for k, v in below.items()}
    assert {r["id"]: r["steps"] for r in graphs.cited_steps(n, n, e).collect()} == want
    assert {r["id"]: r["max_step"] for r in graphs.max_cited_step(n, n, e).collect()} == {k: max(v, default=-1) for k, v in want.items()}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ranks_over_many_parts(spark, parts):
    """Groups of one confidence over several parts, null keys, and keys within one part, against a plain walk."""
    rows = [("a" if i % 3 else None, (i * 7) % 5 / 5 if i % 2 else 0.5, float(i % 4 == 0), i) for i in range(240)] + [("b", 0.5, float(i % 2), i) for i in range(90)] + [("c", 0.1, 1.0, 0)]
    df = spark.createDataFrame(rows, "run string, estimated_confidence double, resolved double, ord int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        with tables.Scratch(spark) as scratch:
            got = sorted(((r["run"], r["_ord"], r["_n"], r["_below"], r["_above"], r["_i"], r["_hits"], r["_won"], r["_under"], r["_level"]) for r in metrics.ranked(df, ["run"], "estimated_confidence", "resolved", "ord", scratch).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for run in (None, "a", "b", "c"):
        own = sorted((c, o, y) for r, c, y, o in rows if r == run)
        for c, o, y in own:
            same, below, above = [(p, v) for d, p, v in own if d == c], [v for d, _, v in own if d < c], [v for d, _, v in own if d > c]
            want.append((run, o, len(own), len(below), len(above), sum(p <= o for p, _ in same), sum(v for p, v in same if p <= o), sum(above), len(below) - sum(below), len(same) - sum(v for _, v in same)))
    assert got == sorted(want, key=str)


# ---------------------------------------------------------------- raw tool calls


def test_file_edits_and_paths(spark):
    rows = [
        ("one", '[{"type":"diff","path":"/a","old_text":null,"new_text":"n"}]', [("/a", None, "n")]),
        ("two", '[{"type":"diff","path":"/a","old_text":"o","new_text":"n"},{"type":"diff","path":"/b","new_text":""}]', [("/a", "o", "n"), ("/b", None, "")]),
        ("mixed", '[{"type":"diff","path":"/a","new_text":"n"},{"type":"content"}]', None),
        ("number", '[{"type":"diff","path":7,"new_text":"n"}]', None), ("old", '[{"type":"diff","path":"/a","old_text":1,"new_text":"n"}]', None),
        ("bare", "[]", None), ("null", None, None), ("odd", '[1]', None), ("object", '{"type":"diff"}', None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "k string, content string").withColumn("e", acp.file_edits(F.col("content")))
    assert {r["k"]: [tuple(e) for e in r["e"]] if r["e"] is not None else None for r in df.collect()} == {k: want for k, _, want in rows}
    asked = [
        ("edit", '{"file_path":"/f","path":"/p"}', None, "completed", ("edit", "/f", None)), ("read", '{"path":"/p"}', None, "completed", ("view", "/p", None)),
        ("edit", '{"file_path":null,"path":"/p"}', None, "completed", (None, None, acp.NO_PATH)), ("edit", '{"changes":{"/c":1}}', None, "completed", ("edit", "/c", None)),
        ("edit", '{"changes":{"/c":1,"/d":2}}', rows[0][1], "completed", ("edit", "/a", None)), ("edit", "[]", rows[1][1], "completed", (None, None, acp.NO_PATH)),
        ("edit", "[]", rows[1][1], "failed", (None, None, None)), ("read", '{"command":null}', None, "completed", (None, None, None)), ("execute", '{"path":"/p"}', None, "completed", (None, None, None)), ("read", None, rows[0][1], "completed", ("view", "/a", None)),
    ]
    calls = spark.createDataFrame([r[:4] for r in asked], "k string, i string, c string, s string")
    got = calls.select(acp.file_operation(F.col("k"), F.col("i"), acp.file_edits(F.col("c")), F.col("s")).alias("f")).collect()
    assert [tuple(r["f"]) for r in got] == [r[4] for r in asked]


def test_raw_calls_are_condensed(spark):
    kind = "traj string, idx int, tool_call_id string, call_kind string, title string, status string, raw_input string, raw_output string, content string"
    diff = '[{"type":"diff","path":"/x","old_text":"a\\nb","new_text":"a\\nc"}]'
    rows = [
        ("t", 0, "c1", "execute", "Run", "pending", '{"command":"ls","call_id":"9","description":"List"}', None, None),
        ("t", 1, "c2", "edit", "Edit", "pending", '{"path":"/x"}', None, None),
        ("t", 2, "c1", None, None, "running", None, None, None),
        ("t", 3, "c1", None, None, "completed", None, '{"formatted_output":"out","exit_code":0}', None),
        ("t", 4, "c2", None, None, "completed", None, None, diff),
        ("t", 5, "c3", "fetch", "Look", "completed", "{}", None, None),
    ]
    calls = spark.createDataFrame(rows, kind)
    cited = spark.createDataFrame([("t", 3)], "traj string, step int")
    got = {r["idx"]: r["summary"] for r in acp.condense_raw_calls(calls, cited).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5] and got[5] is None  # the cited call stays, the snapshot between goes
    assert got[0] == "<summarized_action step=1>\nList\n</summarized_action>" and got[1] == "<summarized_action step=2>\nedit edit: /x\n</summarized_action>"
    assert got[3] == "<summarized_observation step=1>\nTool: execute\nStatus: completed\nOutput:\nout\n</summarized_observation>"
    assert got[4].startswith("<summarized_observation step=2>\nTool: edit\nOperation: edit\nPath: /x\nStatus: success\nChanged lines: ")
    outputs = {r["tool_call_id"]: (r["output"], r["shown_input"]) for r in acp.calls_of(calls).collect()}
    assert outputs["c1"][0] == "out" and json.loads(outputs["c1"][1]) == {"command": "ls", "summary": "List"} and outputs["c3"][0] == text.WEB_NOTE
    lost = spark.createDataFrame([("t", 0, "c", "execute", "Run", "completed", "{}", None, None)], kind)
    with pytest.raises(PySparkException, match="no output"):
        acp.calls_of(lost).collect()
    nameless = spark.createDataFrame([("t", 0, "c", "read", "Read", "completed", "{}", '"x"', None)], kind)
    with pytest.raises(PySparkException, match=acp.NO_PATH):
        acp.calls_of(nameless).collect()
