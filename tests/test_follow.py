"""Chains that are followed to their ends at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_goldens import chain, values
from verity.operators import contract, graphs, propagate
from verity.plans.tables import Scratch


@pytest.mark.parametrize("ids", ["in order", "shuffled"])
def test_ends_and_functions_over_ranges(spark, ids):
    """Two chains, a loop, and a row that leads into the loop; each function adds one."""
    name = (lambda i: f"n{i}") if ids == "in order" else (lambda i: f"{i * 7919 % 1009}")
    links = [(g, name(i), name(i + 1), [1.0, 1.0, -1e300, 1e300]) for g in (1, 2) for i in range(300)]
    links += [(3, name(i), name((i + 1) % 50), [1.0, 1.0, -1e300, 1e300]) for i in range(50)] + [(3, "in", name(7), [1.0, 0.0, -1e300, 1e300])]
    rows = spark.createDataFrame(links, "gid long, id string, at string, f array<double>")
    with Scratch(spark) as scratch:
        got = {(r["gid"], r["id"]): (r["end"], r["f"]) for r in contract.follow(rows, len(links), contract.CLAMPED, scratch, range_rows=40).collect()}
    assert len(got) == len(links)
    for g in (1, 2):
        for i in range(300):
            end, f = got[g, name(i)]
            assert end == name(300) and f[:2] == [1.0, 300.0 - i]
    assert all(end is None for (g, _), (end, _) in got.items() if g == 3)


@pytest.mark.parametrize("algebra", [contract.CLAMPED, contract.MATRIX, contract.LOGS])
def test_arrays_compose_as_columns_do(spark, algebra):
    rng = np.random.default_rng(1)
    pairs = [(rng.random(algebra.width).round(3).tolist(), rng.random(algebra.width).round(3).tolist()) for _ in range(20)]
    pairs += [([0.0] * algebra.width, p[1]) for p in pairs[:2]] + [([p[0][0], -1e300, *p[0][2:]], p[1]) for p in pairs[:2]]
    rows = spark.createDataFrame(pairs, "f array<double>, g array<double>").select(F.array(*algebra.compose(F.col("f"), F.col("g"))).alias("h")).collect()
    f, g = (np.array([p[i] for p in pairs]).T for i in (0, 1))
    assert np.array([r["h"] for r in rows]) == pytest.approx(np.stack(algebra.within(f, g)).T)


@pytest.mark.parametrize("method", ["minimum", "arithmetic_mean", "interpolated"])
def test_a_chain_takes_one_round(spark, method):
    nodes, edges, leaf = chain(spark, 400)
    rule = contract.RULES[method] if method != "interpolated" else contract.interpolated("confidence_in_children", lambda p: F.lit(0.5), ("confidence_in_children",))
    known = nodes.where("confidence >= 0").select("gid", "id", F.col("confidence").alias("value"))
    got = {r["id"]: r["value"] for r in contract.evaluate(nodes, edges, known, rule, max_rounds=2).collect()}
    step = {"minimum": min, "arithmetic_mean": lambda a, b: (a + b) / 2, "interpolated": lambda a, b: 0.7 * a * b + 0.15}[method]
    v = leaf[-1] if method != "interpolated" else 0.7 * leaf[-1] + 0.15
    for i in reversed(range(400)):
        v = v if i == 399 else step(leaf[i], v)
        assert got[f"g{i}"] == pytest.approx(v, abs=1e-9)


def test_messages_write_as_many_tables_for_any_depth(spark, monkeypatch):
    made, write = [], Scratch.cut

    def counted(self, df, name):
        made.append(name)
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "cut", counted)
    tables = []
    for n in (20, 300):
        nodes, edges, _ = chain(spark, n)
        made.clear()
        assert len(values(propagate.belief_propagation(nodes, edges, 1))) == 2 * n
        tables.append(len(made))
    assert tables[0] == tables[1]


def test_greatest_steps_walk_levels_only_above_cycles(spark, monkeypatch):
    asked, walk = [], graphs.predecessor_levels

    def noted(targets, edges):
        asked.append(targets.count())
        return walk(targets, edges)

    monkeypatch.setattr(graphs, "predecessor_levels", noted)
    links = [("a", f"n{i + 1}", f"n{i}") for i in range(60)] + [("b", "p", "q"), ("b", "q", "p"), ("b", "e", "q")]
    steps = {("a", f"n{i}"): [i * 7 % 61] for i in range(0, 61, 9)} | {("b", "e"): [4, 9]}
    edges = spark.createDataFrame(links, "gid string, source string, target string")
    ids = sorted({(g, i) for g, *ends in links for i in ends})
    nodes = spark.createDataFrame([(g, i, steps.get((g, i), [])) for g, i in ids], "gid string, id string, step_numbers array<int>")
    got = {(r["gid"], r["id"]): r["max_step"] for r in graphs.max_cited_step(nodes, nodes, edges).collect()}
    want = {("a", f"n{i}"): max([-1, *[s for j in range(i, 61) for s in steps.get(("a", f"n{j}"), [])]]) for i in range(61)}
    assert got == want | {("b", i): 9 for i in "pqe"} and asked == [2]
    asked.clear()
    only = nodes.where("gid = 'a'")
    assert graphs.max_cited_step(only, only, edges.where("gid = 'a'")).count() == 61 and not asked


def test_summaries_of_cited_steps_equal_the_sets(spark, monkeypatch):
    """Trees of all shapes, one with ties of steps over many paths; a graph with shared children, a cycle, nodes alone."""
    rng = np.random.default_rng(5)
    links, steps = [], {}
    for g, reach in ((1, 1), (2, 3), (3, 40), (4, 10**6)):  # a chain, and trees ever wider
        for i in range(1, 120):
            links.append((g, f"n{i}", f"n{rng.integers(max(0, i - reach), i)}"))
        steps |= {(g, f"n{i}"): sorted(set(rng.integers(0, 90, rng.integers(0, 4)).tolist())) for i in range(120)}
    links += [(5, "b", "a"), (5, "c", "a"), (5, "d", "b"), (5, "d", "c"), (6, "p", "q"), (6, "q", "p"), (6, "e", "q"), (7, "y", "x"), (7, "y", "x")]
    steps |= {(5, "d"): [40000, 3], (5, "b"): [3, 7], (6, "e"): [1, 2], (6, "above"): [9], (7, "y"): [5], (8, "alone"): [6, 8]}
    edges = spark.createDataFrame(links, "gid long, source string, target string")
    ids = sorted({(g, i) for g, *ends in links for i in ends} | set(steps))
    nodes = spark.createDataFrame([(g, i, steps.get((g, i), [])) for g, i in ids], "gid long, id string, step_numbers array<int>")
    sets = {(r["gid"], r["id"]): r["steps"] for r in graphs.cited_steps(nodes, nodes, edges).collect()}
    asked, whole = [], graphs.cited_steps
    monkeypatch.setattr(graphs, "cited_steps", lambda targets, *rest: asked.append(targets.count()) or whole(targets, *rest))
    got = {(r["gid"], r["id"]): (r["n"], r["total"], r["first_steps"]) for r in graphs.cited_summary(nodes, nodes, edges).collect()}
    assert got == {k: (len(s), sum(s), s[:5]) for k, s in sets.items()} and set(got) == set(ids)
    assert asked == [6]  # of the graph with shared children, and of the cycle
