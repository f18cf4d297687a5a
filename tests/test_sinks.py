"""What the writers leave is what the readers find."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verity.plans import runner
from verity.sources import runs as sources
from verity.sources import sinks, store


def test_results_round_trip(spark, tmp_path):
    rows = [("i", "m", "b", None, 1, 0.5, -1, -1, None), ("j", "m", "b", ">4 hours", 0, 0.25, 10, 4, 0.5)]
    df = spark.createDataFrame(rows, sources.RESULTS)
    path = tmp_path / "base" / "run-a" / "results.csv"
    sinks.results_csv(df, str(path))
    got = spark.read.schema(sources.RESULTS).csv(str(path), header=True).orderBy("instance_id").collect()
    assert [tuple(r) for r in got] == rows


def test_a_killed_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    kind, key, path = "run string, instance_id string, model string, confidence double", ["run", "instance_id", "model"], str(tmp_path / "store")
    one = lambda i, c: spark.createDataFrame([("r", i, "m", c)], kind)
    state = lambda: {r["instance_id"]: r["confidence"] for r in store.read_store(spark, path).collect()}
    assert store.read_store(spark, path) is None
    store.write_store(one("a", 0.1), key, path)
    first = store.read_store(spark, path)
    store.write_store(one("b", 0.2), key, path)
    assert state() == {"a": 0.1, "b": 0.2} and first.count() == 1  # a reader that has begun
    switch = store._switch

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_switch", killed)  # after the rows, before the name
    with pytest.raises(KeyboardInterrupt):
        store.write_store(one("a", 0.9), key, path)
    assert state() == {"a": 0.1, "b": 0.2}
    broken = one("a", 0.9).withColumn("confidence", F.raise_error(F.lit("gone")).cast("double"))
    with pytest.raises(Exception, match="gone"):
        store.write_store(broken, key, path)
    assert state() == {"a": 0.1, "b": 0.2}
    monkeypatch.setattr(store, "_switch", switch)
    store.write_store(one("a", 0.5), key, path)
    assert state() == {"a": 0.5, "b": 0.2}
    names = [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")]
    assert len(names) == 3 and store.CURRENT in names  # the version before stays, what was broken off is gone


def test_cohorts_go_on_where_they_were_broken_off(spark, tmp_path):
    rows, path, seen = spark.range(10).withColumnRenamed("id", "ord"), str(tmp_path / "run"), []

    def phase(name, fails_at=None):
        def run(df):
            cohort = df.first()["cohort"]
            if cohort == fails_at:
                raise RuntimeError("broken off")
            seen.append((cohort, name))
            return df.withColumn("twice", F.col("ord") * 2) if name == "one" else df.where("ord % 2 = 0")

        return name, run

    with pytest.raises(RuntimeError):
        runner.run_cohorts(rows, [phase("one"), phase("two", fails_at=1)], 4, path)
    assert seen == [(0, "one"), (0, "two"), (1, "one")]
    done = runner.run_cohorts(rows, [phase("one"), phase("two")], 4, path)
    assert seen == [(0, "one"), (0, "two"), (1, "one"), (1, "two"), (2, "one"), (2, "two")]
    assert sorted((r["cohort"], r["ord"], r["twice"]) for r in done.collect()) == [(i // 4, i, 2 * i) for i in range(0, 10, 2)]
    assert sorted(map(tuple, runner.finished_phases(spark, path).collect())) == [(0, "one", 4), (0, "two", 2), (1, "one", 4), (1, "two", 2), (2, "one", 2), (2, "two", 1)]


def test_graph_documents_and_flat_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("g", 1, "b", 0.5), ("g", 0, "a", -1.0)], "gid string, pos int, id string, confidence double")
    edges = spark.createDataFrame([("g", 0, "b", "a", "proves")], "gid string, pos int, source string, target string, relationship_type string")
    sinks.graph_json(nodes, edges, str(tmp_path / "graphs"))
    doc = spark.read.json(str(tmp_path / "graphs")).first()
    assert [n["id"] for n in doc["nodes"]] == ["a", "b"] and doc["edges"][0]["source"] == "b"
    nested = nodes.select("id", F.struct("pos", "confidence").alias("x"), F.array("pos").alias("l"))
    sinks.flat_csv(nested, str(tmp_path / "flat"))
    flat = spark.read.csv(str(tmp_path / "flat"), header=True)
    assert flat.columns == ["id", "x_pos", "x_confidence", "l"] and {r["l"] for r in flat.collect()} == {"[0]", "[1]"}


def test_failures_append_and_metrics_overwrite(spark, tmp_path):
    one = spark.createDataFrame([("i", "m", "e")], "instance_id string, model string, error string")
    for _ in range(2):
        sinks.failures(one, str(tmp_path / "failures"))
        sinks.metrics_json(one, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "failures")).count() == 2 and spark.read.json(str(tmp_path / "metrics")).count() == 1
