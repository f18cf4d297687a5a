import numpy as np
import pytest
from pyspark.sql import functions as F

from verity.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def brute_rates(tokens, p, targets, steps=200_000):
    """Least squares over nonnegative rates by plain accelerated projected gradient, until nothing moves."""
    a = (tokens[:, None] * p).T
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-9)
    r = y = np.ones(len(tokens))
    t, last = 1.0, np.inf
    for _ in range(steps):
        new = np.maximum(0, y - p @ (inverse @ (a @ y - targets)))
        gap = a @ new - targets
        error = gap @ inverse @ gap
        if error < 1e-16 or np.abs(new - r).max() < 1e-12:
            return new, a @ new
        t = 1.0 if error > last else t
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, y, t, last = new, new + (t - 1) / after * (new - r), after, error
    return r, a @ r


@pytest.mark.parametrize("targets", [[300.0, 900.0, 40.0], [1500.0, 10.0, 10.0], [5.0, 5.0, 900.0], [1500.0, 0.0, 0.0]])
def test_rates_against_brute_force(spark, targets):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 60, 50)
    p = rng.dirichlet([0.3, 0.3, 0.3], 50)
    members = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, posterior array<double>")
    rate, reached = mixing.fit_rates(members, np.array(targets))
    _, totals = brute_rates(tokens.astype(float), p, np.array(targets))
    got = np.array([r.rate for r in members.withColumn("rate", rate).orderBy("doc_id").collect()])
    assert (got >= 0).all()
    np.testing.assert_allclose(reached, (tokens * got) @ p, rtol=1e-9)
    np.testing.assert_allclose(reached, totals, atol=2e-3 * sum(targets))
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-9)
    slope = p @ (inverse @ (reached - targets))  # no rate can move to lower the error
    assert (slope > -1e-3).all() and np.abs(slope[(got > 1e-6) & (tokens > 0)]).max() < 1e-3


def test_query_meets_its_targets(spark):
    rows = queries.op6_source_mixing(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {r.target_gap < 1e-3 for r in rows} == {True}
    totals = np.sum([np.array(r.posterior) * r.tokens * r.rate for r in rows], axis=0)
    shares = totals / totals.sum()
    model_domains = sorted({d for d in queries.TARGET_WEIGHTS})
    assert all(r.domain in model_domains for r in rows) and all(r.rate >= 0 for r in rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    domains = sorted(r.domain for r in queries.domains_of(labels).select("domain").distinct().collect())
    want = np.array([queries.TARGET_WEIGHTS[d] for d in domains])
    np.testing.assert_allclose(shares, want / want.sum(), atol=1e-3)


def test_classifier_tells_domains(spark):
    docs = spark.createDataFrame([(i, f"red rose {i}" if i % 2 else f"blue sea {i}") for i in range(200)], "doc_id long, text string")
    model = mixing.learn_domains(docs, docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, "r").otherwise("b").alias("domain")))
    rows = mixing.mix(mixing.memberships(docs, model), model, {"r": 3.0, "b": 1.0}).collect()
    assert all(r.domain == ("r" if r.doc_id % 2 else "b") and r.share > 0.7 for r in rows)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x y", 3), (4, "z " * 100_000, 4), (4, "z " * 100_000, 4)], "doc_id long, text string, tokens int")
    none = docs.select("doc_id", F.lit(None).cast("string").alias("domain"))
    model = mixing.learn_domains(docs, none)
    rows = mixing.mix(mixing.memberships(docs, model), model, {"r": 1.0}).collect()
    assert len(rows) == 5 and all(r.rate == 1 and r.domain is None and r.target_gap is None for r in rows)
    some = mixing.learn_domains(docs, docs.select("doc_id", F.lit("r").alias("domain")))
    rows = mixing.mix(mixing.memberships(docs, some), some, {"r": 1.0}, budget=1000.0).collect()
    assert len(rows) == 5 and all(r.domain == "r" for r in rows)
    assert mixing.mix(mixing.memberships(docs.limit(0), some), some, {"r": 1.0}).count() == 0


def test_copies(spark):
    got = [r.n for r in spark.range(4000).select(mixing.copies(F.lit(2.25), F.col("id")).alias("n")).collect()]
    assert set(got) == {2, 3} and abs(np.mean(got) - 2.25) < 0.03
