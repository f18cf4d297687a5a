"""Soft-membership mixing: domain posteriors, and document rates by projected-gradient least squares."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut
from verity.llm.nets import WORD, Adam, HashedIds

#: Hashed word columns of the classifier and the bound of its sample: labelled rows.
BUCKETS, SAMPLE = 1 << 12, 4000
EPOCHS, BATCH = 25, 64
#: Steps of the descent at most, the relative error at which it ends, and how much rates are drawn to one.
STEPS, TOLERANCE, PULL = 60, 1e-6, 1e-8


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # BUCKETS + 1 rows; the last is the bias

    def features(self, words: list[str], ids_of: HashedIds) -> np.ndarray:
        counts = np.bincount(ids_of.of(words), minlength=BUCKETS) if words else np.zeros(BUCKETS)
        x = np.log1p(counts)
        return np.append(x / max(float(np.linalg.norm(x)), 1e-9), 1.0).astype(np.float32)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = 4 * x @ self.weights
        if not self.domains:
            return z
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)


def learn_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 17) -> DomainModel:
    """Softmax regression on a bounded sample of ``labelled`` (id, ``domain``), taken by a hash of the
    id. Null ids and domains teach nothing; of an id with several domains or texts the smallest counts."""
    known = labelled.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min("domain").alias("domain"))
    some = known.orderBy(F.xxhash64("i"), "i").limit(sample)
    empty = DomainModel([], np.zeros((BUCKETS + 1, 0), np.float32))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = HashedIds(BUCKETS)
        for batch in batches:
            x = [empty.features(WORD.findall((t or "").lower()), ids_of).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(0)], names=["x", "domain"])

    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(some), "i").groupBy("i", "domain").agg(F.min("t").alias("t")).select("domain", "t")
    rows = sorted(((r["domain"], bytes(r["x"])) for r in texts.mapInArrow(read, "x binary, domain string").collect()))
    if not rows:
        return empty
    domains = sorted({d for d, _ in rows})
    model = DomainModel(domains, np.zeros((BUCKETS + 1, len(domains)), np.float32))
    x = np.stack([np.frombuffer(b, np.float16) for _, b in rows]).astype(np.float32)
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(d) for d, _ in rows]]
    rng, adam = np.random.default_rng(seed), Adam([model.weights], 0.02)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            adam.step([x[own].T @ (model.posterior(x[own]) - y[own]) / len(own) + 1e-5 * model.weights])
    return model


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``tokens``, ``posterior``): the words and signs of the whole text, and the domains' shares."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = HashedIds(BUCKETS)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                words = [WORD.findall((t or "").lower()) for t in part.column(1).to_pylist()]
                p = told.value.posterior(np.stack([told.value.features(w, ids_of) for w in words])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "tokens", "posterior"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(over, f"doc_id {kind}, tokens long, posterior array<double>").withColumnRenamed("doc_id", id_col)


def _rate(numbers: np.ndarray) -> Column:
    out = F.lit(1.0)
    for j, x in enumerate(numbers):
        out = out - F.element_at("posterior", j + 1) * F.lit(float(x))
    return F.greatest(F.lit(0.0), out)


def fit_rates(members: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, pull: float = PULL) -> tuple[Column, np.ndarray]:
    """(rate as an expression over ``posterior``, expected domain tokens that these rates reach).

    Minimises the squared error of the expected domain tokens, in the metric of the domains' second
    moments, over nonnegative rates; of the rates that do, those nearest to one (``pull``). Projected
    gradient in its lazy form: steps add up in one number per domain, and a document's rate is the
    projection max(0, 1 - posterior . numbers), so nothing that grows with the corpus is kept. A
    step is the gradient in the metric of the second moments of the documents that are not at zero,
    halved until the (concave) dual objective grows enough. Each trial is one distributed sum.
    """
    k = len(targets)
    at = lambda j: F.element_at("posterior", j + 1)
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(numbers: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of these numbers: tokens times squared rates, expected domain tokens, second moments."""
        own = members.select(F.col("tokens").cast("double").alias("tokens"), "posterior", _rate(numbers).alias("_r"))
        inside = F.when(F.col("_r") > 0, F.col("tokens")).otherwise(0.0)
        asked = [F.sum(F.col("tokens") * F.col("_r") * F.col("_r")).alias("s")]
        asked += [F.sum(F.col("tokens") * F.col("_r") * at(j)).alias(f"t{j}") for j in range(k)]
        asked += [F.sum(inside * at(i) * at(j)).alias(f"m{i}_{j}") for i, j in cells]
        got = own.agg(*asked).first()
        return got["s"] or 0.0, np.array([got[f"t{j}"] or 0.0 for j in range(k)]), np.array([[got[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    numbers = np.zeros(k)
    squares, reached, inside = sums(numbers)
    moments = inside
    value = lambda n, squares: -squares / 2 - n @ targets - pull / 2 * n @ moments @ n
    size = tolerance * max(1.0, float(targets.sum()))
    for _ in range(steps):
        gradient = reached - targets - pull * moments @ numbers
        if np.abs(gradient).sum() <= size:
            break
        metric = inside + pull * moments + 1e-12 * max(float(np.trace(moments)), 1e-9) / k * np.eye(k)
        step, now, share = np.linalg.solve(metric, gradient), value(numbers, squares), 1.0
        while True:
            tried = sums(numbers + share * step)
            if share < 1e-6 or value(numbers + share * step, tried[0]) >= now + 1e-4 * share * step @ gradient - 1e-12 * abs(now):
                break
            share /= 2
        numbers = numbers + share * step
        squares, reached, inside = tried
    return _rate(numbers), reached


def mix(members: DataFrame, model: DomainModel, weights: dict[str, float], budget: float | None = None, steps: int = STEPS) -> DataFrame:
    """``members`` with ``domain`` (likeliest), ``share`` (its posterior), ``rate``, and ``target_gap``:
    by how much of their sum the expected domain tokens miss their targets (one number for all rows; it
    is above zero where no nonnegative rates meet them).

    ``weights`` are the wanted shares of expected tokens; domains that were not learned are left out
    and the rest made to sum to one. ``budget`` is the expected tokens in all; by default the domain of
    the greatest weight keeps what it has. Without domains or tokens every rate is one and the gap null.

    * Empty and null texts have no tokens; their rate follows from their posterior like any other.
    * Repeated rows repeat; null ids are kept; an empty table gives an empty result.
    """
    table = cut(members, "mixing-members")
    k = len(model.domains)
    wanted = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    sums = table.agg(*[F.sum(F.col("tokens") * F.element_at("posterior", j + 1)).alias(f"t{j}") for j in range(k)]).first() if k else []
    have = np.array([x or 0.0 for x in sums])
    if not k or not wanted.sum() or not have.sum():
        rate, gap = F.lit(1.0), None
    else:
        wanted = wanted / wanted.sum()
        top = int(wanted.argmax())
        total = budget if budget is not None else float(have[top] / wanted[top])
        rate, reached = fit_rates(table, wanted * total, steps)
        gap = float(np.abs(reached - wanted * total).sum() / max(total, 1e-9))
    names = F.array(*map(F.lit, model.domains)).cast("array<string>")
    best = F.array_max("posterior")
    return table.select("*", F.element_at(names, F.array_position("posterior", best).cast("int")).alias("domain") if k else F.lit(None).cast("string").alias("domain"), best.alias("share"), rate.alias("rate"), F.lit(gap).cast("double").alias("target_gap"))


def copies(rate: Column, *seed: Column) -> Column:
    """How often a row of this rate is taken: its whole part, and one more by a hash of ``seed`` with
    the chance of the rest."""
    draw = F.pmod(F.xxhash64(F.lit(29), *seed), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")
