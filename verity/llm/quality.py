"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.nets import WORD, Adam, HashedIds, sigmoid, temperature

#: Buckets of the word table, width of the vectors, non-zero places of an index vector, and the
#: words on each side that are the context.
BUCKETS, DIM, ONES, SIDE = 1 << 14, 32, 4, 2
#: Smoothing of frequent words when vectors are pooled.
COMMON = 1e-3
#: Bound of the training sample: labelled rows of each class.
PER_CLASS = 3000
HIDDEN, EPOCHS, BATCH = 32, 60, 64
FEATURES = 3 * DIM + 2


def index_vectors(seed: int = 11) -> np.ndarray:
    """The sparse random +1/-1 vector of each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.int8)
    for row in out:
        row[rng.choice(DIM, ONES, replace=False)] = rng.choice([-1, 1], ONES)
    return out


def context_sums(ids: np.ndarray, index: np.ndarray, into: np.ndarray, counts: np.ndarray) -> None:
    """Add each word's neighbours' index vectors to the word's row."""
    counts += np.bincount(ids, minlength=BUCKETS)
    if len(ids) < 2:
        return
    own = index[ids].astype(np.int16)
    near = np.zeros_like(own)
    for step in range(1, min(SIDE, len(ids) - 1) + 1):
        near[step:] += own[:-step]
        near[:-step] += own[step:]
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    into[ids[order][first]] += np.add.reduceat(near[order].astype(np.int64), first, axis=0)


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, counts) by bucket, from every row's whole text. Tasks send sums of whole
    numbers, so the result does not depend on how rows are dealt; its size is fixed."""
    index = docs.sparkSession.sparkContext.broadcast(index_vectors())
    names = ["bucket", "n", *(f"v{i}" for i in range(DIM))]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = HashedIds(BUCKETS)
        sums, counts = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    context_sums(ids_of.of(WORD.findall(text.as_py())), index.value, sums, counts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, counts[seen], *sums[seen].T)], names=names)

    parts = docs.select(F.col(text_col)).mapInArrow(over, ", ".join(f"{n} long" for n in names))
    got = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]]).toPandas()
    vectors, counts = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS, np.int64)
    if len(got):
        raw = got[names[2:]].to_numpy(np.float64)
        vectors[got["bucket"]] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        counts[got["bucket"]] = got["n"]
    return vectors, counts


def pool(ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted mean, deviation, and mean step between neighbours, of a document's word vectors,
    with its length and its share of repeated neighbours' directions."""
    out = np.zeros(FEATURES, np.float32)
    if not len(ids):
        return out
    own, w = vectors[ids], weights[ids][:, None]
    mean = (own * w).sum(axis=0) / max(float(w.sum()), 1e-9)
    out[:DIM] = mean
    out[DIM : 2 * DIM] = own.std(axis=0)
    if len(ids) > 1:
        step = np.abs(own[1:] - own[:-1])
        out[2 * DIM : 3 * DIM] = step.mean(axis=0)
        out[-1] = (step.sum(axis=1) < 1e-6).mean()
    out[-2] = np.log1p(len(ids))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def pooled(self, texts: list[str | None], ids_of: HashedIds) -> np.ndarray:
        return np.stack([pool(ids_of.of(WORD.findall(t or "")), self.vectors, self.weights) for t in texts])

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features).astype(np.float64) / self.temperature)


def train(model: QualityModel, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 13) -> QualityModel:
    """Two layers by Adam on four fifths of the rows; the last fifth sets the temperature."""
    if len(set(labels.tolist())) < 2:
        model.layers[3][:] = 3.0 if labels.size and labels[0] else -3.0
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(features))
    check, own = order[: len(order) // 5], order[len(order) // 5 :]
    model.centre, model.scale = features[own].mean(axis=0), features[own].std(axis=0) + 1e-4
    w1, b1, w2, b2 = model.layers
    w1[:], w2[:] = rng.normal(0, 0.15, w1.shape), rng.normal(0, 0.15, w2.shape)
    adam = Adam(model.layers, 0.003)
    x = ((features - model.centre) / model.scale).astype(np.float32)
    each = (weights / weights.mean()).astype(np.float32)
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for at in range(0, len(own), BATCH):
            part = own[at : at + BATCH]
            hidden = np.tanh(x[part] @ w1 + b1)
            error = (each[part] * (sigmoid(hidden @ w2 + b2) - labels[part])).astype(np.float32) / len(part)
            back = np.outer(error, w2) * (1 - hidden * hidden)
            adam.step([x[part].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ error + 1e-4 * w2, error.sum(keepdims=True)])
    held = check if len(set(labels[check].tolist())) == 2 else order
    model.temperature = temperature(model.logits(features[held]).astype(np.float64), labels[held], weights[held])
    return model


def learn_quality(docs: DataFrame, sample: DataFrame, text_col: str = "text") -> QualityModel:
    """Word vectors from all of ``docs``; the network from a bounded sample (doc_id, text, label,
    weight), of which only the pooled vectors come to the driver."""
    vectors, counts = word_vectors(docs, text_col)
    share = counts / max(1, counts.sum())
    model = QualityModel(vectors, (COMMON / (COMMON + share)).astype(np.float32), np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), [np.zeros((FEATURES, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32)])
    told = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = HashedIds(BUCKETS)
        for batch in batches:
            if batch.num_rows:
                pooled = told.value.pooled(batch.column(1).to_pylist(), ids_of)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in pooled], pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "pooled", "label", "weight"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "label", "weight").mapInArrow(read, f"doc_id {kind}, pooled binary, label int, weight double").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["pooled"])))
    features = np.stack([np.frombuffer(bytes(r["pooled"]), np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    return train(model, features, np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``score`` (0 to 1) of the whole text.

    Null and empty texts have a pooled vector of zeros and are scored as such. Other columns are not
    looked at; repeated rows repeat; an empty table gives an empty result.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = HashedIds(BUCKETS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = told.value.score(told.value.pooled(part.column(1).to_pylist(), ids_of))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(over, f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)
