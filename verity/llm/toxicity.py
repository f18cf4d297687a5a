"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

The network learns from a bounded sample of each class. Its thresholds do not: they are set from the scores
of all labelled rows that it did not learn from (``all_cuts``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut
from verity.llm.language_id import LanguageModel
from verity.llm.nets import REMEMBERED, WORD, Adam, best_threshold, recentre, sigmoid

#: Rows of the embedding table for whole words and for beginnings of words of each length, and their
#: width. A beginning counts only if the word goes on after it.
WORDS, STEMS, STEM_CHARS, DIM = 1 << 14, 1 << 13, (3, 5, 7), 16
LOOKS = 1 + len(STEM_CHARS)
#: Widths of the filters in words, and filters of each width.
WIDTHS, FILTERS = (1, 2, 3), 16
#: Bound of the training sample: labelled rows of each class.
PER_CLASS = 3000
EPOCHS, BATCH = 12, 64
#: Logits are told apart so finely, and up to this size, where thresholds are set: the driver gets the counts of
#: 2 x LOGIT_MOST x LOGIT_STEPS steps a language, whatever the number of rows.
LOGIT_STEPS, LOGIT_MOST = 256, 20
#: Toxic rows of a language from which it has a threshold of its own.
LEAST_TOXIC = 10
#: Share of the words that a training step leaves out, and the decay of the embeddings.
WORD_DROPOUT, DECAY = 0.2, 1e-5
PAD = WORDS + LOOKS * STEMS

def _ids(word: str) -> list[int]:
    """The rows of a word and of its beginnings; a beginning that is the whole word is no row."""
    raw = lambda w, salt: zlib.crc32(salt + w.encode("utf-8", "surrogatepass"))
    stems = [WORDS + k * STEMS + raw(word[:n], b"s") % STEMS if len(word) > n else PAD for k, n in enumerate(STEM_CHARS)]
    return [raw(word, b"w") % WORDS, *stems]


class Reader:
    """Texts to their words' rows in the embedding table, one line for each way to look at a word.
    Remembers the words it has met; a full memory starts anew."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, LOOKS), np.int32)

    def _learn(self, word: str) -> int:
        at = self.place[word] = len(self.place)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = _ids(word)
        return at

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if len(self.place) > REMEMBERED:
            self.place.clear()
        known = self.place.get
        at = [i if (i := known(w)) is not None else self._learn(w) for w in words]
        return self.table[at].T.copy() if at else np.zeros((LOOKS, 0), np.int32)


def spoken(texts: list[str | None], languages: LanguageModel | None) -> list[str]:
    """The language of each text, told from the text alone, for its threshold."""
    return languages.predict(texts)[0] if languages else [""] * len(texts)


@dataclass
class ToxicityModel:
    embed: np.ndarray  # PAD + 1 rows; the last is the pad, always zero
    filters: np.ndarray  # DIM x sum(WIDTHS) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    cuts: dict[str, float] = field(default_factory=dict)
    languages: LanguageModel | None = None
    trained: list = field(default_factory=list)  # ids that the network has learned from

    @staticmethod
    def new(seed: int = 5) -> ToxicityModel:
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        embed = rng.normal(0, 0.02, (PAD + 1, DIM)).astype(np.float32)
        embed[PAD] = 0
        return ToxicityModel(embed, rng.normal(0, 0.3, (DIM, sum(WIDTHS), FILTERS)).astype(np.float32), np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), np.zeros(1, np.float32))

    def pooled(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Greatest response of each filter in each text, with what the gradient needs."""
        gap = np.full((LOOKS, max(WIDTHS) - 1), PAD, np.int32)
        one = np.full((LOOKS, 1), PAD, np.int32)
        flat = np.concatenate([x for d in docs for x in (d if d.shape[1] else one, gap)], axis=1)
        sizes = np.array([max(1, d.shape[1]) for d in docs])
        starts = np.r_[0, np.cumsum(sizes + gap.shape[1])[:-1]]
        edges = np.stack([starts, starts + sizes], axis=1).ravel()
        vectors = sum(self.embed[row] for row in flat)
        seen = vectors @ self.filters.reshape(DIM, -1)
        answers, k = [], 0
        for width in WIDTHS:
            own = seen[:, k * FILTERS : (k + 1) * FILTERS].copy()
            for j in range(1, width):
                own[:-j] += seen[j:, (k + j) * FILTERS : (k + j + 1) * FILTERS]
            answers.append(own)
            k += width
        top = np.concatenate([np.maximum.reduceat(a, edges, axis=0)[::2] for a in answers], axis=1) + self.bias
        return top, flat, answers, np.stack([starts, sizes])

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(docs)[0], 0) @ self.out + self.out_bias

    def score(self, read: list[tuple[np.ndarray, str]]) -> np.ndarray:
        raw = sigmoid(self.logits([d for d, _ in read]).astype(np.float64))
        return recentre(raw, np.array([self.cuts.get(s, self.cuts.get("", 0.5)) for _, s in read]))


def _gradients(model: ToxicityModel, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    top, flat, answers, (starts, sizes) = model.pooled(docs)
    active = np.maximum(top, 0)
    error = (weights * (sigmoid(active @ model.out + model.out_bias) - labels)).astype(np.float32) / len(docs)
    back = np.outer(error, model.out) * (top > 0)
    g_embed, g_filters = np.zeros_like(model.embed), np.zeros_like(model.filters)
    k = 0
    for w, width in enumerate(WIDTHS):
        own = answers[w]
        where = np.stack([own[a : a + n].argmax(axis=0) + a for a, n in zip(starts, sizes, strict=True)])
        g = back[:, w * FILTERS : (w + 1) * FILTERS]
        for j in range(width):
            at = np.minimum(where + j, flat.shape[1] - 1)
            for row in flat[:, at]:
                g_filters[:, k + j] += np.einsum("nfd,nf->df", model.embed[row], g)
                np.add.at(g_embed, row.ravel(), (g[:, :, None] * model.filters[:, k + j].T[None]).reshape(-1, DIM))
        k += width
    g_embed[PAD] = 0
    return [g_embed, g_filters, back.sum(axis=0), active.T @ error, error.sum(keepdims=True)]


def fit(docs: list[tuple[np.ndarray, str]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ToxicityModel:
    """Train on four fifths of the rows; the last fifth sets each language's threshold."""
    model = ToxicityModel.new(seed)
    if len(set(labels.tolist())) < 2:
        model.out[:], model.out_bias[:] = 0, (3.0 if labels.size and labels[0] else -3.0)
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    check, train = order[: len(docs) // 5], order[len(docs) // 5 :]
    adam = Adam([model.embed, model.filters, model.bias, model.out, model.out_bias], 0.01)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            part = train[at : at + BATCH]
            own = [docs[i][0] for i in part]
            own = [d[:, rng.random(d.shape[1]) >= WORD_DROPOUT] for d in own]
            steps = _gradients(model, own, labels[part], np.ones(len(part), np.float32))
            steps[0] += DECAY * model.embed
            adam.step(steps)
    held = check if len(set(labels[check].tolist())) == 2 else order
    raw = np.concatenate([sigmoid(model.logits([docs[i][0] for i in held[a : a + BATCH]]).astype(np.float64)) for a in range(0, len(held), BATCH)])
    model.cuts = cuts_of(raw, labels[held], weights[held], np.array([docs[i][1] for i in held]))
    model.trained = train.tolist()
    return model


def cuts_of(raw: np.ndarray, labels: np.ndarray, weights: np.ndarray, tongues: np.ndarray, rows: np.ndarray | None = None) -> dict[str, float]:
    """The threshold of all, and of each language with LEAST_TOXIC toxic rows. ``rows`` that an entry stands for."""
    rows = np.ones(len(raw)) if rows is None else rows
    cuts = {"": best_threshold(raw, labels, weights)}
    for name in sorted(set(tongues)):
        own = tongues == name
        if (rows * labels)[own].sum() >= LEAST_TOXIC:
            cuts[str(name)] = best_threshold(raw[own], labels[own], weights[own])
    return cuts


def learn_toxicity(sample: DataFrame, languages: LanguageModel | None = None) -> ToxicityModel:
    """Fit on a bounded sample (doc_id, text, label, weight). Executors turn whole texts into ids.
    ``languages`` tells each text's language, for thresholds by language; without it all share one."""
    told = sample.sparkSession.sparkContext.broadcast(languages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader(t).astype("<i4").tobytes() for t in texts], pa.binary()), pa.array(spoken(texts, told.value), pa.string()), batch.column(2), batch.column(3)], names=["doc_id", "ids", "tongue", "label", "weight"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "label", "weight").mapInArrow(read, f"doc_id {kind}, ids binary, tongue string, label int, weight double").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["ids"])))
    docs = [(np.frombuffer(bytes(r["ids"]), "<i4").reshape(LOOKS, -1), r["tongue"]) for r in rows]
    model = fit(docs, np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows]))
    model.languages, model.trained = languages, [rows[i]["doc_id"] for i in model.trained]
    return model


def logits_of(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tongue, logit) of each row of ``docs``: what the network says of the whole text, and its language,
    told from the text alone."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                logits = told.value.logits([reader(t) for t in texts]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spoken(texts, told.value.languages), pa.string()), pa.array(logits)], names=["doc_id", "tongue", "logit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(over, f"doc_id {kind}, tongue string, logit double").withColumnRenamed("doc_id", id_col)


def all_cuts(scored: DataFrame, known: DataFrame, model: ToxicityModel) -> dict[str, float]:
    """Thresholds from all rows of ``scored`` (doc_id, tongue, logit) with a label in ``known`` (doc_id, label)
    that the network did not learn from, counted by label and step of the logit. Each class weighs as much
    as all its rows do, with those that the network learned from. Where one class has no other rows, all count."""
    spark = scored.sparkSession
    learned = spark.createDataFrame([(i,) for i in model.trained], f"doc_id {scored.schema['doc_id'].dataType.simpleString()}").withColumn("learned", F.lit(1))
    step = F.floor(F.greatest(F.least(F.col("logit"), F.lit(float(LOGIT_MOST))), F.lit(-float(LOGIT_MOST))) * LOGIT_STEPS).alias("step")
    rows = scored.join(known, "doc_id").join(F.broadcast(learned), "doc_id", "left").groupBy("tongue", "label", step, F.col("learned").isNotNull().alias("learned")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    free = rows[~rows["learned"]]
    if free["label"].nunique() < 2:
        free = rows
    if free["label"].nunique() < 2:
        return model.cuts
    share = rows.groupby("label")["n"].sum() / free.groupby("label")["n"].sum()
    free = free.groupby(["tongue", "label", "step"], as_index=False)["n"].sum()
    n = free["n"].to_numpy(np.float64)
    raw = sigmoid((free["step"].to_numpy(np.float64) + 0.5) / LOGIT_STEPS)
    return cuts_of(raw, free["label"].to_numpy(), n * share[free["label"]].to_numpy(), free["tongue"].to_numpy(), n)


def centred(scored: DataFrame, cuts: dict[str, float], id_col: str = "doc_id") -> DataFrame:
    """(id, score) of (id, tongue, logit): the language's threshold comes to lie at one half."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([cuts.get(s, cuts.get("", 0.5)) for s in batch.column(1).to_pylist()])
            scores = recentre(sigmoid(batch.column(2).to_numpy(zero_copy_only=False)), own) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = scored.schema[id_col].dataType.simpleString()
    return scored.select(F.col(id_col), "tongue", "logit").mapInArrow(over, f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: the id and ``score`` (0 to 1) of the whole text.

    Null and empty texts are scored as one pad word. The language's threshold lies at one half, and
    the language is told from the text alone. Thresholds are the model's, or with ``known`` (doc_id, label)
    set from the scores of all those rows (``all_cuts``); each text is read once. Other columns are not
    looked at; repeated rows repeat; an empty table gives an empty result.
    """
    scored = logits_of(docs, model, id_col, text_col)
    if known is None:
        return centred(scored, model.cuts, id_col)
    scored = cut(scored, "toxicity-logits")
    return centred(scored, all_cuts(scored.withColumnRenamed(id_col, "doc_id"), known, model), id_col)
