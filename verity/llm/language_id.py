"""Language identification by nearest clustered centroid of TF-IDF byte n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verity.llm.common import letters

#: Hashed n-gram columns, and the lengths (in UTF-8 bytes) of the n-grams.
COLUMNS, GRAMS = 4096, (2, 3)
#: Bound of what is learned from: rows of a language.
PER_LANGUAGE = 600
#: Centroids of a language.
CLUSTERS = 4
#: A text is rejected when its cosine, or its margin to the second language, is below this share of the
#: low percentile that held-out texts of its language and length reach.
SHARE, PERCENTILE = 0.5, 1.0
#: Levels of length, each four times the one before (in n-grams), rows of a language that are thinned to
#: every level below their own, and values from which a level has bounds of its own.
LENGTHS, THINNED, LEAST_VALUES = 12, 200, 20
UNKNOWN = "und"
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the lower-cased text, signs and digits taken as one blank."""
    raw = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(COLUMNS, np.int64)
    gram = codes
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        gram = (gram[:-1] << np.uint32(8)) | codes[n - 1 :]
        if n in GRAMS:
            hashed = (gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
            out += np.bincount(hashed, minlength=COLUMNS)
    return out


@dataclass
class LanguageModel:
    names: list[str]  # by centroid
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    bounds: np.ndarray  # by language, level of length: least cosine and least margin

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts, dtype=np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        pick, score, accepted = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        live = [i for i, t in enumerate(texts) if t and letters(t)]
        if not live or not self.names:
            return pick, score, accepted
        counts = np.stack([gram_counts(texts[i]) for i in live])
        languages = sorted(set(self.names))
        by = by_language(self.vectors(counts) @ self.centroids.T, self.names)
        shares = np.exp(20 * (by - by.max(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        best = by.argmax(axis=1)
        cosine, ahead = nearness(by, best)
        least = self.bounds[best, level(counts)]
        stays = (cosine >= least[:, 0]) & (ahead >= least[:, 1])
        for row, i in enumerate(live):
            pick[i] = languages[best[row]]
            score[i] = float(shares[row, best[row]])
            accepted[i] = bool(stays[row])
        return pick, score, accepted


def level(counts: np.ndarray) -> np.ndarray:
    """The level of length of each row of counts."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)) / 2, LENGTHS - 1).astype(int)


def by_language(near: np.ndarray, names: list[str]) -> np.ndarray:
    """The greatest cosine of each row (of cosines to centroids) by language, in order of the names."""
    own = np.array(names)
    return np.stack([near[:, own == name].max(axis=1) for name in sorted(set(names))], axis=1)


def nearness(by: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each row to its language, and by how much it exceeds that to any other."""
    rows = np.arange(len(by))
    cosine = by[rows, language]
    others = np.c_[by, np.zeros(len(by))]
    others[rows, language] = -1
    return cosine, cosine - others.max(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def cluster(rows: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Unit centroids of the rows, by cosine; k at most."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit(counts: np.ndarray, languages: list[str], clusters: int = CLUSTERS) -> LanguageModel:
    if not len(languages):
        return LanguageModel([], np.ones(COLUMNS, np.float32), np.zeros((0, COLUMNS), np.float32), np.zeros((0, LENGTHS, 2)))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    model = LanguageModel([], idf, np.zeros((0, COLUMNS), np.float32), np.zeros((0, LENGTHS, 2)))
    rows, names = model.vectors(counts), np.array(languages)
    model.names, model.centroids = centroids_of(rows, names, clusters)
    model.bounds = bounds_of(model, counts, rows, names, clusters)
    return model


def centroids_of(rows: np.ndarray, names: np.ndarray, clusters: int) -> tuple[list[str], np.ndarray]:
    found, whose = [], []
    for name in sorted(set(names)):
        own = rows[names == name]
        found.append(cluster(own, min(clusters, len(own))))
        whose += [str(name)] * len(found[-1])
    return whose, np.vstack(found)


def bounds_of(model: LanguageModel, counts: np.ndarray, rows: np.ndarray, names: np.ndarray, clusters: int) -> np.ndarray:
    """Bounds from both halves of the rows, each held against centroids of the other one. Few texts
    are short, so rows are also thinned to the least length of each level below their own. A level
    with few values takes the bounds of the one below it."""
    rng = np.random.default_rng(5)
    languages = sorted(set(names))
    place = np.zeros(len(names), int)
    for name in languages:
        place[names == name] = np.arange((names == name).sum())
    single = np.array([(names == name).sum() < 2 for name in languages])
    whose = np.searchsorted(languages, names)
    got: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for half in (0, 1):
        held = (place % 2 == half) | single[whose]
        other = (place % 2 != half) | single[whose]
        their_names, centroids = centroids_of(rows[other], names[other], clusters)
        for at in range(LENGTHS):
            size = 4**at
            longer = held & (place < THINNED) & (counts.sum(axis=1) > size)
            thin = [rng.multivariate_hypergeometric(c, size, method="marginals") for c in counts[longer]]
            vectors = np.vstack([rows[held & (level(counts) == at)], *([model.vectors(np.stack(thin))] if thin else [])])
            told = np.r_[whose[held & (level(counts) == at)], whose[longer]]
            if len(told):
                cosine, ahead = nearness(by_language(vectors @ centroids.T, their_names), told)
                for language in set(told.tolist()):
                    got.setdefault((language, at), []).append((cosine[told == language], ahead[told == language]))
    out = np.zeros((len(languages), LENGTHS, 2))
    for language in range(len(languages)):
        for at in range(LENGTHS):
            own = got.get((language, at), [])
            if sum(len(c) for c, _ in own) >= LEAST_VALUES:
                low = [np.percentile(np.concatenate(values), PERCENTILE) for values in zip(*own, strict=True)]
                out[language, at] = SHARE * np.maximum(low, 0)
            elif at:
                out[language, at] = out[language, at - 1]
    return out


def learn_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` rows of each language, however rare: those of the least hashes of
    the id. Rows without id, language, text or letter teach nothing. The executors turn whole texts into
    counts; only those (of a fixed size) come to the driver."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.where("i is not null and t is not null and l is not null")
    totals = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not totals:
        return fit(np.zeros((0, COLUMNS)), [])
    spark = labelled.sparkSession
    share = F.broadcast(spark.createDataFrame([(name, min(1.0, 2 * (per_language + 50) / n)) for name, n in totals.items()], "l string, share double"))  # a row a language
    place = (F.xxhash64("i").cast("double") / 2.0**63 + 1) / 2  # from 0 to 1; twice the rows wanted are ordered
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", F.xxhash64("t")))
    some = rows.withColumn("h", place).join(share, "l").where(F.col("h") < F.col("share")).withColumn("k", first).where(F.col("k") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if letters(t)]
            packed = [zlib.compress(gram_counts(t).astype("<u4").tobytes(), 1) for t, _ in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in pairs], pa.string()), pa.array(packed, pa.binary())], names=["l", "c"])

    got = some.select("t", "l").mapInArrow(count, "l string, c binary").collect()
    got.sort(key=lambda r: (r["l"], bytes(r["c"])))
    counts = np.stack([np.frombuffer(zlib.decompress(bytes(r["c"])), "<u4") for r in got]) if got else np.zeros((0, COLUMNS))
    return fit(counts, [r["l"] for r in got])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_accepted``.

    The nearest centroid (cosine) of the whole text names the language. Null texts and texts without
    a letter are ``und`` with score 0 and not accepted; so is all if nothing was learned. Texts
    further from the centroids of their language, or nearer to another language, than held-out texts
    of that language and length (by SHARE) keep their name but are not accepted; of a few letters
    hardly any can be told. Other columns pass through; the three columns replace columns of those names.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    made = [f"{prefix}pred", f"{prefix}score", f"{prefix}accepted"]
    rest = [c for c in docs.columns if c not in made]

    @arrow_udf("pred string, score double, accepted boolean")
    def tell(texts: pa.Array) -> pa.Array:
        pick, score, accepted = [], [], []
        for start in range(0, len(texts), 256):
            for found, own in zip((pick, score, accepted), told.value.predict(texts.slice(start, 256).to_pylist()), strict=True):
                found += own
        return pa.StructArray.from_arrays([pa.array(pick, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["pred", "score", "accepted"])

    # told once a row: a filter on it is not worked out a second time
    rows = docs.select(*[f"`{c}`" for c in rest], tell.asNondeterministic()(F.col(text_col)).alias("__told"))
    return rows.select(*[f"`{c}`" for c in rest], *[F.col(f"__told.{c}").alias(name) for c, name in zip(("pred", "score", "accepted"), made, strict=True)])
