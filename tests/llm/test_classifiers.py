import zlib

import numpy as np
import pandas as pd
import pytest

from verity.llm import language_id, nets, quality, queries, toxicity
from verity.llm.common import labelled_sample, letters

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    return pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")


def auc(labels, scores):
    ranks = pd.Series(scores).rank().to_numpy()
    p = labels.sum()
    return (ranks[labels == 1].sum() - p * (p + 1) / 2) / (p * (len(labels) - p))


def folds(ids, n, held):
    return [zlib.crc32(str(i).encode()) % n == held for i in ids]


def test_language_on_held_out_rows(spark, tables):
    docs, _ = tables
    got = queries.op7_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.held_out.tolist() == folds(got.doc_id, 4, 2)
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all() and got.accepted.mean() > 0.99


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    got = queries.op5_toxicity(spark, SF).toPandas()
    assert len(got) == len(docs) and got.held_out.tolist() == folds(got.doc_id, 5, 0)
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    known = got.merge(labels, on="doc_id")
    assert auc(known.toxic.to_numpy(), known.score.to_numpy()) > 0.9


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    got = queries.op9_quality_classifier(spark, SF).toPandas()
    assert len(got) == len(docs) and (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95


def odd_rows(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "123 ** !!", "x"), (None, "the cat and the dog", "y"), (4, "le chat et la souris " * 30_000, "z"), (4, "le chat et la souris " * 30_000, "z")]
    return spark.createDataFrame([(i, t, s, 0.5, "en") for i, t, s in rows], "doc_id long, text string, source string, score double, lang_pred string")


def test_odd_inputs_are_scored(spark):
    docs = odd_rows(spark)
    train = spark.createDataFrame([(i, f"the cat {i} and the dog of it" if i % 2 else f"le chat {i} et la souris du roi", "en" if i % 2 else "fr", i % 2) for i in range(200)] + [(None, None, None, None)], "doc_id long, text string, lang string, toxic int")
    model = language_id.learn_languages(train)
    told = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [told[i].lang_pred for i in (1, 2, 3, None, 4)] == ["und", "und", "und", "en", "fr"]
    assert not told[1].lang_accepted and told[4].lang_accepted and told[4].score == 0.5
    none = spark.sql("select false as held")["held"] if False else None  # noqa: F841
    from pyspark.sql import functions as F

    sample = labelled_sample(train, train.select("doc_id", "toxic"), "toxic", 50, F.lit(False))
    assert sample.count() == 100
    scored = toxicity.score_toxicity(docs, toxicity.learn_toxicity(sample)).collect()
    good = quality.score_quality(docs, quality.learn_quality(docs, sample)).collect()
    for rows in (scored, good):
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, toxic int")
    from pyspark.sql import functions as F

    sample = labelled_sample(empty, empty.select("doc_id", "toxic"), "toxic", 50, F.lit(False))
    docs = odd_rows(spark)
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn_languages(empty)).collect()} == {"und"}
    assert toxicity.score_toxicity(docs, toxicity.learn_toxicity(sample)).count() == 6
    assert quality.score_quality(docs, quality.learn_quality(docs, sample)).count() == 6
    assert toxicity.score_toxicity(empty, toxicity.learn_toxicity(sample)).count() == 0
    assert quality.score_quality(empty, quality.learn_quality(empty, sample)).count() == 0


def test_word_vectors_against_brute_force(spark):
    texts = ["a b c a", "b", None, "c c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vectors, counts = quality.word_vectors(docs)
    index, want = quality.index_vectors().astype(int), {}
    ids = nets.HashedIds(quality.BUCKETS)
    for t in texts:
        words = (t or "").split()
        for i, w in enumerate(words):
            want.setdefault(w, np.zeros(quality.DIM))
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    want[w] += index[ids[words[j]]]
    for w, v in want.items():
        np.testing.assert_allclose(vectors[ids[w]], v / max(np.linalg.norm(v), 1e-9), atol=1e-6)
        assert counts[ids[w]] == sum((t or "").split().count(w) for t in texts)


def test_convolution_gradient_against_differences():
    model = toxicity.ToxicityModel.new(1)
    model.embed *= 5  # away from the kinks of the maxima
    model.bias += 0.01
    reader = toxicity.Reader()
    docs = [reader(t) for t in ("a b c d e", "f", "", "g h a b")]
    labels, weights = np.array([1, 0, 1, 0]), np.ones(4, np.float32)
    for name in ("embed", "filters", "bias", "out"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    grads = toxicity._gradients(model, docs, labels, weights)

    def loss():
        p = nets.sigmoid(model.logits(docs))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    rng = np.random.default_rng(0)
    for param, grad in zip((model.embed, model.filters, model.bias, model.out), grads, strict=False):
        for at in np.argsort(-np.abs(grad).ravel())[: 40 if grad.size > 40 else grad.size][:: 8]:
            keep = param.ravel()[at]
            param.ravel()[at] = keep + 1e-5
            up = loss()
            param.ravel()[at] = keep - 1e-5
            down = loss()
            param.ravel()[at] = keep
            assert abs((up - down) / 2e-5 - grad.ravel()[at]) < 1e-3 + 0.05 * abs(grad.ravel()[at])
    del rng


def test_thresholds_and_temperature():
    scores, labels = np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])
    cut = nets.best_threshold(scores, labels, np.ones(4))
    assert 0.3 < cut < 0.8
    moved = nets.recentre(scores, np.full(4, cut))
    assert ((moved >= 0.5) == (labels == 1)).all() and (np.diff(moved) < 0).all()
    logits = np.array([4.0, 4.0, 4.0, -4.0, -4.0, -4.0])
    assert nets.temperature(logits, np.array([1, 1, 0, 0, 0, 1]), np.ones(6)) > 3


def test_language_rejects_by_distance_and_keeps_clean_short_texts(tables):
    docs, _ = tables
    docs = docs[[bool(t and letters(t)) for t in docs.text]]
    learn = docs[docs.doc_id % 2 == 0]
    model = language_id.fit(np.stack([language_id.gram_counts(t) for t in learn.text]), learn.lang.tolist())
    rng = np.random.default_rng(6)
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı",
        "def unit(x: np.ndarray) -> np.ndarray:\n    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)\n" * 3,
        " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(200)),
        "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"), 2000)),
    ]
    assert model.predict(foreign)[2] == [False] * len(foreign)
    rest = docs[docs.doc_id % 2 == 1]
    short = [" ".join(t.split()[:6]) for t in rest.text]
    for texts, share in ((rest.text.tolist(), 0.98), (short, 0.95)):
        assert np.mean(model.predict(texts)[2]) > share


def some_texts(tables, n):
    docs, _ = tables
    return [*(t[:3000] if t else t for t in docs.text[:n]), None, "", "12 !!", "Ä ß", "a", "½", "② ³", "Ⅷ", "₂ ٣", "½ a"]


def test_languages_against_brute_force(tables):
    """TF-IDF vectors and cosines to every centroid, n-gram by n-gram."""
    docs, _ = tables
    learn = docs[docs.doc_id % 3 == 0]
    model = language_id.fit(np.stack([language_id.gram_counts(t or "") for t in learn.text]), learn.lang.tolist())
    for text in some_texts(tables, 60):
        pick, score, accepted = (x[0] for x in model.predict([text]))
        if not text or not any(c.isalpha() for c in text):
            assert (pick, score, accepted) == ("und", 0.0, False)
            continue
        raw = " " + " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split()) + " "
        counts = {}
        for n in (2, 3):
            for k in range(len(raw.encode()) - n + 1):
                code = int.from_bytes(raw.encode()[k : k + n], "big")
                column = ((code * 2654435761 + n * 40503) % 2**32) >> 20
                counts[column] = counts.get(column, 0) + 1
        vector = {c: np.log1p(n) * float(model.idf[c]) for c, n in counts.items()}
        size = sum(x * x for x in vector.values()) ** 0.5
        near = {}
        for name, centroid in zip(model.names, model.centroids, strict=True):
            near[name] = max(near.get(name, -1), sum(x * float(centroid[c]) for c, x in vector.items()) / size)
        best = max(sorted(near), key=near.get)
        assert pick == best
        share = 1 / sum(np.exp(20 * (x - near[best])) for x in near.values())
        assert abs(score - share) < 1e-4
        ahead = near[best] - max([0.0, *(x for name, x in near.items() if name != best)])
        least = model.bounds[sorted(near).index(best), min(int(np.log2(sum(counts.values())) / 2), language_id.LENGTHS - 1)]
        if abs(near[best] - least[0]) > 1e-5 and abs(ahead - least[1]) > 1e-5:
            assert accepted == (near[best] >= least[0] and ahead >= least[1])


def test_convolution_against_brute_force(tables):
    """Every filter at every place of a text, one after the other."""
    model = toxicity.ToxicityModel.new(3)
    model.cuts = {"": 0.4}
    reader = toxicity.Reader()
    for text in some_texts(tables, 25):
        words = nets.WORD.findall((text or "").lower())
        vectors = [sum(model.embed[row].astype(float) for row in toxicity._ids(w)) for w in words] or [np.zeros(toxicity.DIM)]
        vectors += [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        top, k = [], 0
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                top.append(max(sum(float(vectors[at + j] @ model.filters[:, k + j, f]) for j in range(width)) for at in range(max(1, len(words)))))
            k += width
        logit = float(np.maximum(np.array(top) + model.bias, 0) @ model.out + model.out_bias[0])
        raw = 1 / (1 + np.exp(-logit))
        want = 0.5 * raw / 0.4 if raw < 0.4 else 0.5 + 0.5 * (raw - 0.4) / 0.6
        assert abs(model.score([(reader(text), "xx")])[0] - want) < 1e-4


def test_quality_score_against_brute_force(tables):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 1, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    weights = rng.uniform(0.1, 1, quality.BUCKETS).astype(np.float32)
    layers = [rng.normal(0, 0.2, s).astype(np.float32) for s in ((quality.FEATURES, quality.HIDDEN), quality.HIDDEN, quality.HIDDEN, 1)]
    model = quality.QualityModel(vectors, weights, rng.normal(0, 1, quality.FEATURES).astype(np.float32), rng.uniform(0.5, 2, quality.FEATURES).astype(np.float32), layers, 1.7)
    ids = nets.HashedIds(quality.BUCKETS)
    for text in some_texts(tables, 25):
        own = [ids[w] for w in nets.WORD.findall(text or "")]
        features = np.zeros(quality.FEATURES)
        for d in range(quality.DIM):
            column = [float(vectors[i][d]) for i in own]
            if own:
                features[d] = sum(float(weights[i]) * x for i, x in zip(own, column, strict=True)) / sum(float(weights[i]) for i in own)
                features[quality.DIM + d] = (sum((x - sum(column) / len(own)) ** 2 for x in column) / len(own)) ** 0.5
            if len(own) > 1:
                features[2 * quality.DIM + d] = sum(abs(a - b) for a, b in zip(column, column[1:], strict=False)) / (len(own) - 1)
        if own:
            features[-2] = np.log(1 + len(own))
        if len(own) > 1:
            features[-1] = sum(a == b for a, b in zip(own, own[1:], strict=False)) / (len(own) - 1)
        w1, b1, w2, b2 = layers
        hidden = [np.tanh(sum((features[i] - model.centre[i]) / model.scale[i] * w1[i, h] for i in range(quality.FEATURES)) + b1[h]) for h in range(quality.HIDDEN)]
        want = 1 / (1 + np.exp(-(sum(x * w for x, w in zip(hidden, w2, strict=True)) + b2[0]) / 1.7))
        assert abs(model.score(model.pooled([text], ids))[0] - want) < 1e-4


def test_thresholds_count_every_labelled_row(spark):
    """Rows far beyond the sample: the threshold is the best one over all that the network has not seen."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, f"{'bad' if rng.random() < (0.9 if i % 4 == 0 else 0.3) else 'good'} word{int(rng.integers(50))}", int(i % 4 == 0)) for i in range(2000)], "doc_id long, text string, toxic int")
    sample = labelled_sample(docs, docs.select("doc_id", "toxic"), "toxic", 40, F.lit(False))
    model = toxicity.learn_toxicity(sample)
    assert len(model.trained) == 64 and set(model.trained) <= {r.doc_id for r in sample.collect()}
    known = docs.select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.logits_of(docs, model)
    cuts = toxicity.all_cuts(scored, known, model)
    rows = scored.join(known, "doc_id").toPandas()
    free = rows[~rows.doc_id.isin(model.trained)]
    assert len(free) == 2000 - 64
    weight = np.where(free.label == 1, 500 / (free.label == 1).sum(), 1500 / (free.label == 0).sum())

    def f1(cut):
        taken = nets.sigmoid(free.logit.to_numpy()) >= cut
        return 2 * (weight * taken * free.label).sum() / ((weight * taken).sum() + (weight * free.label).sum())

    best = max(f1(c) for c in nets.sigmoid(np.unique(free.logit)))
    assert f1(cuts[""]) > best - 1e-3
    got = toxicity.score_toxicity(docs, model, known=known).toPandas().merge(rows, on="doc_id")
    far = abs(got.logit - np.log(cuts[""] / (1 - cuts[""]))) > 1e-6
    assert ((got.score >= 0.5) == (nets.sigmoid(got.logit) >= cuts[""]))[far].all()
