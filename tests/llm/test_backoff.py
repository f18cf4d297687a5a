import math
import re
from collections import Counter

import pytest

from verity.llm.backoff import score_texts

ROWS = [(1, "The cat sat on the mat", True), (2, "the cat sat on a hat", True), (3, "the cat sat on the mat", False), (4, None, True), (5, "", False), (6, "unseen words only", False), (7, "the cat " * 20_000, True), (None, "a hat\x0ba mat x", True), (8, "the dog", None), (9, "cat cat cat", True), (9, "cat cat cat", True), (10, "\x1f odd \x00", True), ((1 << 62) + 1, "the long id", True)]


def brute(rows, order, prior):
    texts = [(i, bool(l), ["<s>", *re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "</s>"]) for i, t, l in rows]
    count = Counter(tuple(s[a : a + k]) for _, l, s in texts if l for k in range(1, order + 1) for a in range(len(s) - k + 1))
    single = {g[0]: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(single.values()), len(single)

    def chance(history, word):
        if not history:
            return (single.get(word, 0) + 0.5) / (n + 0.5 * (v + 1))
        lower, c, m = chance(history[1:], word), count[history], prior[min(len(history) - 1, len(prior) - 1)]
        return (count[(*history, word)] + m * lower) / (c + m) if c else lower

    out = []
    for i, learns, s in texts:
        base = sum(math.log10(chance((), w)) for w in s[1:])
        score = sum(math.log10(chance(tuple(s[max(0, a - order + 1) : a]), s[a])) for a in range(1, len(s)))
        out.append((i, learns, len(s) - 1, sum(w in single for w in s[1:]), n, round(base, 5), round(score, 5)))
    return sorted(out, key=str)


def told(df):
    return sorted(((*r[:5], round(r[5], 5), round(r[6], 5)) for r in map(tuple, df.collect())), key=str)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    docs = spark.createDataFrame([(i, t, l, "x") for i, t, l in ROWS], "doc_id long, text string, learns boolean, score string").repartition(3)
    assert told(score_texts(docs, order=order, prior=(2.0, 0.5))) == brute(ROWS, order, (2.0, 0.5))


def test_nothing_learned_and_empty_table(spark):
    rows = [(1, "a b", False), (2, "", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean")
    assert told(score_texts(docs, prior=(2.0,))) == brute(rows, 2, (2.0,))
    assert score_texts(docs.where("false")).count() == 0


def test_chances_of_all_next_words_add_up_to_one(spark):
    """Every known next word, and one unknown for all others, after a known history, with the end."""
    learned = "a b a c a b b"
    words = ["a", "b", "c", "zzz"]
    rows = [(0, learned, True)] + [(k + 1, f"a b {w}", False) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean")
    by_id = {r["doc_id"]: r for r in score_texts(docs, order=2, prior=(3.0,)).collect()}
    n, v, m = 8, 4, 3.0
    p = lambda c: (c + 0.5) / (n + 0.5 * (v + 1))
    after_b = {"a": 1, "b": 1, "</s>": 1}  # b is followed by a, b and the end
    total = sum((after_b.get(w, 0) + m * p(c)) / (3 + m) for w, c in (("a", 3), ("b", 3), ("c", 1), ("</s>", 1), ("zzz", 0)))
    assert total == pytest.approx(1.0)
    assert by_id[1]["n_known"] == 4 and by_id[4]["n_known"] == 3
