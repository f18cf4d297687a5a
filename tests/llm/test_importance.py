import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from verity.llm import blocks
from verity.llm.importance import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BUCKETS = 50


def features(text, order):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, order=2, percent=25, min_words=3):
    bucket = lambda f: zlib.crc32(f.encode()) % BUCKETS
    s = Counter(bucket(f) for _, t in docs for f in features(t, order)[1])
    t = Counter(bucket(f) for x in target for f in features(x, order)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + BUCKETS) / ((s[b] + 1) * (t.total() + BUCKETS))))
    rows = []
    for i, text in docs:
        n, own = features(text, order)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


DOCS = [(1, "The cat sat on the mat"), (2, "the CAT sat, on: the mat"), (3, ""), (4, None), (5, "... !!"), (6, "Äpfel und Öl 42 x"), (7, "a b " * 40_000), (8, "only two"), (None, "some words of nobody here"), (9, "cat cat cat cat"), (9, "cat cat cat cat"), (10, "one\nline\tand\x00more"), ((1 << 62) + 1, "a long id beside a null")]
TARGET = ["the cat sat", None, "", "Öl und Äpfel"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 64)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, rank string, weight int").repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id int, text string")
    out = resample(docs, target, order=order, buckets=BUCKETS, percent=50, min_words=3)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(DOCS, TARGET, order, 50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert resample(none, some).count() == 0
    assert sorted(map(tuple, resample(some, none, buckets=BUCKETS, percent=50, min_words=3).collect()), key=str) == brute([(1, "a b c d"), (2, "e f g h")], [], 2, 50)


def test_copies_of_a_third_of_all_rows(spark):
    rows = [(i, "hot words again and again" if i % 3 == 0 else f"text {i % 40} of many {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    target = spark.createDataFrame([("hot words of many",)], "text string")
    assert sorted(map(tuple, resample(docs, target, buckets=BUCKETS, min_words=3).collect()), key=str) == brute(rows, ["hot words of many"])
