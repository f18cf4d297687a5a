import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from verity.llm.filter_audit import filter_audit

LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [(1, LONG, "a"), (2, LONG, "b"), (3, "short text", "a"), (4, "short text", "a"), (4, "short text", "a"), (5, None, None), (6, "", ""), (7, "AB CD EF " * 80, "b"), (8, "same " * 300, "a"), (9, LONG + " #", "b"), (None, LONG, "a"), (10, "A b İ " * 70, "b"), (11, "x y\x0bz\x1fq " * 90, "a")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (7, 1, None), (8, None, 1), (9, 1, 1), (99, 1, 1), (None, 1, 1)]


def fails_of(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        text = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        marks = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        yield i, part or "", marks + "E" * (i is not None and least.get(text, i) < i)


def brute(rows, labels, names="ABCDE"):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    docs = list(fails_of(rows))
    totals, shapley = {}, {}
    for part in {p for _, p, _ in docs}:
        for order in permutations(names):
            for k, own in enumerate(order):
                row = [0] * 6
                for i, p, fails in docs:
                    if p != part:
                        continue
                    gone = any(f in fails for f in order[:k])
                    row[0] += not gone and own not in fails
                    if own in fails and not gone:
                        row[1], row[4], row[5] = row[1] + 1, row[4] + (i in good), row[5] + (i in toxic)
                    row[2] += own in fails and gone
                    row[3] += fails == own
                totals[part, "".join(order), k + 1, own] = row
                shapley[part, own] = shapley.get((part, own), 0) + row[1]
    return sorted((part, order, step, *row, shapley[part, own]) for (part, order, step, own), row in totals.items())


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in ROWS], "doc_id long, text string, source string, kept int").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filter_audit(docs, labels)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute(ROWS, LABELS)


def test_own_filters_and_empty_table(spark):
    docs = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 20, None)], "doc_id long, n int, source string").withColumn("text", F.lit("t"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    own = {"low": F.col("n") < 10, "odd": F.col("n") % 2 == 1}
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit(docs, labels, own, repeated=None).collect()}
    assert got[("a", "lowodd", 1)] == (1, 1, 0, 0, 1) and got[("a", "lowodd", 2)] == (1, 0, 1, 0, 1) and got[("", "oddlow", 2)] == (1, 0, 0, 0, 0)
    assert len(got) == 8
    assert filter_audit(docs.where("false"), labels, own).count() == 0
    with pytest.raises(ValueError, match="filters of different names"):
        filter_audit(docs, labels, {str(i): F.lit(True) for i in range(8)})


def test_copies_of_a_third_of_all_rows(spark):
    rows = [(i, "hot text " * 150 if i % 3 == 0 else f"text {i % 50} " * 3, f"s{i % 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(13)
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 600, 5)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit(docs, labels).collect())) == brute(rows, [(i, i % 2, i % 3) for i in range(0, 600, 5)])
