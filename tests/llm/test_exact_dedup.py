import hashlib
from collections import defaultdict

import pytest

from verity.llm.exact_dedup import exact_dedup

ROWS = [(1, "a"), (2, "a"), (None, "a"), (3, ""), (4, None), (5, "b" * 200_000), (6, "b" * 200_000), (7, "b" * 199_999 + "c"), (8, "A"), (9, "a "), (9, "a "), (None, "only null")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, keep):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, keep_id string, group_size int").repartition(3)
    got = sorted(map(tuple, exact_dedup(docs, keep=keep).collect()), key=str)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        want.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_class_of_a_third_of_all_rows_over_many_tasks(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(37)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, keep="largest").collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows}
