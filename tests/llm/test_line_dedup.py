import random

import duckdb
import pytest

from verity.llm import common, queries
from verity.llm.line_dedup import LARGE_GROUP, line_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, percent):
    """Every line against every earlier line of the table."""
    words = lambda line: set(line.lower().replace("\t", " ").replace("\r", " ").split(" ")) - {""}
    order = sorted({(i is not None, i, n, t): line for i, t in rows for n, line in enumerate((t or "").split("\n"))}.items(), key=lambda x: x[0][:3])
    gone, seen = set(), []
    for key, line in order:
        own = words(line)
        if own:
            if any(len(own & w) * 100 >= len(own | w) * percent for w in seen):
                gone.add(key)
            seen.append(own)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for n, line in enumerate(lines) if (i is not None, i, n, t) not in gone]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(lines), 0 if t is None else len(lines) - len(kept)))
    return sorted(out, key=str)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in queries.op4_line_dedup(spark, SF).collect()), key=str)
    assert got == brute(rows, 80)


def test_whole_table_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(db.sql(queries.OP4_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op4_line_dedup(spark, SF).collect()) == want


@pytest.mark.parametrize("percent", [80, 60])
def test_variants_of_lines(spark, percent):
    rng = random.Random(percent)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            own = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(60)}"
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(own).upper())
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n\t"), (None, "w1 w2"), (103, "w1 w2\n\nW2  w1"), (104, "long " * 50_000 + "\nx"), (105, "one"), (105, "two lines\nhere")]
    docs = spark.createDataFrame([(i, t, 7, i) for i, t in rows], "doc_id long, text string, n_lines int, lid long").repartition(5)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(docs, percent=percent).collect()), key=str)
    assert got == brute(rows, percent)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b\na b"), (1, "a b\na b"), (2, "a b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup(docs).collect())
    assert got == [(1, "a b", 2, 1), (1, "a b", 2, 1), (2, "", 1, 1)]
    assert line_dedup(docs.limit(0)).count() == 0


def test_a_large_group_of_variants(spark):
    """2,000 variants of a line, some far from the first ones, under ids in another order than the rows."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(2000):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(40, 90)}"
        rows.append((rng.randrange(10**6), " ".join(own)))
    rows = list(dict(rows).items())
    for kind in ("long", "string"):
        own = [(i, t) if kind == "long" else (f"{i:07d}", t) for i, t in rows]
        docs = spark.createDataFrame(own, f"doc_id {kind}, text string").repartition(40)
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(docs).collect()), key=str)
        assert got == brute(own, 80)


def test_texts_are_split_once_and_only_large_groups_are_tried_first(spark, monkeypatch):
    tried, plans, cut = [], [], common.Scratch.cut

    def kept(self, df, name):
        out = cut(self, df, name)
        if name == "lines-tried":
            tried.append(out.count())
        if name == "lines-levels":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(common.Scratch, "cut", kept)
    for of_a_group in (4, 4 * LARGE_GROUP):
        rows = [(g * 1000 + k, " ".join(f"g{g}w{j}" for j in range(40)) + f" own{g}x{k}") for g in range(5) for k in range(of_a_group)]
        got = sorted((tuple(r) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str)
        assert got == brute(rows, 80)
    assert tried[:2] == [0, 0] and tried[2] > 5 * 3 * LARGE_GROUP
    assert len(plans) == 2 and not any("split(" in p for p in plans)


def test_smaller_sets_meet_by_a_shorter_prefix_and_lambdas_take_columns(spark, monkeypatch):
    met, plans, cut = [], [], common.Scratch.cut

    def kept(self, df, name):
        if name == "lines-unique":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        if name == "lines-candidates":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            met.append(plan.count("slice("))
        return cut(self, df, name)

    monkeypatch.setattr(common.Scratch, "cut", kept)
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"b{i % 12}w{k}" for k in range(4 + 9 * (i % 12))]
        rng.shuffle(words)
        cutoff = rng.choice([len(words), len(words) * 4 // 5, -(-len(words) * 4 // 5), len(words) - 1])
        rows.append((rng.randrange(10**6), " ".join(words[:cutoff] + [f"n{rng.randrange(40)}" for _ in range(rng.randrange(3))])))
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for percent in (80, 60, 95):
        assert sorted((tuple(r) for r in line_dedup(docs, percent=percent).collect()), key=str) == brute(rows, percent)
    assert met and all(met)
    assert plans and not any(f"{f}({g}(" in p for p in plans for f in ("filter", "aggregate", "transform") for g in ("slice", "sort_array", "filter"))
