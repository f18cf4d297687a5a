import zlib

import corpus_pipeline as pipeline
from verity.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def similar(a, b):
    """Five-word shingles with a Jaccard similarity of 0.8 or more."""
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    x, y = sets
    return len(x & y) * 10 >= len(x | y) * 8


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut(stage(spark, docs, SF), "pipeline-test")
        assert docs.columns == columns
        seen[name] = docs.collect()
    told = seen["language"]
    assert {r.doc_id for r in told} <= set(before) and len(told) > 0.99 * len(before)
    lines = seen["lines"]
    assert all(r.n_chars == len(r.text) and r.text.strip() for r in lines)
    kept = {}
    for r in sorted(lines, key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            words = frozenset(line.lower().split())
            assert not words or words not in kept
            kept[words] = r.doc_id
    texts = {r.doc_id: r.text for r in lines}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for k, i in enumerate(order):
        for j in order[:k]:
            if similar(texts[i], texts[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(i for i in root if find(i) == i)
    mixed = seen["mixing"]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in seen["near_duplicates"]} and mixed
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted({r.doc_id for r in packed}) == sorted({r.doc_id for r in mixed})
    fills = {}
    for r in packed:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048
    assert tokenizer_file() and zlib


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
