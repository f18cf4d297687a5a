import numpy as np
import pytest

from verity.llm import blocks


@pytest.mark.parametrize("strings", [[b"a"], [b"", b"a", b"ab", b"b"], [b"x\x00", b"x\x00\x00", b"y"], [b"same same", b"same same b"], ["é".encode(), "éa".encode()], [b"w" * 500, b"w" * 500 + b"a"], [b"\t", b"a\x00 b"]])
def test_strings_round_trip(strings):
    assert blocks.unpack_strings(blocks.pack_strings(strings)) == strings


def test_numbers_round_trip():
    for values in ([], [0], [1, 2, 70_000], [-1, 5]):
        assert blocks.unpack(blocks.pack(np.array(values), "<i4"), "<i4").tolist() == values


def test_levels_are_the_n_grams():
    codes, first = np.array([0, 1, 0, 1, 2, 0, 1]), np.array([True, False, False, True, False, True, False])
    (_, _, _), (at, head, last), (three, three_head, three_last) = blocks.levels(codes, first, 3, 3)
    pairs = [(int(head[i]), int(last[i])) if i >= 0 else None for i in at]
    assert pairs == [None, (0, 1), (1, 0), None, (1, 2), None, (0, 1)]
    assert [(pairs.index((int(head[three_head[i]]), int(last[three_head[i]]))), int(three_last[i])) if i >= 0 else None for i in three] == [None, None, (1, 0), None, None, None, None]


def test_ranks_without_one_task(spark):
    from pyspark.sql import functions as F

    from verity.llm.common import Scratch

    rows = [(i % 7, i) for i in range(500)] + [(3, 10)] * 20
    df = spark.createDataFrame(rows, "a int, b int").repartition(9)
    with Scratch(spark) as scratch:
        got = sorted((r["_rank"], r["a"], r["b"]) for r in blocks.placed(df, [-F.col("a"), F.col("b")], scratch, "ranks").collect())
    assert got == [(k + 1, a, b) for k, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
