import random

import numpy as np
import pandas as pd
import xxhash

from verity.llm import simhash_dedup as op
from verity.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_print(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in [9, 10, 11, 12, 13]}).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(docs, rows, width, distance):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.simhash_groups(docs, width=width, max_distance=distance).collect()}
    rows = sorted(rows)
    prints = [brute_print(t, width) for _, t in rows]
    roots = brute_components(prints, distance)
    assert got == {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots, strict=True)}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], 3, 3)


def test_edges_of_the_input(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(500)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two three"), (7, "one two"), (8, "é x y"), (9, " ".join(base * 60)), (10, " ".join(base))]
    rows += [(20 + k, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "z", "w") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    for width, distance in ((3, 3), (5, 3), (3, 1), (5, 5)):
        check(docs, rows, width, distance)


def test_hot_buckets_in_blocks_lose_no_link(spark):
    rng = random.Random(2)
    fps = {0x1234567890ABCDEF ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(sorted(fps), 3)
    for block in (4096, 16):
        roots = {r.node: r.root for r in connected_components(op.near_links(frame, 3, block)).collect()}
        groups = pd.Series(want).groupby([roots.get(x, x) for x in signed]).nunique()
        assert (groups == 1).all() and len(groups) == len(set(want))


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.simhash_groups(empty).count() == 0 and op.drop_near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "a b"), (2, "a b"), (None, "c d")], "doc_id long, text string")
    assert sorted(r.component_id or -1 for r in op.simhash_groups(docs).collect()) == [-1, 2, 2, 2, 2]
    assert sorted((r.doc_id or 0) for r in op.drop_near_duplicates(docs).collect()) == [0, 0, 2, 2]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_similar_groups_against_all_pairs(spark):
    """Groups by five-word shingles on a fixture with families of edited copies, against every pair."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], []
    for family in range(40):
        words = rng.choice(vocabulary, rng.integers(40, 400)).tolist()
        base.append(words)
        for copy in range(rng.integers(1, 12)):
            own = list(words)
            for _ in range(rng.integers(0, 1 + len(words) // 60)):
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
        rows.append((len(rows), " ".join(words[: len(words) // 2])))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "w1 w2"), (904, "W1  w2"), (905, "w1 w2 w3"), (906, rows[0][1]), (None, rows[0][1]), (907, "long " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, i) for i, t in rows], "doc_id long, text string, uid int, h1 long").repartition(5)

    def shingles(t):
        words = (t or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(sets):
        for m in range(k):
            b = sets[m][1]
            if len(a & b) * 10 >= len(a | b) * 8:
                root[find(k)] = find(m)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            lowest[find(k)] = min(i, lowest.get(find(k), i))
    want = sorted(((i is not None, i), lowest[find(k)]) for k, (i, _) in enumerate(sets))
    for block in (op.BLOCK, 5):
        got = sorted(((r.doc_id is not None, r.doc_id), r.component_id) for r in op.similar_groups(docs, block=block).collect())
        assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
        assert all(b[1] <= a[1] for a, b in zip(got, want, strict=True))
    stay = {r.doc_id for r in op.drop_near_duplicates(docs).collect()}
    assert stay >= {900, 903, 905, 907, None} and not stay & {901, 902, 904, 906}


def groups_of(spark, texts, block=op.BLOCK):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in op.similar_groups(docs, block=block).collect()}


def test_passages_appended_removed_and_replaced(spark):
    """Pairs at a similarity of 0.80 to 0.90 and just below it: each is told by its similarity, none by luck."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(120):
        words = [f"v{i}" for i in rng.integers(0, 50_000, 204)]
        more = [f"v{i}" for i in rng.integers(0, 50_000, 60)]
        texts += [" ".join(words), " ".join([words + more[: 25 + k % 30], words[: 195 - k % 40], words[:90] + more[: 8 + k % 20] + words[98 + k % 20 :]][k % 3])]
    near = [op.jaccard(a, b, 5) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= x < 0.9 for x in near) > 60 and sum(x < 0.8 for x in near) > 5
    got = groups_of(spark, texts)
    assert [got[2 * k + 1] == 2 * k for k in range(120)] == [x >= 0.8 for x in near]


def test_a_nearer_earlier_document_hides_no_similar_one(spark):
    """D has the words of B in another order, and comes between B and the document B was edited from."""
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in rng.permutation(50_000)[:400]]
    edited = [*words[:200], "edit", *words[201:]]
    texts = [" ".join(words), *(" ".join(rng.permutation(edited)) for _ in range(30)), " ".join(edited)]
    texts += [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(10, 390, 9)]
    for block in (op.BLOCK, 5):
        got = groups_of(spark, texts, block)
        assert got == {**{k: k for k in range(31)}, **dict.fromkeys(range(31, len(texts)), 0)}


def test_links_to_all_candidates_not_only_to_the_likeliest(spark):
    """A shares more of its prefix with B than with C, but only C is similar to it."""
    rng = np.random.default_rng(10)
    texts = []
    for _ in range(60):
        words = [f"v{i}" for i in rng.integers(0, 50_000, 150)]
        texts += [" ".join([*words[:k], f"x{k}", *words[k + 4 :]]) for k in rng.integers(1, 140, 3)]
        texts += [" ".join(words[: rng.integers(90, 150)]) for _ in range(3)]
    root = list(range(len(texts)))
    for k in range(len(texts)):
        for m in range(6 * (k // 6), k):
            if op.jaccard(texts[k], texts[m], 5) >= 0.8:
                root = [min(root[k], root[m]) if r in (root[k], root[m]) else r for r in root]
    for block in (op.BLOCK, 2):
        assert groups_of(spark, texts, block) == dict(enumerate(root))


def test_simhash_gives_pairs_before_the_exact_filter(spark):
    """The similarity groups take the pairs of near fingerprints, all of them."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(25):
        words = rng.integers(0, 5000, 300).tolist()
        texts.append(" ".join(f"w{x}" for x in words))
        for k in (1, 2):
            texts.append(" ".join(f"w{x}" for x in [*words[:-k], *range(9000, 9000 + k)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [op.set_fingerprint(op.shingle_hashes(t, 5, op._WordHashes())) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3}
    assert near
    nodes = spark.createDataFrame(list(enumerate(prints)), "uid long, fp long")
    with op.Scratch(spark) as scratch:
        found = [(r.src, r.dst) for r in op.fingerprint_pairs(nodes, 3, scratch).collect()]

    def roots(pairs):
        root = list(range(len(texts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(texts))]

    assert roots(found) == roots(near)
    taken, real = [], op.fingerprint_pairs

    def watched(nodes, max_distance, scratch):
        pairs = real(nodes, max_distance, scratch)
        taken.append(pairs.count())
        return pairs

    op.fingerprint_pairs = watched
    try:
        got = {r.doc_id: r.component_id for r in op.similar_groups(docs).collect()}
    finally:
        op.fingerprint_pairs = real
    assert taken and taken[0] >= len(set(range(len(texts)))) - len(set(roots(near)))
    assert [got[i] for i in range(len(texts))] == [i - i % 3 for i in range(len(texts))]
