import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from verity.llm import packing
from verity.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def check(rows, docs, capacity=2048):
    """Every document's ids against the tokenizer itself, and the sequences against the contract."""
    tok = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, tokenizer_file()).collect()
    used, least = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= least + 1


def test_edges_of_the_input(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a ½ Ⅷ x1²\x1cb"), (None, "word " * 9000), (5, "it's  we'll \n\n <|endoftext|> 日本 ٣٤"), (6, " the" * 2047), (7, " the" * 2048), (7, " the" * 4095), (8, "<|endoftext|>"), (9, "a <|endoftext|> b<|endoftext|><|endoftext"), (10, "\u17ab\u27e6\U0001429a\u96b4\U00017031\U000159dc \u0378x")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, length int, sequence_id int").repartition(3)
    used, least = check(packing.pack_documents(docs, tokenizer_file()).collect(), texts)
    assert used <= least + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_file()).count() == 0


def test_islands_and_migration_pack_many_districts(spark):
    rng = np.random.default_rng(0)
    lengths = [int(x) for x in np.concatenate([rng.integers(700, 1100, 300), rng.integers(1, 2048, 300)])]
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(parts, district=150, islands=3, epochs=3).collect()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert sorted(r.doc_id for r in rows) == list(range(600)) and max(fills.values()) <= 2048
    greedy = packing.best_fit(lengths, sorted(range(600), key=lambda i: -lengths[i]), [], 2048)
    assert len(fills) <= len(greedy) + 4


@pytest.mark.parametrize("seed", range(6))
def test_operators_keep_every_item_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 2048, 80)]
    people = packing.evolve(lengths, [], seed)
    for child in [*people, packing.crossover(people[0], people[-1], lengths, 2048, rng), packing.mutate(people[0], lengths, 2048, rng)]:
        assert sorted(i for _, own in child for i in own) == list(range(80))
        assert all(fill == sum(lengths[i] for i in own) <= 2048 for fill, own in child)
    assert packing.fitness(people[0], 2048) >= max(packing.fitness(p, 2048) for p in people)


def test_random_texts_over_all_planes():
    rng = np.random.default_rng(3)
    tok, encode = Tokenizer.from_file(tokenizer_file()), packing.token_bytes(tokenizer_file())
    for k in range(1500):
        top = (128, 256, 0x3000, 0x20000)[k % 4]
        text = "".join(chr(c) for c in rng.integers(0, top, rng.integers(1, 30)) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def test_words_that_come_again_are_not_tokenized_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    whole = Tokenizer.from_file(tokenizer_file())
    ids, asked = packing.WordIds(whole), []
    tokenize = ids.tokenize
    ids.tokenize = lambda word: asked.append(word) or tokenize(word)
    for k in range(20):
        for word in (" the", " blé", f" w{k}", "\x00\xa0"):
            assert np.frombuffer(ids[word], "<u4").tolist() == whole.encode(word, add_special_tokens=False).ids
    assert len(asked) == 23 and len(ids) + len(ids.old) <= 6


def test_listed_letters_split_like_the_vocabulary(spark):
    every = "".join(a + b for a in map(chr, range(256)) for b in ("", "é", " ", "7", "!", "\n"))
    whole = Tokenizer.from_file(tokenizer_file())
    got = packing.token_bytes(tokenizer_file())([every, "l'été's we'll ¡no! a_b\xa0c\x85 12º"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in (every, "l'été's we'll ¡no! a_b\xa0c\x85 12º")]
    latin = every.translate({c: None for c in (0x1C, 0x1D, 0x1E, 0x1F, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)})
    assert np.frombuffer(packing.token_bytes(tokenizer_file())([latin])[0], "<u4").tolist() == whole.encode(latin, add_special_tokens=False).ids


def test_a_larger_memory_tokenizes_fewer_words():
    whole, asked = Tokenizer.from_file(tokenizer_file()), []
    for size in (5, 40):
        ids, calls = packing.WordIds(whole, size), []
        tokenize = ids.tokenize
        ids.tokenize = lambda word, calls=calls, tokenize=tokenize: calls.append(word) or tokenize(word)
        for _ in range(3):
            for k in range(30):
                assert np.frombuffer(ids[f" w{k}x"], "<u4").tolist() == whole.encode(f" w{k}x", add_special_tokens=False).ids
        asked.append(len(calls))
    assert asked == [90, 30]
