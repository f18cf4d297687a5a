"""Texts as coded blocks, and dictionaries of the n-grams of a corpus.

Documents are gathered in blocks of bounded size, as they come from the input, one row each. Within a
block words are numbers in the order of their bytes, so n-grams are found by sorting whole numbers, and
every different n-gram is written out once. It goes to the shard that its words name, where the blocks'
entries of a string meet; what the shard tells about the string goes back to the block. One row holds
what a block sends to a shard, in order and without what each string shares with the one before, so
there are never more rows than different n-grams of a block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm.common import Scratch

#: UTF-8 bytes of the texts of a block, and of the corpus for each shard of the dictionary.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 6 << 20
FEW_SHARDS = 16
#: Words before the first and after the last of a text, where they are asked for; no word holds these.
START, END = b"\t", b"\r"
GRAMS = "block long, shard int, grams binary, counts binary"
#: Bytes at the beginning of strings that are laid out side by side to find what they share.
SIDE = 32


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray, kind: str) -> bytes:
    """The bytes of the numbers, all first bytes first, compressed."""
    own = np.ascontiguousarray(values, dtype=kind)
    return _small(own.view("u1").reshape(-1, own.dtype.itemsize).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw, size = _whole(data), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(size, -1).T).view(kind).reshape(-1)


def pack_strings(strings: list[bytes]) -> bytes:
    """Strings in order, each as the length that it shares with the one before and the rest; what is
    beyond SIDE bytes stands apart."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    table = np.array(strings, dtype=f"S{SIDE}").view("u1").reshape(n, SIDE)
    size = np.minimum(lengths, SIDE).astype("u1")
    shared = np.zeros(n, dtype="u1")
    if n > 1:
        apart = table[1:] != table[:-1]
        shared[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), SIDE)
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    column = np.arange(SIDE, dtype="u1")
    rest = table[(column >= shared[:, None]) & (column < size[:, None])]
    long = np.flatnonzero(lengths > SIDE)
    beyond = [strings[i][SIDE:] for i in long.tolist()]
    heads = np.array([n, len(long), len(rest)], dtype="<i8").tobytes()
    return _small(heads + shared.tobytes() + (size - shared).tobytes() + long.astype("<i8").tobytes() + (lengths[long] - SIDE).astype("<i8").tobytes() + rest.tobytes() + b"".join(beyond))


def unpack_strings(data: bytes) -> list[bytes]:
    raw = _whole(data)
    n, n_long, n_rest = np.frombuffer(raw[:24], "<i8").tolist()
    at = 24 + 2 * n
    long, more = np.frombuffer(raw[at : at + 16 * n_long], "<i8").reshape(2, n_long).tolist()
    at += 16 * n_long
    found, before, rest = [], b"", raw[at : at + n_rest]
    begin = 0
    for shared, own in zip(raw[24 : 24 + n], raw[24 + n : 24 + 2 * n], strict=True):
        end = begin + own
        before = before[:shared] + rest[begin:end]
        begin = end
        found.append(before)
    at += n_rest
    for i, size in zip(long, more, strict=True):
        found[i] += raw[at : at + size]
        at += size
    return found


def levels(codes: np.ndarray, first: np.ndarray, order: int, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1: (the number of the n-gram that ends at each place, or -1; of each n-gram
    the number of the one without its last word; its last word). ``first``: places where a text begins;
    ``size``: different words. Numbers are in the order of the words."""
    found = [(codes, np.zeros(size, dtype=np.int64), np.arange(size))]
    for _ in range(1, order):
        before = np.full(len(codes), -1, dtype=np.int64)
        before[1:] = found[-1][0][:-1]
        there = ~first & (before >= 0)
        different, number = np.unique(before[there] * size + codes[there], return_inverse=True)
        at = np.full(len(codes), -1, dtype=np.int64)
        at[there] = number
        found.append((at, different // size, different % size))
    return found


def _scattered(route: np.ndarray) -> np.ndarray:
    """32 bits of which the lower ones depend on all."""
    route = (route ^ (route >> np.uint64(16))) * np.uint64(0x45D9F3B) & np.uint64(0xFFFFFFFF)
    return route ^ (route >> np.uint64(15))


class Block:
    """A row of ``code``: the texts laid end to end as numbers of words. ``found`` has the n-grams of each
    order, and ``by_shard`` all of them in the order in which they are sent, shard by shard."""

    def __init__(self, row: object, order: int, shards: int):
        self.ids, self.learns = list(row.ids), np.array(row.learns, dtype=bool)
        self.lengths, self.codes = unpack(row.lengths, "<i4").astype(np.int64), unpack(row.codes, "<i4").astype(np.int64)
        self.words = unpack_strings(row.words) if len(self.codes) else []
        self.first = np.zeros(len(self.codes), dtype=bool)
        self.first[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True
        self.found = levels(self.codes, self.first, order, len(self.words)) if len(self.codes) else []
        own = np.fromiter(map(zlib.crc32, self.words), dtype=np.uint64, count=len(self.words))
        routes = [own]
        for _, head, last in self.found[1:]:
            routes.append(_scattered(routes[-1][head] * np.uint64(31) + own[last]))
        self.shard = (_scattered(np.concatenate(routes)) % np.uint64(shards)).astype(np.int64)
        self.by_shard = np.argsort(self.shard, kind="stable")

    def counts(self) -> np.ndarray:
        """How often each n-gram is in the texts that are learned from."""
        counted = np.repeat(self.learns, self.lengths)
        return np.concatenate([np.bincount(at[counted & (at >= 0)], minlength=len(head)) for at, head, _ in self.found])

    def rows(self, number: int) -> list[tuple]:
        """The rows of GRAMS."""
        if not self.found:
            return []
        every = names = self.words
        for _, head, last in self.found[1:]:
            names = [names[h] + b" " + self.words[w] for h, w in zip(head.tolist(), last.tolist(), strict=True)]
            every = every + names
        count, ordered = self.counts()[self.by_shard], self.shard[self.by_shard]
        ends = np.append(np.flatnonzero(np.diff(ordered)) + 1, len(ordered)).tolist()
        return [
            (number, int(ordered[begin]), pack_strings([every[i] for i in self.by_shard[begin:end].tolist()]), pack(count[begin:end], "<i4"))
            for begin, end in zip([0, *ends[:-1]], ends, strict=True)
        ]

    def answers(self, told: pd.DataFrame, kind: str) -> np.ndarray:
        """What the shards have told (shard, told), by the numbers of the n-grams."""
        out = np.zeros(len(self.by_shard), dtype=kind)
        if len(told):
            out[self.by_shard] = np.concatenate([unpack(x, kind) for x in told.sort_values("shard")["told"]])
        return out

    def coded(self) -> list[np.ndarray]:
        """The codes of each text."""
        return np.split(self.codes, np.cumsum(self.lengths)[:-1])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each place over the texts."""
        upto = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(self.lengths)
        return upto[ends] - upto[ends - self.lengths]


def code(docs: DataFrame, words: Callable[[bytes], list[bytes]], marks: bool = False) -> DataFrame:
    """The blocks of ``docs`` (doc_id, text, learns), one row each. ``words`` splits the bytes of a text;
    ``marks`` puts START before and END after its words; only texts with ``learns`` are counted.
    Ids travel as text, in which a null beside them changes no number."""
    schema = "block long, ids array<string>, learns array<boolean>, lengths binary, codes binary, words binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seen = TaskContext.get().partitionId(), 0
        known: defaultdict[bytes, int] = defaultdict()
        ids, coded, learns, held = [], [], [], 0

        def told() -> pd.DataFrame:
            names = list(known)
            ordered = sorted(range(len(names)), key=names.__getitem__)
            place = np.empty(len(names), dtype=np.int64)
            place[ordered] = np.arange(len(names))
            row = ((part << 32) + seen, ids, learns, pack(np.array([len(c) for c in coded]), "<i4"), pack(place[np.concatenate(coded)], "<i4"), pack_strings([names[i] for i in ordered]))
            return pd.DataFrame([row], columns=["block", "ids", "learns", "lengths", "codes", "words"])

        for batch in batches:
            for own, text, learn in zip(batch["doc_id"], batch["text"], batch["learns"], strict=True):
                if ids and held + len(text) > BLOCK_BYTES:
                    yield told()
                    seen += 1
                    ids, coded, learns, held = [], [], [], 0
                if not ids:
                    known = defaultdict()
                    known.default_factory = known.__len__
                found = [START, *words(text), END] if marks else words(text)
                ids.append(own)
                coded.append(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)))
                learns.append(bool(learn))
                held += len(text)
        if ids:
            yield told()

    source = docs.select(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.coalesce("learns", F.lit(False)).alias("learns"))
    return source.mapInPandas(run, schema)


def entries(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """The rows of GRAMS of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(Block(row, order, shards).rows(row.block), columns=["block", "shard", "grams", "counts"])

    return blocks.mapInPandas(run, GRAMS)


def shards_for(docs: DataFrame, text_col: str = "text") -> int:
    """Shards for a dictionary of these texts: as many as their bytes ask for, and some for a few texts."""
    held = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(FEW_SHARDS, -(-held // SHARD_BYTES))


class Shard:
    """The different strings of a shard as numbers; ``rows`` has the numbers that each row sent."""

    def __init__(self, frame: pd.DataFrame):
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        self.rows: list[np.ndarray] = []
        for grams in frame["grams"]:
            listed = unpack_strings(grams)
            self.rows.append(np.fromiter(map(known.__getitem__, listed), dtype=np.int32, count=len(listed)))
        self.strings = list(known)

    def total(self, counts: list[bytes], wanted: list[bool]) -> np.ndarray:
        """Of each string, the sum of the counts of those rows that are wanted."""
        sums = np.zeros(len(self.strings), dtype=np.int64)
        for at, own, add in zip(self.rows, counts, wanted, strict=True):
            if add:
                sums[at] += unpack(own, "<i4")  # a row has no string twice
        return sums


def placed(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``_rank``, its place from 1 in ``order``: rows are sorted by range, numbered in their
    part and moved by the sizes of the parts before. No task holds more than its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.cut(ranged.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # a row for each part
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    spark: SparkSession = df.sparkSession
    moved = rows.join(F.broadcast(spark.createDataFrame(offsets, "_part long, _before long")), "_part")
    return moved.withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")
