"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verity.llm.common import Scratch, cut
from verity.llm.components import connected_components

BITS = 64
SEED = 42
#: Fingerprints that meet in one comparison at most; larger signature buckets are cut into blocks
#: and every pair of blocks is compared, so nothing is lost and no task grows with the bucket.
BLOCK = 4096


def fingerprint_of(text: str | None, width: int) -> int:
    """The signed 64-bit SimHash of a text; zero if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    parts = [words[i:] for i in range(width)]
    shingles = map(b" ".join, zip(*parts, strict=False)) if len(words) > width else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int) -> Column:
    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py(), width) for t in texts], pa.int64())

    return of(text)


def segments(max_distance: int) -> list[tuple[int, int]]:
    """(start, width) of the fewest segments of which one differs by at most one bit."""
    n = (max_distance + 1 + 1) // 2
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def signatures(prints: DataFrame, max_distance: int) -> DataFrame:
    """(kind, value, fp): every segment whole, and once with each of its bits taken as a wildcard."""
    keys, kind = [], 0
    for start, width in segments(max_distance):
        whole = (1 << width) - 1
        for wild in range(-1, width):
            mask = (whole & ~(1 << wild) if wild >= 0 else whole) << start
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(kind).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed)).alias("value")))
            kind += 1
    return prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.kind", "key.value", "fp")


def _wild_bits(max_distance: int) -> np.ndarray:
    """By kind, the bit that is the wildcard; -1 for whole segments."""
    return np.array([start + wild if wild >= 0 else -1 for start, width in segments(max_distance) for wild in range(-1, width)])


def _spanning(fps: np.ndarray, wild: int, max_distance: int) -> list[tuple[int, int]]:
    """Links that join what the near pairs of one bucket join, one less than nodes at most. In a
    wildcard bucket only pairs that differ in the wildcard count; the others meet elsewhere."""
    left = fps
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            apart = left ^ one
            near = np.bitwise_count(apart) <= max_distance
            if wild >= 0:
                near &= (apart >> np.uint64(wild)) & np.uint64(1) == 1
            if near.any():
                new = left[near]
                left = left[~near]
                out.extend((int(one), int(x)) for x in new)
                frontier.extend(new)
    return out


def _links(max_distance: int):
    wild_bits = _wild_bits(max_distance)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def runs(kind: np.ndarray, value: np.ndarray, block: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fresh = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (value[1:] != value[:-1]) | (block[1:] != block[:-1])])
        sizes = np.diff(np.r_[fresh, len(kind)])
        wild = wild_bits[kind[fresh]]
        bit = (fps >> np.repeat(np.maximum(wild, 0), sizes).astype(np.uint64)) & np.uint64(1)
        mixed = np.minimum.reduceat(bit, fresh) != np.maximum.reduceat(bit, fresh)
        live = (sizes > 1) & (mixed | (wild < 0))
        two = fresh[live & (sizes == 2)]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_distance
        src, dst = [fps[two[near]].view(np.int64)], [fps[two[near] + 1].view(np.int64)]
        for at, size, w in zip(fresh[live & (sizes > 2)], sizes[live & (sizes > 2)], wild[live & (sizes > 2)], strict=True):
            if found := _spanning(fps[at : at + size], int(w), max_distance):
                pairs = np.array(found, np.uint64).view(np.int64)
                src.append(pairs[:, 0])
                dst.append(pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], schema=schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive whole and in order; the last of a batch may go on in the next."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now[3] = now[3].astype(np.int64).view(np.uint64)
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[end:] for x in now]
            if end:
                yield runs(*(x[:end] for x in now))
        if held and len(held[0]):
            yield runs(*held)

    return over


def near_links(prints: DataFrame, max_distance: int, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(src, dst) between distinct fingerprints (column ``fp``): links of at most ``max_distance``
    bits that connect all that such links connect."""
    keys = signatures(prints, max_distance)
    hot = (scratch.cut if scratch else cut)(keys.groupBy("kind", "value").count().where(F.col("count") > block), "simhash-hot")
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 100_000 else hot
        cuts = F.ceil(F.col("count") / block).cast("int")
        own = F.pmod(F.xxhash64("fp"), cuts).cast("int")
        other = F.explode(F.expr("sequence(0, cuts - 1)"))
        dealt = keys.join(side, ["kind", "value"], "left").select("kind", "value", "fp", F.coalesce(cuts, F.lit(1)).alias("cuts"), F.coalesce(own, F.lit(0)).alias("own"))
        keys = dealt.select("kind", "value", "fp", "own", "cuts", other.alias("other")).select(
            "kind", "value", (F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")).cast("long").alias("pair"), "fp"
        )
    else:
        keys = keys.select("kind", "value", F.lit(0).cast("long").alias("pair"), "fp")
    placed = keys.repartition("kind", "value", "pair").sortWithinPartitions("kind", "value", "pair")
    return placed.mapInArrow(_links(max_distance), "src long, dst long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, max_distance: int = 3) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    A fingerprint is the SimHash (XXH64, seed 42) of the ``width``-word shingles of the whole text,
    repeats included; documents link if their fingerprints differ in ``max_distance`` bits or fewer
    and ``component_id`` is the smallest id that can be reached over links.

    * Null and blank texts have no word: fingerprint zero, linked like any other.
    * Fewer words than ``width`` make one shingle.
    * Equal fingerprints are one node, however many rows share it, so copies cost no pairs.
    * A null id stays a row of its own and is ignored when the smallest id is taken.
    * Other columns are not looked at; an empty table gives an empty result.
    """
    rows = cut(docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col), width).alias("fp")), "simhash-prints")
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.cut(rows.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-distinct")
        roots = connected_components(near_links(prints.select("fp"), max_distance, scratch=scratch), scratch=scratch).withColumnRenamed("node", "fp")
        rooted = scratch.cut(prints.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
        lowest = scratch.cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest")
        classes = cut(rooted.join(lowest, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


# ---------------------------------------------------------------- by similarity of shingle sets


#: Copies of a shingle from which it counts as common, and the common shingles that are told apart (with
#: their counts 6 MB). They only set the order of shingles, and any fixed order gives the same result: a
#: better one fewer candidates. Shingles are counted whose hash is so low that a prefix may hold them: REACH
#: times the share of a set that its prefix is.
COMMON, COMMON_KEYS, REACH = 8, 400_000, 1.5
#: Bits of a sketch.
SKETCH = 1024
#: Shingles that are counted at once, and words whose hashes a task keeps.
COUNTED_AT_ONCE, CACHED_WORDS = 1 << 19, 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingle_hashes(text: str, width: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the different ``width``-word shingles; fewer words make one shingle."""
    words = text.encode().lower().split()
    of = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    short = min(width, len(words))
    mixed = np.full(max(1, len(words) - width + 1), short, np.uint64)
    for k in range(short):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + of[k : k + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(27)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def sketch_of(hashes: np.ndarray) -> bytes:
    """SKETCH bits, each of which tells if an odd number of shingles fell on it. Two sets differ in as many
    shingles as their sketches differ in bits, or more."""
    counts = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def jaccard(a: str, b: str, width: int) -> float:
    """Of the sets of ``width``-word shingles; fewer words make one shingle."""

    def shingles(text: str) -> set[bytes]:
        words = text.encode().lower().split()
        return {b" ".join(p) for p in zip(*(words[i:] for i in range(width)), strict=False)} or {b" ".join(words)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def _common(texts: DataFrame, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles in the order of their hashes, and for each its rank by count over all texts."""
    low = np.uint64(min(1.0, REACH * (1 - similarity)) * (2**64 - 2**11))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = _WordHashes(), [], 0

        def counted() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = shingle_hashes(text.as_py(), width, words)
                held.append(found[: np.searchsorted(found, low)].copy())
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    total = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    keys = total.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).select("key").toArrow()["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def _prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, similarity: float) -> DataFrame:
    """``rows`` (_id, h1, h2, text) with the size of the shingle set, its sketch, its SimHash and its prefix in
    place of the text: in the order from rare to common, so many shingles that similar sets share one of them."""
    keys, ranks = common

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            sizes, own, sketches, prints = [], [], [], []
            for text in batch.column(3):
                found = shingle_hashes(text.as_py(), width, words)
                sketches.append(sketch_of(found))
                prints.append(set_fingerprint(found))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    found = found[np.argsort(np.where(keys[at] == found, ranks[at], 0), kind="stable")]
                sizes.append(len(found))
                own.append(found[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1].view(np.int64).copy())
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(prints, pa.int64()), prefix], names=["_id", "h1", "h2", "n", "sketch", "fp", "prefix"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(over, f"_id {kind}, h1 long, h2 long, n int, sketch binary, fp long, prefix array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch], width: int, keys: int):
    """Sorted rows as (columns, is a row the first of its bucket, rows that were yielded before): a bucket
    that may go on is held whole, as large as it is."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        before = len(held[0]) if held else 0
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        fresh = np.zeros(len(now[0]), bool)
        fresh[0] = True
        for column in now[:keys]:
            fresh[1:] |= column[1:] != column[:-1]
        yield now, fresh, before
        held = [x[np.flatnonzero(fresh)[-1] :] for x in now]


ENTRY = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with more than one member; a row is settled when the next one is seen."""
    last: list[np.ndarray] = []  # the row before, and if its bucket has others
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        known = np.zeros(len(now[0]), bool)
        if last:
            now, known = [np.concatenate([x[:1], y]) for x, y in zip(last[:4], now, strict=True)], np.r_[last[4], known]
        same = now[0][1:] == now[0][:-1]
        keep = known | np.r_[same, False] | np.r_[False, same]
        last = [*(x[-1:] for x in now), keep[-1:]]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]], f.type) for x, f in zip(now, ENTRY, strict=True)], schema=ENTRY)
    if last and last[4][0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(last[:4], ENTRY, strict=True)], schema=ENTRY)


def _bucket_pairs(similarity: float, tried: bool):
    """Pairs of the members of a bucket part (key, part, uid, n, pos, root) that sizes and positions allow
    and no link joins yet: all of them, or (``tried``) those of a member with the one before it and with
    the first one."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, fresh, before in _runs(batches, 6, 2):
            uid, n, pos, root = (x.astype(np.int64) for x in now[2:])
            place = np.arange(len(fresh))
            first = np.maximum.accumulate(np.where(fresh, place, 0))
            depth = place - first
            depth[:before] = 0  # done with the batch before
            rows, back = np.flatnonzero(depth), 0
            while len(rows):
                back += 1
                rows = rows[depth[rows] >= back]
                for other in (rows - back, first[rows]) if tried else (rows - back,):
                    small, large = np.minimum(n[rows], n[other]), np.maximum(n[rows], n[other])
                    least = np.ceil((small + large) * (similarity / (1 + similarity)) - 1e-9)
                    fits = (small >= similarity * large - 1e-9) & (np.minimum(n[rows] - pos[rows], n[other] - pos[other]) >= least)
                    fits &= (root[rows] != root[other]) & (uid[rows] != uid[other])
                    if fits.any():
                        yield pa.RecordBatch.from_arrays([pa.array(uid[rows[fits]]), pa.array(uid[other[fits]])], names=["src", "dst"])
                if tried:
                    break

    return over


def fingerprint_pairs(nodes: DataFrame, max_distance: int, scratch: Scratch) -> DataFrame:
    """(src, dst) between ``nodes`` (uid, fp): pairs that connect all whose fingerprints links of at most
    ``max_distance`` bits connect. Nodes of one fingerprint are paired with the first of them."""
    first = scratch.cut(nodes.groupBy("fp").agg(F.min("uid").alias("first")), "simhash-distinct")
    same = nodes.select("uid", "fp").join(first, "fp").where("uid <> first").select(F.col("uid").alias("src"), F.col("first").alias("dst"))
    of = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("first").alias(name))
    near = near_links(first.select("fp"), max_distance, scratch=scratch).withColumnsRenamed({"src": "a", "dst": "b"})
    return same.unionByName(near.join(of("a", "src"), "a").join(of("b", "dst"), "b").select("src", "dst"))


def similar_links(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, scratch: Scratch, block: int = BLOCK, max_distance: int = 3) -> DataFrame:
    """(src, dst) between ``nodes`` (uid, h1, h2, n, sketch, fp, prefix): links of enough Jaccard similarity of
    the texts (h1, h2, text) that connect all that such links connect.

    SimHash comes first: nodes whose fingerprints meet in a deletion-variant signature and differ in at most
    ``max_distance`` bits are pairs to verify. It misses pairs of that similarity, so the exact filter
    that follows looks for all pairs that the verified ones do not join yet.

    Similar sets have a shingle of their prefixes in common, so they meet in its bucket. Buckets of one
    member go first. A bucket of more than ``block`` members is cut into blocks, and every two blocks
    meet in a task of their own, so no task holds a whole bucket and no pair is left out. Each member is
    first compared with one earlier member, of those next to it in its buckets the one that is so most
    often; then all pairs that verified links do not join yet are compared, the likeliest one of each
    member before the others. Pairs whose sketches differ too much are left out before texts are fetched.
    """
    entries = nodes.select("uid", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "uid", "n", "pos")
    shared = scratch.cut(entries.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_only, "key long, uid long, n int, pos int"), "similar-shared")
    hot = scratch.cut(shared.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block), "similar-hot")
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 100_000 else hot
        cuts, own = F.coalesce(F.ceil(F.col("c") / block), F.lit(1)).cast("long"), F.pmod(F.xxhash64("uid"), F.col("cuts"))
        split = shared.join(side, "key", "left").select("key", "uid", "n", "pos", cuts.alias("cuts"))
        split = split.select("key", "uid", "n", "pos", "cuts", own.alias("own"), F.explode(F.expr("sequence(0L, cuts - 1)")).alias("other"))
        dealt = split.select("key", (F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")).alias("part"), "uid", "n", "pos")
    else:
        dealt = shared.select("key", F.lit(0).cast("long").alias("part"), "uid", "n", "pos")

    def pairs_of(rows: DataFrame, tried: bool, name: str) -> DataFrame:
        placed = rows.select("key", "part", "uid", "n", "pos", "root").repartition("key", "part").sortWithinPartitions("key", "part", "uid")
        return scratch.cut(placed.mapInArrow(_bucket_pairs(similarity, tried), "src long, dst long").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")), name)

    def likeliest(pairs: DataFrame) -> DataFrame:
        return scratch.cut(pairs.groupBy("src").agg(F.max(F.struct("c", "dst")).alias("m")).select("src", "m.dst"), "similar-likeliest")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(a.as_py(), b.as_py(), width) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(near, pa.bool_()))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for k in (4, 5))
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            fits = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= sizes - 2 * np.ceil(sizes * (similarity / (1 + similarity)) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(fits, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda name: nodes.select(F.col("uid").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch"))
        told = pairs.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", "src_n", "dst_n", "src_sketch", "dst_sketch")
        pairs = scratch.cut(told.mapInArrow(close, "src long, dst long"), "similar-close")
        wanted = scratch.cut(pairs.select(F.col("src").alias("uid")).unionByName(pairs.select(F.col("dst").alias("uid"))).distinct().join(nodes.select("uid", "h1", "h2"), "uid"), "similar-wanted")
        found = scratch.cut(texts.join(F.broadcast(wanted) if wanted.count() <= 500_000 else wanted, ["h1", "h2"]).select("uid", "text").dropDuplicates(["uid"]), "similar-texts")
        both = pairs.join(found.select(F.col("uid").alias("src"), F.col("text").alias("a")), "src").join(found.select(F.col("uid").alias("dst"), F.col("text").alias("b")), "dst")
        return scratch.cut(both.select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long"), "similar-links")

    hashed = scratch.cut(fingerprint_pairs(nodes, max_distance, scratch), "similar-simhash")
    links = verified(likeliest(pairs_of(dealt.withColumn("root", F.col("uid")), True, "similar-tried")).unionByName(hashed).distinct())
    roots = connected_components(links, scratch=scratch).withColumnRenamed("node", "uid")
    pairs = pairs_of(dealt.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")), False, "similar-pairs")
    best = likeliest(pairs)
    links = links.unionByName(verified(best))
    roots = connected_components(links, scratch=scratch)
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    left = pairs.select("src", "dst").join(best, ["src", "dst"], "left_anti").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    left = scratch.cut(left.where(F.coalesce("src_root", "src") != F.coalesce("dst_root", "dst")).select("src", "dst"), "similar-left")
    return links if left.isEmpty() else links.unionByName(verified(left))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """One row per document: the id and ``component_id``, the smallest id of its group.

    Documents link if the Jaccard similarity of their ``width``-word shingles is ``similarity`` or more;
    every link was verified on the whole texts. Candidates come from SimHash fingerprints of the sets of
    64-bit shingle hashes by deletion-variant signatures, and then from an exact prefix, length and
    positional filter over these sets, so no similar pair is missed.

    * Null texts count as empty; texts without a word are one group.
    * Equal texts are one node, however many rows share it. Null ids are ignored when the smallest is taken.
    * Other columns are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    common = _common(docs.select(text.alias("text")), width, similarity)
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.cut(_prefixes(docs.select(F.col(id_col).alias("_id"), *hashed, text.alias("text")), common, width, similarity), "similar-rows")
        merged = rows.groupBy("h1", "h2").agg(F.min("_id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
        nodes = scratch.cut(merged.withColumn("uid", F.monotonically_increasing_id()), "similar-nodes")
        links = similar_links(nodes, docs.select(*hashed, text.alias("text")), width, similarity, scratch, block)
        roots = connected_components(links, scratch=scratch).withColumnRenamed("node", "uid")
        rooted = scratch.cut(nodes.select("uid", "h1", "h2", "low").join(roots, "uid", "left").select("h1", "h2", "low", F.coalesce("root", "uid").alias("root")), "similar-rooted")
        lowest = scratch.cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "similar-lowest")
        classes = scratch.cut(rooted.join(lowest, "root").select("h1", "h2", "component_id"), "similar-classes")
        return cut(rows.select("_id", "h1", "h2").join(classes, ["h1", "h2"]).select(F.col("_id").alias(id_col), "component_id"), "similar-groups")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the one document of each group (``similar_groups``) whose id is the smallest;
    columns as they came. Rows that repeat that id and text stay together; rows with a null id have no
    id to be held against and stay."""
    kept = similar_groups(docs, id_col, text_col, width, similarity).where(F.col(id_col) == F.col("component_id"))
    ids = kept.select(F.col(id_col).alias("_kept")).distinct()
    nulls = docs.where(F.col(id_col).isNull())
    return docs.join(ids, F.col(id_col) == F.col("_kept"), "left_semi").unionByName(nulls)
