"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from verity.llm.common import cut

CAPACITY = 2048
END_ID = 0
#: Pieces in a district: the set of pieces that is packed together. Its islands are separate tasks.
DISTRICT = 2048
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
ELITES = 1
#: Tasks at most that share the districts, however many there are.
MOST_TASKS = 4096
#: Words whose ids a task keeps, once as new and once as old ones.
CACHED_WORDS = 150_000

Bin = tuple[int, list[int]]


# ---------------------------------------------------------------- tokens


#: Fixed value: the vocabulary's own split. Words of letters, digits or other signs with one blank before
#: them, contractions, blanks. Words of letters come first here: no contraction begins like one.
WORDS = r" ?{letter}+|'s|'t|'re|'ve|'m|'ll|'d| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"


@cache
def _split_words() -> Callable[[str], list[str]]:
    """The split of the byte-level vocabulary. The built-in engine is the faster one, most of all where the
    letters are listed, and agrees but for numerals that are no decimal digits and four separators; texts
    with those take the other."""
    listed = "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == "L")
    latin = re.compile(WORDS.format(letter=f"[{listed}]", digit="[0-9]", other=rf"[^\s0-9{listed}]")).findall
    plain = re.compile(WORDS.format(letter=r"[^\W\d_]", digit=r"\d", other=r"(?:[^\s\w]|_)")).findall
    exact = regex.compile(WORDS.format(letter=r"\p{L}", digit=r"\p{N}", other=r"[^\s\p{L}\p{N}]")).findall
    rare = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0100-\U0010ffff]").search
    odd = frozenset(map(chr, range(0x1C, 0x20))) | {c for c in map(chr, range(128, sys.maxunicode)) if unicodedata.category(c) in ("Nl", "No")}
    return lambda text: latin(text) if not rare(text) else plain(text) if odd.isdisjoint(text) else exact(text)


def _byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the
    others for the letters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(spare)) for b in range(256))


def _without_memory(tokenizer) -> BPE:
    """The tokenizer's model without its own memory of words, which costs more than it saves here."""
    own = json.loads(tokenizer.to_str())["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own["merges"]]
    return BPE(own["vocab"], merges, cache_capacity=0, **{k: v for k, v in own.items() if v is not None and k not in ("type", "vocab", "merges")})


class WordIds(dict):
    """Word to ids as little-endian unsigned 32-bit bytes; the vocabulary never merges over word
    borders, so each distinct word goes through the tokenizer's model once and is then remembered.
    Full, the memory becomes the old one, from which words that come again are taken back."""

    def __init__(self, tokenizer, cached_words: int | None = None):
        super().__init__()
        self.most = cached_words or CACHED_WORDS
        self.tokenize, self.letters, self.old = _without_memory(tokenizer).tokenize, _byte_letters(), {}
        self.packed = [struct.pack("<I", i) for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isascii() and word.isprintable():
                spelled = word.replace(" ", self.letters[32])
            else:
                spelled = word.encode().decode("latin-1").translate(self.letters)
            found = b"".join([self.packed[t.id] for t in self.tokenize(spelled)])
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


@cache
def _unassigned() -> Callable[[str], object]:
    """Finds a code point that this Python's tables do not know; the tokenizer's may be newer."""
    runs, last = [], -2
    for c in range(256, sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if c == last + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
            last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]").search


@cache
def token_bytes(tokenizer_file: str, cached_words: int | None = None) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as bytes; a worker keeps it for its next task. Texts that hold
    one of the tokenizer's added tokens, or a code point that may be split another way, go through the
    tokenizer whole."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file)
    split, ids = _split_words(), WordIds(whole, cached_words)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    rare, unassigned = re.compile("[\u0100-\U0010ffff]").search, _unassigned()

    def one(text: str) -> bytes:
        if any(token in text for token in added) or (rare(text) and unassigned(text)):
            own = whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(own)}I", *own)
        return b"".join(map(ids.__getitem__, split(text)))

    return lambda texts: list(map(one, texts))


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, cached_words: int | None = None) -> DataFrame:
    """One row per piece: a document's ids and an end id, cut into ``capacity`` tokens if longer (the
    first piece takes what is over). Null text is the empty text: the end id alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(tokenizer_file, cached_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, rows = [], []
                for k, raw in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    n = len(raw) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    start, stop = 0, first
                    while start < n:
                        own = raw[4 * start : 4 * stop]
                        ids.append(k)
                        rows.append((start, stop - start, zlib.crc32(own), own))
                        start, stop = stop, stop + capacity
                number, last = [], -1
                for k in ids:
                    number.append(number[-1] + 1 if k == last else 0)
                    last = k
                starts, lengths, crcs, own = zip(*rows, strict=True)
                columns = [part.column(0).take(pa.array(ids, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64).tolist() for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES.format(id=kind) + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(over, schema)


# ---------------------------------------------------------------- one island


def best_fit(lengths: list[int], items: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Place ``items`` (longest first) into the fullest bin that has room, else into a new one."""
    room = sorted((capacity - fill, k) for k, (fill, _) in enumerate(bins))
    bins = [(fill, own) for fill, own in bins]
    for item in items:
        need = lengths[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, k = room.pop(at)
            fill, own = bins[k]
            bins[k] = (fill + need, [*own, item])
            if free > need:
                insort(room, (free - need, k))
        else:
            bins.append((need, [item]))
            if capacity > need:
                insort(room, (capacity - need, len(bins) - 1))
    return bins


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose fill is less even (fuller full bins)."""
    return (-len(bins), sum((fill / capacity) ** 2 for fill, _ in bins))


def crossover(mother: list[Bin], father: list[Bin], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Inject a share of the father's fullest bins whole, drop the mother's bins that hold any of
    the same items, and best-fit the items that lost their bin."""
    ranked = sorted(father, key=lambda b: -b[0])
    upto = max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))
    injected = [b for b in ranked[:upto] if rng.random() < 0.7] or ranked[:1]
    taken = {i for _, own in injected for i in own}
    stay = [b for b in mother if taken.isdisjoint(b[1])]
    placed = taken.union(*(own for _, own in stay))
    displaced = sorted((i for _, own in mother for i in own if i not in placed), key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, [*injected, *stay], capacity)


def mutate(bins: list[Bin], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Dissolve a few of the emptiest bins and a few others, and best-fit their items."""
    order = sorted(range(len(bins)), key=lambda k: bins[k][0])
    gone = set(order[: max(1, len(order) // 20)]) | set(rng.integers(0, len(bins), max(1, len(bins) // 20)).tolist())
    loose = sorted((i for k in gone for i in bins[k][1]), key=lambda i: -lengths[i])
    return best_fit(lengths, loose, [b for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(lengths: list[int], founders: list[list[Bin]], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[Bin]]:
    """Solutions of an island after some generations, best first. It ends early where the number of
    bins equals its lower bound, which no packing goes below."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // capacity)
    by_length = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [*founders, best_fit(lengths, by_length, [], capacity)]
    better = lambda b: fitness(b, capacity)
    while len(people) < population and len(max(people, key=better)) > least:
        noise = rng.normal(0, 0.05 * capacity, len(lengths))
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] - noise[i])
        people.append(best_fit(lengths, order, [], capacity))
    people.sort(key=better, reverse=True)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        a, b = rng.permutation(len(people))[:2] if len(people) > 1 else (0, 0)
        child = crossover(people[a], people[b], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, capacity, rng)
        people = sorted([*people, child], key=better, reverse=True)[:population]
    return people


# ---------------------------------------------------------------- islands as tasks


def _ordered(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values("uid", kind="stable").reset_index(drop=True)


def _bins_of(places: bytes, lengths: list[int]) -> list[Bin]:
    own: dict[int, list[int]] = {}
    for item, k in enumerate(np.frombuffer(places, "<i4").tolist()):
        own.setdefault(k, []).append(item)
    return [(sum(lengths[i] for i in items), items) for items in own.values()]


def _places(bins: list[Bin], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, (_, own) in enumerate(bins):
        out[own] = k
    return out.tobytes()


ELITE = "district long, island int, bins int, places binary"


def _epoch(epoch: int, seed: int, capacity: int, generations: int, population: int, elites: int):
    def run(key: tuple, items: pd.DataFrame, migrants: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"district": [], "island": [], "bins": [], "places": []})
        lengths = _ordered(items)["length"].tolist()
        founders = [_bins_of(p, lengths) for p in migrants["places"]]
        best = evolve(lengths, founders, hash((seed, epoch, *map(int, key))) & 0x7FFFFFFF, capacity, generations, population)[:elites]
        return pd.DataFrame({"district": key[0], "island": key[1], "bins": [len(b) for b in best], "places": [_places(b, len(lengths)) for b in best]})

    return run


def pack(
    parts: DataFrame,
    capacity: int = CAPACITY,
    district: int = DISTRICT,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    elites: int = ELITES,
    seed: int = 7,
) -> DataFrame:
    """``parts`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces that fill a sequence alone get one each. The others are dealt by a hash of their place in
    the input to districts of about ``district`` pieces, whatever their ids, so no group is hot. Every district is
    packed by ``islands`` tasks that each breed their own solutions; between epochs the elite of an
    island moves to the next one of the ring. The best solution of a district places its pieces.
    """
    table = cut(parts, "packing-pieces")
    numbered = table.withColumn("uid", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == capacity)
    loose = numbered.where(F.col("length") < capacity)
    n = loose.count()
    districts = max(1, round(n / district))
    items = cut(loose.withColumn("district", F.pmod(F.xxhash64("uid"), F.lit(districts)).cast("long")), "packing-items")
    slim = items.select("district", "uid", "length")
    tasks = max(1, min(districts * islands, max(16, districts * islands // 4), MOST_TASKS))
    here = slim.select("*", F.explode(F.array(*map(F.lit, range(islands)))).alias("island")).repartition(tasks, "district", "island")
    elite = table.sparkSession.createDataFrame([], ELITE)
    for epoch in range(epochs):
        moved = elite.withColumn("island", F.pmod(F.col("island") + F.lit(1), F.lit(islands)))
        came = elite.unionByName(moved) if islands > 1 else elite
        settled = here.groupBy("district", "island").cogroup(came.repartition(tasks, "district", "island").groupBy("district", "island"))
        elite = cut(settled.applyInPandas(_epoch(epoch, seed, capacity, generations, population, elites), ELITE), "packing-elite")
    best = elite.groupBy("district").agg(F.min_by("places", F.struct("bins", "island")).alias("places"))

    names = [f.name for f in table.schema.fields]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", sequence_id long, offset long"

    def place(key: tuple, own: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in [*names, "sequence_id", "offset"]})
        own = _ordered(own)
        own["bin"] = np.frombuffer(won["places"].iloc[0], "<i4")
        own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
        own["sequence_id"] = own["bin"].astype("int64") * districts + int(key[0])
        return own[[*names, "sequence_id", "offset"]]

    halls = max(1, min(districts, max(16, districts // 4), MOST_TASKS))
    placed = items.repartition(halls, "district").groupBy("district").cogroup(best.repartition(halls, "district").groupBy("district")).applyInPandas(place, out_schema)
    alone = whole.select(*names, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cached_words: int | None = None, **options: int) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as can be found.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; see
    ``pieces`` and ``pack``. Null text is packed as the empty text (one end id); null ids are kept;
    rows that repeat are packed as often as they come; other columns are not looked at; an empty
    table gives an empty result. ``cached_words`` is what a task remembers instead of ``CACHED_WORDS``.
    """
    return pack(pieces(docs, tokenizer_file, id_col, text_col, capacity, cached_words=cached_words), capacity, **options)
