"""Importance resampling of documents towards a target distribution over hashed n-gram features.

A distinct-feature dictionary: the n-grams of corpus and target are counted as strings, every different
string of the dictionary is hashed to its bucket once, counts are added up by bucket, and the gains of
the buckets go back to the feature counts of the documents.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.blocks import Block, Shard, code, entries, pack, placed, shards_for
from verity.llm.common import Scratch, cut

#: Letters and digits; any byte beyond ASCII is part of a word. A-Z become a-z, all else a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _dictionary(buckets: int):
    """Of a shard's rows: the bucket of every entry, for the blocks of documents, and the shard's counts
    by bucket of corpus and target."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(frame)
        hashed = np.fromiter(map(zlib.crc32, shard.strings), dtype=np.int64, count=len(shard.strings)) % buckets
        target = frame["target"].tolist()
        counts = frame["counts"].tolist()
        own, theirs = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        np.add.at(own, hashed, shard.total(counts, [not t for t in target]))
        np.add.at(theirs, hashed, shard.total(counts, target))
        rows = [(block, own_shard, pack(hashed[at], "<i4"), None, None, None) for block, own_shard, at, t in zip(frame["block"], frame["shard"], shard.rows, target, strict=True) if not t]
        used = np.flatnonzero(own + theirs)
        rows += [(None, None, None, int(b), int(own[b]), int(theirs[b])) for b in used]
        return pd.DataFrame(rows, columns=["block", "shard", "told", "bucket", "s", "t"]).astype({"block": "Int64", "shard": "Int32", "bucket": "Int32", "s": "Int64", "t": "Int64"})

    return merge


def gains(counts: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket in thousandths of a nat; ``counts``: bucket, s, t. As many rows as buckets."""
    found = {r["bucket"]: (r["s"], r["t"]) for r in counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    s_all, t_all = sum(s for s, _ in found.values()), sum(t for _, t in found.values())
    each = (found.get(b, (0, 0)) for b in range(buckets))
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets)))) for s, t in each]


def _weigher(order: int, shards: int, gain: list[int]):
    def weigh(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(next(rows.itertuples()), order, shards)
        by_feature = np.array(gain, dtype=np.int64)[block.answers(told, "<i4")]
        value, features, offset = np.zeros(len(block.codes), dtype=np.int64), np.zeros(len(block.codes), dtype=np.int64), 0
        for at, head, _ in block.found:
            value += np.where(at >= 0, by_feature[offset + at], 0)
            features += at >= 0
            offset += len(head)
        n = block.sums(features)
        weight = np.where(n > 0, block.sums(value) // np.maximum(n, 1), 0)
        return pd.DataFrame({"doc_id": pd.Series(block.ids, dtype=object), "n_words": block.lengths, "n_features": n, "weight": weight})

    return weigh


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the id's digest."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight (floored mean gain of its features), score (weight
    and Gumbel noise of the id) and rank: 1 is the highest score, null if not drawn. Of the documents
    with ``min_words`` words, ``percent`` % are drawn, ties to the smaller id.

    * A null or empty text has no feature and weight 0; a null id is hashed as empty and comes first
      among ties. Rows that repeat are documents of their own, in any order among themselves.
    * Without target texts all gains are those of their counts of zero; an empty table gives no row.
    * Only the two named columns are read, whatever others there are.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("learns"))
        wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text"), F.lit(True).alias("learns"))
        shards = shards_for(own)
        blocks = scratch.cut(code(own, words), "importance-blocks")
        sent = entries(blocks, order, shards).withColumn("target", F.lit(False)).unionByName(entries(code(wanted, words), order, shards).withColumn("target", F.lit(True)))
        merged = sent.groupBy("shard").applyInPandas(_dictionary(buckets), "block long, shard int, told binary, bucket int, s long, t long")
        merged = scratch.cut(merged, "importance-dictionary")
        gain = gains(merged.where("bucket is not null").select("bucket", "s", "t"), buckets)
        told = merged.where("block is not null").select("block", "shard", "told")
        kind = docs.schema[id_col].dataType.simpleString()
        weighed = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_weigher(order, shards, gain), "doc_id string, n_words long, n_features long, weight long")
        scored = scratch.cut(weighed.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("score", F.col("weight") + _noise(seed)).withColumn("_short", F.col("n_words") < min_words), "importance-scores")
        drawn = scored.where("not _short").count() * percent // 100
        ordered = placed(scored, [F.col("_short"), -F.col("score"), F.col("doc_id")], scratch, "importance-places")
        return cut(ordered.select("doc_id", "n_features", "weight", "score", F.when(~F.col("_short") & (F.col("_rank") <= drawn), F.col("_rank")).alias("rank")), "importance-ranks")
