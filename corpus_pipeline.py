"""A corpus pipeline of five operators: language ID, line dedup, near-dedup, mixing, packing.

Near duplicates are told by the Jaccard similarity of five-word shingles. Candidates come from SimHash
fingerprints by their deletion-variant signatures; as these lose links at that similarity, an exact prefix
filter over the shingle sets finds the rest.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm.common import Scratch, cut, small_batches, table
from verity.llm.language_id import identify, learn_languages
from verity.llm.line_dedup import line_dedup
from verity.llm.mixing import copies, learn_domains, memberships, mix
from verity.llm.packing import pack_documents
from verity.llm.queries import TARGET_WEIGHTS, domains_of, tokenizer_file
from verity.llm.simhash_dedup import drop_near_duplicates

#: Words of a shingle in the near-duplicate stage, and the Jaccard similarity of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Rows (an id and a number of copies, so 40 MB at most) up to which the copies to take are broadcast.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or far from every centroid go."""
    small_batches(spark)
    told = identify(docs, learn_languages(docs))
    return told.where("lang_accepted").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; those left without a word go."""
    cleaned = line_dedup(docs)
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: by SimHash first, then by the exact filter."""
    small_batches(spark)
    return drop_near_duplicates(docs, width=SHINGLE_WORDS, similarity=SIMILARITY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that expected domain tokens meet the targets."""
    model = learn_domains(docs, domains_of(table(spark, sf_dir, "labels")))
    rated = mix(memberships(docs.select("doc_id", "text"), model), model, TARGET_WEIGHTS)
    taken = cut(rated.groupBy("doc_id").agg(F.max("rate").alias("rate")).withColumn("_copies", copies(F.col("rate"), F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "_copies"), "mixing-copies")
    side = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    joined = docs.join(side, docs["doc_id"].eqNullSafe(taken["_id"]))
    return joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Classifiers and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:  # what the last stage does not read goes
        for name, stage in STAGES[:-1]:
            keep = cut if name == STAGES[-2][0] else scratch.cut
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
