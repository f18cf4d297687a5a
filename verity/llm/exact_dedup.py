"""Exact dedup by content sort: range partition, sort, compare neighbours. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a text that the sampled splitters see; a hash follows, so that texts with one long
#: common beginning are still dealt to many partitions and the splitter sample stays small.
SPLITTER_CHARS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Class every row of ``docs`` with the rows that hold the same text.

    Returns one row per input row: the id, ``keep_id`` (id of the row that stays: the smallest or
    the largest of the class), ``group_size``, ``kept`` and ``text_sha256``.

    * Null text counts as the empty text; empty texts are a class like any other.
    * A null id never wins against another id; a class with null ids alone has a null ``keep_id``.
    * Rows that repeat both id and text count in ``group_size`` and share one answer.
    * Other columns are not looked at; an empty table gives an empty result.

    Equal texts that one task reads are merged before the text is shuffled, so a class that holds
    a third of all rows sends one row per task. What is left is range-partitioned by the sampled
    beginnings of the texts and a hash (so that texts of one beginning are spread), sorted, and equal
    neighbours (whole texts compared) become a class.
    The rows then find their class by the digest of the text in a join that Spark may split.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    merged = (
        rows.withColumn("_task", F.spark_partition_id())
        .groupBy("_task", "_text")
        .agg(best("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
        .select(F.substring("_text", 1, SPLITTER_CHARS).alias("_head"), F.xxhash64("_text").alias("_hash"), "_text", "_best", "_n")
    )
    ranged = merged.repartitionByRange("_head", "_hash").sortWithinPartitions("_head", "_hash", "_text")
    same = Window.partitionBy("_head", "_hash", "_text")
    classes = (
        ranged.select(
            "_text",
            best("_best").over(same).alias("keep_id"),
            F.sum("_n").over(same).alias("group_size"),
            F.row_number().over(same.orderBy("_head")).alias("_place"),
        )
        .where((F.col("_place") == 1) & (F.col("group_size") > 1))
        .select(F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    )
    keyed = rows.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    found = keyed.join(classes, "_sha", "left")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("_id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
