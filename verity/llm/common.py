"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that Python gets at once, 10,000 rows at most.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, one of our own under /tmp, on a
    single machine only: on a cluster other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file:///tmp/verity-checkpoints").rstrip("/")


def _write(df: DataFrame, name: str, numbers: bool = False) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    lists, before = "spark.sql.parquet.writeLegacyFormat", spark.conf.get("spark.sql.parquet.writeLegacyFormat")
    try:
        spark.conf.set(lists, "true" if numbers else before)
        df.write.options(**({"parquet.enable.dictionary": "false"} if numbers else {})).parquet(path)
    finally:
        spark.conf.set(lists, before)
    return spark.read.schema(schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that later steps (and a
    retry after a lost executor) start from the table and not from the work that made it."""
    return _write(df, name)[0]


class Scratch:
    """Tables that an operator needs while it runs: ``cut`` writes one, the end of the ``with`` block
    deletes them all. What the operator returns must not read them: it is cut by the function above.
    Tables of hashes (``numbers``) are written without a dictionary, which they would only fill, and with
    arrays as plain repeated fields, which take fewer steps a number than Spark's lists of groups."""

    def __init__(self, spark: SparkSession, numbers: bool = False):
        self.spark, self.paths, self.numbers = spark, [], numbers

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _write(df, name, self.numbers)
        self.paths.append(path)
        return table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths.clear()


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH_BYTES at a time: a batch of whole texts is held several times over, by the
    executor and by the Python worker of each of its tasks. Results do not depend on it."""
    if spark.conf.get(BATCH_SETTING, None) != str(BATCH_BYTES):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text: the key of the hold-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc_of(value: object) -> int:
    return zlib.crc32(str(value).encode())


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def known_labels(labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of all labelled ids outside the hold-out fold. Null ids and labels other than 0 and 1
    are left out; of an id with both labels, 1 counts."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.where(~held_out)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label, weight): at most ``per_class`` labelled ids of each class, by hash order,
    with their whole texts (of an id with several texts the smallest); ``weight`` makes up for the sampling.
    Labels are those of ``known_labels``."""
    known = known_labels(labels, label, held_out, id_col)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        n = totals.get(value, 0)
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = some.withColumn("weight", F.lit(n / max(1, min(n, per_class))))
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "weight")
