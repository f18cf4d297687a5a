"""Input tables, cutting a plan by a written table, and running sums over a sorted table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where unset, one of our own under /tmp, on a
    single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file:///tmp/verity-checkpoints").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: iterations start from a table and survive a
    lost executor."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def cut_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``cut``, and the rows that were written, counted while they are."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return done, seen.get["n"]


class Scratch:
    """Tables that an iteration needs while it runs: ``cut`` and ``cut_counted`` write one, ``drop`` deletes
    one, the end of the ``with`` block those that are left. What is returned must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}", df.schema
        df.write.parquet(path)
        table = self.spark.read.schema(schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def cut_counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``cut``, and sums over the rows, made while they are written."""
        seen = Observation()
        done = self.cut(df.observe(seen, *[F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in counts.items()]), name)
        return done, seen.get

    def drop(self, table: DataFrame) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for table, _ in list(self.paths.values()):
            self.drop(table)


def eq_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys that may be null; without keys ``b`` is one row."""
    if not keys:
        return a.crossJoin(b)  # one row on the right: a total
    renamed = b.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in b.columns])
    on = [a[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return a.join(renamed, on).drop(*[f"__{k}" for k in keys])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows of its key up to and with this one in
    ``order`` (by that name), and over all rows of its key (``<name>_all``).

    Rows are sorted by range of key and order, summed within each partition, and moved by the sums of
    the partitions before, so no task holds a key, however many rows it has.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut(ranged.select("*", F.monotonically_increasing_id().alias("_at"), *[x.alias(f"_x{i}") for i, x in enumerate(sums.values())]), "running").withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[F.sum(f"_x{i}").over(inside).alias(f"_s{i}") for i in range(len(sums))])
    parts = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_x{i}").alias(f"_p{i}") for i in range(len(sums))])
    everything = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # as many rows as partitions
    before = everything.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_part", *[F.coalesce(F.sum(f"_p{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))], *[F.sum(f"_p{i}").over(everything).alias(f"_a{i}") for i in range(len(sums))])
    joined = eq_join(within, offsets, [*keys, "_part"])
    return joined.select(*[f"`{c}`" for c in df.columns], *[x for i, name in enumerate(sums) for x in ((F.col(f"_s{i}") + F.col(f"_b{i}")).alias(name), F.col(f"_a{i}").alias(f"{name}_all"))])
