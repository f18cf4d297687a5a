"""A keyed store of outputs that a broken-off writer leaves as it was.

A store is a folder of versions and a file that names the current one. A writer puts a new version beside
the others and then renames a new file over the old name, which a file system like HDFS does at once; so
readers see the old or the new state and nothing between. Where renames copy (object stores), use a
table format that commits by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: The name of the file that tells the current version, and how a version is called.
CURRENT, VERSION = "current", "version-"


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers see."""
    fs, named = _fs(spark, f"{path}/{CURRENT}")
    return spark.read.text(str(named)).first()[0] if fs.exists(named) else None


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    name = current_version(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def _switch(spark: SparkSession, path: str, name: str) -> None:
    """Readers see the version of this name from now on."""
    fs, _ = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(f"{path}/_next-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(hadoop.Path(f"{path}/{CURRENT}")), over)


def write_store(new: DataFrame, key: Sequence[str], path: str, by: str = "run") -> str:
    """Adds ``new`` to the store, in place of what it has of the same keys; returns the version's name.

    Saved rows of other keys are carried over. The version before stays for readers that have begun;
    older ones, and what broken-off writers have left, go. One writer at a time.
    """
    spark = new.sparkSession
    before = current_version(spark, path)
    saved = None if before is None else spark.read.parquet(f"{path}/{before}")
    kept = new if saved is None else saved.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)
    name = f"{VERSION}{uuid.uuid4().hex}"
    kept.write.partitionBy(by).parquet(f"{path}/{name}")
    _switch(spark, path, name)
    fs, folder = _fs(spark, path)
    for status in fs.listStatus(folder):
        own = status.getPath().getName()
        if own not in (CURRENT, name, before) and own.startswith((VERSION, "_next-")):
            fs.delete(status.getPath(), True)
    return name
