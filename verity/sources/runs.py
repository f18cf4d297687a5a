"""Readers of datasets, results, graphs, trajectories and archives; row slices and samples."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions.permute import permuted
from verity.plans.tables import running

EXECUTION = "instance_id STRING, patch STRING, FAIL_TO_PASS ARRAY<STRING>, PASS_TO_PASS ARRAY<STRING>, image_name STRING, repo STRING, model STRING, problem_statement STRING, instruction STRING, num_actions INT, conversation_archive_path STRING, benchmark_run_name STRING, model_pred_patch STRING, eval_report STRING, eval_test_output STRING, resolved BOOLEAN, benchmark STRING, trajectory_type STRING"
RESULTS = "instance_id STRING, model STRING, benchmark STRING, difficulty STRING, resolved INT, estimated_confidence DOUBLE, total_tokens BIGINT, generated_tokens BIGINT, cost DOUBLE"
NODE = "STRUCT<id STRING, kind STRING, confidence DOUBLE, confidence_rationale STRING, goal_name STRING, auditable_claim STRING, reasoning STRING, confidence_in_children DOUBLE, evidence STRING, step_numbers ARRAY<INT>, contribution STRING>"
EDGE = "STRUCT<source STRING, target STRING, relationship_type STRING>"
GRAPH = f"nodes ARRAY<{NODE}>, edges ARRAY<{EDGE}>, goal_zero_node_id STRING"
ACP = "type STRING, text STRING, tool_call_id STRING, kind STRING, title STRING, status STRING, content ARRAY<STRUCT<type STRING, content STRUCT<type STRING, text STRING>>>"


def dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXECUTION).parquet(path)


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results of all runs below ``path``; ``run`` is the folder of the file. Types are never inferred."""
    rows = spark.read.schema(RESULTS).option("recursiveFileLookup", True).option("pathGlobFilter", "results.csv").csv(path, header=True)
    return rows.withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+\z", 1))


def json_documents(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """Files called ``name`` below ``path``, one document each, with their path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path, multiLine=True)
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"))


def run_names(files: DataFrame, below: str) -> DataFrame:
    """Different runs of found files (``file_path``), sorted: the folders between ``below`` and the file."""
    return files.select(F.regexp_extract("file_path", re.escape(below.rstrip("/")) + r"/(.*)/[^/]+\z", 1).alias("run")).distinct().orderBy("run")


def key_from_path(path: Column) -> tuple[Column, Column]:
    """(instance, model) of a relative folder: its first part, and the rest joined by slashes."""
    parts = F.split(path, "/")
    return F.element_at(parts, 1).alias("instance_id"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("model")


def graph_tables(graphs: DataFrame, gid: Column) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of graph documents."""
    keyed = graphs.withColumn("gid", gid)
    nodes = keyed.select("gid", F.posexplode("nodes").alias("pos", "n")).select("gid", "pos", "n.*")
    edges = keyed.select("gid", F.posexplode("edges").alias("pos", "e")).select("gid", "pos", "e.*")
    return nodes.withColumn("confidence", F.coalesce("confidence", F.lit(-1.0))), edges


def acp_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines trajectories: typed columns, the whole record as a variant, the file and
    the line number. A record knows its line by its place among the lines of its file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("traj"), F.col("value"))
    each = lines.select("traj", F.posexplode(F.split("value", "\n")).alias("idx", "line")).where("trim(line) <> ''")
    return each.select("traj", "idx", F.from_json("line", ACP).alias("r"), F.parse_json("line").alias("payload")).select("traj", "idx", "r.*", "payload")


ARCHIVE = "path string, idx int, event_id string, kind string, payload string, error string"
EVENT_NAME = re.compile(r"(?:^|/)events/event-(\d+)-([^/]+)\.json$")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """Events of ``.tar.gz`` conversation archives in order, one row each (base state: idx -1).

    Members that are not files, names that do not fit, and payloads whose id differs from the name's
    give a row with ``error``; duplicates and gaps are found by ``archive_errors``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
                        for member in tar:
                            name = member.name
                            if member.isdir() or name.endswith(".lock"):
                                continue
                            text = tar.extractfile(member).read().decode() if member.isfile() else None
                            if text is None:
                                rows.append((where, None, None, None, None, f"not a file: {name}"))
                            elif name.rsplit("/", 1)[-1] == "base_state.json":
                                rows.append((where, -1, None, "base_state", text, None))
                            elif m := EVENT_NAME.search(name):
                                own = json.loads(text)
                                wrong = None if own.get("id") == m[2] else f"payload id differs: {name}"
                                rows.append((where, int(m[1]), m[2], own.get("kind"), text, wrong))
                            else:
                                rows.append((where, None, None, None, None, f"odd name: {name}"))
                except (tarfile.TarError, OSError, ValueError) as e:
                    rows.append((where, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "idx", "event_id", "kind", "payload", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, ARCHIVE)


def archive_errors(events: DataFrame) -> DataFrame:
    """(path, error): what the reader found, repeated places or ids, gaps, and base states other than one."""
    own = events.where("error is not null").select("path", "error")
    good = events.where("error is null")
    real = good.where("idx >= 0")
    repeated = real.groupBy("path", "idx").count().where("count > 1").select("path", F.concat(F.lit("repeated index "), F.col("idx").cast("string")).alias("error"))
    ids = real.groupBy("path", "event_id").count().where("count > 1").select("path", F.concat(F.lit("repeated id "), "event_id").alias("error"))
    per = good.groupBy("path").agg(F.count_if(F.col("idx") == -1).alias("states"), F.coalesce(F.max("idx"), F.lit(-1)).alias("last"), F.countDistinct(F.when(F.col("idx") >= 0, F.col("idx"))).alias("n"))
    gaps = per.where("last + 1 <> n").select("path", F.lit("index gap").alias("error"))
    states = per.where("states <> 1").select("path", F.lit("base states other than one").alias("error"))
    empty = per.where("n = 0").select("path", F.lit("no events").alias("error"))
    out = own
    for other in (repeated, ids, gaps, states, empty):
        out = out.unionByName(other)
    return out


# ---------------------------------------------------------------- slices and samples


def parse_slice(text: str) -> slice:
    """``start:stop:step`` in whole numbers, each part optional; a plain number is no slice."""
    m = re.fullmatch(r"\s*(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?\s*)?", text)
    if not m:
        raise ValueError(f"no slice: {text!r}")
    return slice(*(int(x) if x is not None else None for x in m.groups()))


def row_slice(df: DataFrame, part: slice, n: int, order: str = "ord") -> DataFrame:
    """Rows of a Python slice over the 0-based place in ``order``; bounds beyond n are an error."""
    for bound in (part.start, part.stop):
        if bound is not None and not -n <= bound <= n:
            raise ValueError(f"slice bound {bound} is outside of {n} rows")
    start, stop, step = part.indices(n)
    low, high = (start, stop) if step > 0 else (stop + 1, start + 1)
    place = numbered(df, order)
    return place.where((F.col("_at") >= low) & (F.col("_at") < high) & (F.pmod(F.col("_at") - start, F.lit(abs(step))) == 0)).drop("_at")


def numbered(df: DataFrame, order: str = "ord") -> DataFrame:
    """``df`` with ``_at``, the 0-based place in ``order``."""
    return running(df, [], [order], {"_place": F.lit(1)}).withColumn("_at", F.col("_place") - 1).drop("_place", "_place_all")


def shuffled(df: DataFrame, n: int, seed: int = 42, at: str = "_at", order: str = "ord") -> DataFrame:
    """``df`` with ``_perm``, the place of each row in a seeded order, told from its 0-based place ``at``
    of ``n`` alone: no row has to be sorted or moved. Every place is taken once. Rows without such a
    column are numbered by ``order`` first."""
    df = df if at in df.columns else numbered(df, order).withColumnRenamed("_at", at)
    return df.withColumn("_perm", permuted(F.col(at), F.lit(n).cast("long"), seed))


def sample(df: DataFrame, size: int, n: int, seed: int = 42, at: str = "_at", order: str = "ord") -> DataFrame:
    """The ``size`` rows that come first in the seeded order; more than there are is an error."""
    if not 0 <= size <= n:
        raise ValueError(f"a sample of {size} from {n} rows")
    return shuffled(df, n, seed, at, order).where(F.col("_perm") < size)


def drawn(df: DataFrame, n: int, shuffle: bool = True, seed: int = 42, first: int | None = None, again: int | None = None, order: str = "ord") -> DataFrame:
    """Rows as a configuration asks for them, with ``_place``: in the order of ``order`` or shuffled by
    ``seed``; of those the ``first`` ones, or (``again``) as many after one more shuffle by 42. Both, or
    more rows than there are, is an error."""
    if first is not None and again is not None:
        raise ValueError("a sample and a second sample exclude each other")
    for size in (first, again):
        if size is not None and not 0 <= size <= n:
            raise ValueError(f"a sample of {size} from {n} rows")
    placed = numbered(df, order)
    placed = shuffled(placed, n, seed).drop("_at").withColumnRenamed("_perm", "_place") if shuffle else placed.withColumnRenamed("_at", "_place")
    if again is not None:
        placed = shuffled(placed, n, 42, "_place").drop("_place").withColumnRenamed("_perm", "_place")
    size = first if first is not None else again
    return placed if size is None else placed.where(F.col("_place") < size)
