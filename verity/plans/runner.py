"""Scoring jobs: pluggable scorers, resume, dead letters, and the tables they leave."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.operators.audit import key_difference
from verity.plans.tables import cut
from verity.sources.runs import numbered

KEY = ("instance_id", "model")
Scorer = Callable[[dict], dict]
OUTPUT = "confidence double, total_tokens long, generated_tokens long, cost double"


def stub_scorer(row: dict) -> dict:
    """The offline scorer: a confidence from the key's characters, nothing counted."""
    total = sum(map(ord, f"{row['instance_id']}/{row['model']}"))
    return {"confidence": total % 101 / 100, "total_tokens": -1, "generated_tokens": -1, "cost": -1.0}


def pending(dataset: DataFrame, saved: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows without a saved output."""
    return dataset.join(saved.select(*key), list(key), "left_anti")


def score(rows: DataFrame, make: Callable[[], Scorer], key: Sequence[str] = KEY, attempts: int = 3) -> DataFrame:
    """(key, value, error, trace): one row each. A scorer is made once per task; ValueErrors are tried
    again, other errors of an item are recorded with it, and neither stops its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                value, error, trace = None, None, None
                for attempt in range(attempts):
                    try:
                        value, error, trace = scorer(row), None, None
                        break
                    except Exception as e:
                        error, trace = f"{type(e).__name__}: {e}", traceback.format_exc()
                        if not isinstance(e, ValueError) or attempt + 1 == attempts:
                            break
                out.append({**{k: row[k] for k in key}, **(value or dict.fromkeys(("confidence", "total_tokens", "generated_tokens", "cost"))), "error": error, "trace": trace})
            frame = pd.DataFrame(out, columns=[*key, "confidence", "total_tokens", "generated_tokens", "cost", "error", "trace"])
            yield frame.astype({"total_tokens": "Int64", "generated_tokens": "Int64"})

    keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.mapInPandas(run, f"{keys}, {OUTPUT}, error string, trace string")


def run_estimates(dataset: DataFrame, saved: DataFrame | None, make: Callable[[], Scorer], key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(results, failures): saved outputs are used again, the others are scored; results come in the
    order of ``ord`` and carry every column of the dataset."""
    rows = dataset if saved is None else pending(dataset, saved, key)
    scored = cut(score(rows, make, key), "runner-scored")
    fresh = scored.where("error is null").drop("error", "trace")
    outputs = fresh if saved is None else saved.select(*fresh.columns).unionByName(fresh)
    results = dataset.join(outputs.withColumnRenamed("confidence", "estimated_confidence"), list(key)).orderBy("ord")
    failed = scored.where("error is not null").select(*key, "error", "trace")
    return results, failed


def with_artifacts(dataset: DataFrame, outputs: DataFrame, graph_roots: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Dataset rows with a confidence: from the saved output, and only for keys without any from the
    root of the saved graph (-1 there is an error and left out), without usage."""
    own = dataset.join(outputs, list(key))
    bare = graph_roots.join(outputs.select(*key), list(key), "left_anti").where("confidence >= 0")
    return own.unionByName(dataset.join(bare, list(key)), allowMissingColumns=True)


def resume_rule(dataset: DataFrame, outputs: DataFrame, graph_roots: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, action): ``recompute`` where the graph's root is unset, even with an output; ``from_graph``
    where only a set graph is there; ``saved`` with an output; else ``compute``."""
    o = outputs.select(*key, F.lit(True).alias("_o"))
    g = graph_roots.select(*key, F.col("confidence").alias("_g"))
    both = dataset.select(*key).join(o, list(key), "left").join(g, list(key), "left")
    action = F.when(F.col("_g") == -1, "recompute").when(F.col("_o"), "saved").when(F.col("_g").isNotNull(), "from_graph").otherwise("compute")
    return both.select(*key, action.alias("action"))


def replay(dataset: DataFrame, other: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Same-key outputs of another run; a key that it lacks is an error."""
    lost = key_difference(dataset, other, key).limit(20).collect()
    if lost:
        raise ValueError(f"the other run lacks {lost}")
    return dataset.select(*key).join(other, list(key))


Phase = tuple[str, Callable[[DataFrame], DataFrame]]


def cohorts(rows: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """``rows`` with ``cohort``, from 0: each ``size`` rows in ``order``."""
    if size < 1:
        raise ValueError("a cohort has one row or more")
    return numbered(rows, order).withColumn("cohort", F.floor(F.col("_at") / size).cast("long")).drop("_at")


LEDGER = "cohort long, phase string, rows long"


def finished_phases(spark: SparkSession, path: str) -> DataFrame:
    """(cohort, phase, rows) of what ``run_cohorts`` has finished under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger") if there else spark.createDataFrame([], LEDGER)


def run_cohorts(rows: DataFrame, phases: Sequence[Phase], size: int, path: str, order: str = "ord") -> DataFrame:
    """Runs each phase over a whole cohort before the next phase, and each cohort before the next one;
    returns the rows of the last phase.

    A phase takes the rows that the phase before has left and returns its own. Its rows are written,
    then a line of the ledger says so; a run that was broken off goes on with the first phase that the
    ledger lacks, whose half-written rows are written anew. ``size`` bounds what is open at a time, so
    there are as many barriers as cohorts times phases.
    """
    spark = rows.sparkSession
    placed = cut(cohorts(rows, size, order), "cohorts") if phases else None
    done = {(r["cohort"], r["phase"]) for r in finished_phases(spark, path).collect()}  # a line a cohort and phase
    n = (placed.agg(F.max("cohort")).first()[0] if phases else None) or 0
    last = None
    for cohort in range(n + 1):
        at = placed.where(F.col("cohort") == cohort)
        for name, phase in phases:
            own = f"{path}/{name}/cohort={cohort}"
            if (cohort, name) not in done:
                left = phase(at)
                left.drop("cohort").write.mode("overwrite").parquet(own)
                told = spark.read.parquet(own).count()
                spark.createDataFrame([(cohort, name, told)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
            at = spark.read.parquet(own).withColumn("cohort", F.lit(cohort).cast("long"))
        last = phases[-1][0]
    return spark.read.option("basePath", f"{path}/{last}").parquet(f"{path}/{last}")
