"""Writers of results, metrics, graphs and failures; ``store`` keeps the outputs of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def results_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def metrics_json(df: DataFrame, path: str) -> None:
    """One object per run."""
    df.write.mode("overwrite").json(path)


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One document per graph, nodes and edges in their order."""
    pack = lambda df: F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*[c for c in df.columns if c not in ("gid", "pos")]).alias("x")))), lambda s: s["x"])
    docs = nodes.groupBy("gid").agg(pack(nodes).alias("nodes")).join(edges.groupBy("gid").agg(pack(edges).alias("edges")), "gid", "left")
    docs.write.mode("overwrite").json(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """Structs spread, at any depth, to columns named by their path; arrays and maps as JSON."""

    def spread(value: Column, kind: DataType, name: str) -> list[Column]:
        if isinstance(kind, StructType):
            return [c for f in kind.fields for c in spread(value[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)]
        return [(F.to_json(value) if isinstance(kind, (ArrayType, MapType)) else value).alias(name)]

    columns = [c for f in df.schema.fields for c in spread(F.col(f"`{f.name}`"), f.dataType, f.name)]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def failures(df: DataFrame, path: str) -> None:
    """The dead letters of a run, added to those before."""
    df.write.mode("append").json(path)
