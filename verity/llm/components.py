"""Connected components of an edge table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.common import Scratch, cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): ``root`` is the smallest node that can be reached. Nodes without an edge are absent.

    Each round gives every node, and the root it had, the smallest root among its neighbours, and
    then jumps to the root's root. All tables are written and read again, so every join has a table
    with unique keys on one side and Spark can split the other side where one node has many rows; a
    round's tables are deleted when the next one has written its own. The result is a table of
    ``scratch``, where one is given. Null nodes and loops are ignored.
    """
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    with Scratch(edges.sparkSession) as own:
        both = own.cut(plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
        last = Scratch(edges.sparkSession)
        labels = last.cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "cc-labels")
        for _ in range(max_rounds):
            with last:
                theirs = labels.select(F.col("node").alias("v"), "root")
                near = last.cut(both.join(theirs, "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low")), "cc-near")
                moved = last.cut(labels.join(near, "node").where("low < root"), "cc-moved")
                if moved.isEmpty():
                    return (scratch.cut if scratch else cut)(labels, "cc-roots")
                told = moved.select("node", F.col("low").alias("root")).unionByName(moved.select(F.col("root").alias("node"), F.col("low").alias("root")))
                lower = last.cut(labels.unionByName(told).groupBy("node").agg(F.min("root").alias("root")), "cc-lower")
                up = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
                new = Scratch(edges.sparkSession)
                labels = new.cut(lower.join(up, "root").select("node", F.col("above").alias("root")), "cc-labels")
            last = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
