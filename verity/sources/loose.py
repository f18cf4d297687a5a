"""Graph documents of no fixed schema, as variants: unknown fields stay, what is missing becomes rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that every node and every edge must have.
NODE_FIELDS, EDGE_FIELDS = ("id", "kind"), ("source", "target", "relationship_type")


def parsed(documents: DataFrame, text: str = "doc") -> DataFrame:
    """``documents`` with ``v``, the document as a variant; null where it is no JSON."""
    return documents.withColumn("v", F.try_parse_json(F.col(text)))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant; null of null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _inner(path: str, of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(kind_of(value) == kind, F.lit(False))


def items(documents: DataFrame, name: str, key: str = "gid") -> DataFrame:
    """(key, pos, item) of the list ``name`` of each document that has it."""
    listed = F.when(_is(_inner(f"$.{name}"), "ARRAY"), F.try_variant_get("v", f"$.{name}", "array<variant>"))
    return documents.select(key, F.posexplode(listed).alias("pos", "item"))


def loose_nodes(documents: DataFrame, key: str = "gid") -> DataFrame:
    """(key, pos, id, kind, item): nodes that are objects; ``item`` keeps all of their fields."""
    return items(documents, "nodes", key).where(_is(F.col("item"), "OBJECT")).select(key, "pos", *[F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in NODE_FIELDS], "item")


def loose_edges(documents: DataFrame, key: str = "gid") -> DataFrame:
    """(key, pos, source, target, relationship_type, item)."""
    return items(documents, "edges", key).where(_is(F.col("item"), "OBJECT")).select(key, "pos", *[F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in EDGE_FIELDS], "item")


def problems(documents: DataFrame, key: str = "gid") -> DataFrame:
    """(key, problem, detail) of what a graph document must not have: no object, no list of nodes or
    edges, an item that is no object, a missing field (that it is there counts, not what it holds),
    a repeated id, an edge to no node. All of a document are told, not only the first.

    Documents are taken apart where they are read; ids meet by (document, id)."""
    whole = F.when(~_is(F.col("v"), "OBJECT"), F.array(F.struct(F.lit("no object").alias("problem"), F.lit("").alias("detail"))))
    lists = F.filter(F.array(*[F.when(~_is(_inner(f"$.{c}"), "ARRAY"), F.struct(F.lit("no list").alias("problem"), F.lit(c).alias("detail"))) for c in ("nodes", "edges")]), lambda x: x.isNotNull())
    found = documents.select(key, F.explode(F.when(whole.isNotNull(), whole).otherwise(lists)).alias("p")).select(key, "p.*")
    for name, fields in (("nodes", NODE_FIELDS), ("edges", EDGE_FIELDS)):
        each = items(documents, name, key)
        where = F.concat(F.lit(f"{name} "), F.col("pos").cast("string"))
        odd = each.where(~_is(F.col("item"), "OBJECT")).select(key, F.lit("no object").alias("problem"), where.alias("detail"))
        lacking = F.filter(F.array(*[F.when(F.try_variant_get("item", f"$.{c}", "variant").isNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
        missing = each.where(_is(F.col("item"), "OBJECT")).select(key, where.alias("w"), F.explode(lacking).alias("c")).select(key, F.lit("missing field").alias("problem"), F.concat("w", F.lit(" "), "c").alias("detail"))
        found = found.unionByName(odd).unionByName(missing)
    nodes = loose_nodes(documents, key).where("id is not null")
    ids = nodes.groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))
    repeated = ids.where("n > 1").select(key, F.lit("repeated id").alias("problem"), F.col("id").alias("detail"))
    ends = loose_edges(documents, key).select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).alias("id")) for c in ("source", "target")])).alias("e")).select(key, "e.*").where("id is not null")
    lost = ends.join(ids.select(key, "id"), [key, "id"], "left_anti").select(key, F.concat(F.lit("unknown "), "end").alias("problem"), F.col("id").alias("detail"))
    return found.unionByName(repeated).unionByName(lost)


def unknown_fields(documents: DataFrame, key: str = "gid") -> DataFrame:
    """(list, field, n): fields of nodes and edges beyond those that must be there, and how many have them."""
    out = None
    for name, fields in (("nodes", NODE_FIELDS), ("edges", EDGE_FIELDS)):
        names = F.explode(F.map_keys(F.try_variant_get("item", "$", "map<string,variant>"))).alias("field")
        found = items(documents, name, key).where(_is(F.col("item"), "OBJECT")).select(F.lit(name).alias("list"), names).where(~F.col("field").isin(*fields)).groupBy("list", "field").agg(F.count(F.lit(1)).alias("n"))
        out = found if out is None else out.unionByName(found)
    return out
