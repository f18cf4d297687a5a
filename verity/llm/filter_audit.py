"""What a chain of filters removes in every order, from the edges of the lattice of their subsets.

A document tells which filters it fails. It takes part in every edge (filters already applied, next
filter) of the lattice: 80 of five filters. Edges are added up over the corpus, and the steps of the
orders, 600 of five filters, are looked up among them: each order is a path through the lattice.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\f\r]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Orders grow with the factorial of the filters: seven have 35,280 steps a part.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text; E, the repeated text, is told by ``filter_audit``."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _bits(fails: dict[str, Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))


def lattice_edges(groups: DataFrame, n: int) -> DataFrame:
    """(part, applied, next, MEASURES but kept, and kept) of groups (part, mask, docs, good, toxic): every
    group takes part in each edge, and what it adds depends on its mask."""
    edges = [F.struct(F.lit(s).alias("applied"), F.lit(i).alias("next")) for s in range(1 << n) for i in range(n) if not s >> i & 1]
    each = groups.select("part", "mask", "docs", "good", "toxic", F.explode(F.array(*edges)).alias("e"))
    mask, own = F.col("mask"), F.call_function("shiftleft", F.lit(1), F.col("e.next"))
    fails, before = mask.bitwiseAND(own) > 0, mask.bitwiseAND(F.col("e.applied")) > 0
    count = lambda when, what="docs": F.sum(F.when(when, F.col(what)).otherwise(0))
    return each.groupBy("part", F.col("e.applied").alias("applied"), F.col("e.next").alias("next")).agg(
        count(~fails & ~before).alias("kept"), count(fails & ~before).alias("removed"), count(fails & before).alias("redundant"),
        count(mask == own).alias("unique_fails"), count(fails & ~before, "good").alias("good_lost"), count(fails & ~before, "toxic").alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeated: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, MEASURES and shapley.

    ``filters`` (name: failure condition over the columns of ``docs``) default to ``text_filters`` of the
    text, null being empty; ``repeated`` names the filter that a text fails which any smaller id has too.
    ``good_lost`` and ``toxic_lost`` count the removed documents with label quality or toxic 1; ``shapley``
    is what its filter removes, added up over all orders.

    * A null part is the empty string, and so is one part with the empty one. An empty table gives no row.
    * A null id has no label, no text is repeated because of it, and it never fails ``repeated``; rows of
      one id and text are no repetitions of one another. A null condition does not fail.
    * Of an id with several labels, 1 counts. Rows that repeat count each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = filters if filters is not None else text_filters(text)
    names = [*fails, *([repeated] if repeated else [])]
    n = len(names)
    if not 0 < n <= MOST_FILTERS or len(set(names)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different names")
    known = labels.groupBy(F.col(id_col).alias("_lid")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_bad")).where("_lid is not null")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), _bits(fails).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.join(known, rows["_id"] == known["_lid"], "left")
    rows = rows.select("_id", "part", "mask", "digest", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_bad", F.lit(0)).alias("toxic"))
    if repeated:
        # equal texts of one part and label meet first; the smallest id of a text is in few of those groups
        some = rows.groupBy("digest", "part", "mask", "good", "toxic", "_id").agg(F.count(F.lit(1)).alias("n"))
        some = some.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("docs"), F.min("_id").alias("least"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min_by("n", "_id").alias("at_least"))
        first = some.groupBy("digest").agg(F.min("least").alias("first")).withColumnRenamed("digest", "_digest")
        both = some.join(first, some["digest"] == first["_digest"])
        stays = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
        kinds = F.explode(F.array(F.struct(F.lit(0).alias("bit"), stays.cast("long").alias("docs")), F.struct(F.lit(1 << (n - 1)).alias("bit"), (F.col("docs") - stays).cast("long").alias("docs"))))
        counted = both.select("part", "mask", "good", "toxic", kinds.alias("k")).where("k.docs > 0").select("part", F.col("mask").bitwiseOR(F.col("k.bit")).alias("mask"), "good", "toxic", F.col("k.docs").alias("docs"))
    else:
        counted = rows.select("part", "mask", "good", "toxic", F.lit(1).cast("long").alias("docs"))
    groups = counted.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic"))
    edges = lattice_edges(groups, n)
    size = F.bit_count(F.col("applied"))
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    shapley = edges.groupBy(F.col("part").alias("_part"), F.col("next").alias("_next")).agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = [("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    paths = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, _applied int, _at int"))
    walked = edges.join(paths, (edges["applied"] == paths["_applied"]) & (edges["next"] == paths["_at"]))
    told = walked.join(shapley, (walked["part"] == shapley["_part"]) & (walked["next"] == shapley["_next"]))
    return told.select("part", "filter_order", "step", *MEASURES, "shapley")
