"""Line dedup as an exact set-similarity join with prefix, positional and length filters.

DataFrame functions only. Tokens of a line are its distinct lower-cased words; two lines match when
the Jaccard similarity of their token sets is ``percent`` or more. Whole numbers decide every bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.common import Scratch, cut

#: Words are counted over the whole corpus in so many bins, as many as Spark's map of a generated
#: aggregation holds: counting then adds a tenth to the time of splitting the words, 2^20 bins more than
#: half. The logarithm of its bin's count is a word's level. Any fixed order gives the same result, a
#: better one gives fewer candidates (simulated on check_s: lines meet 57 million times, with 2^20 bins
#: 29 million; each meeting is a few comparisons of numbers).
RARITY_BITS, LEVELS_AN_OCTAVE = 16, 4
#: Bins that are gathered in one row before all are.
BINS_A_ROW = 1024
#: A token is the hash of its word with its level in place of the upper 8 bits; of level 0, it is in no other line.
HASH_BITS = 56
SHARED = 1 << HASH_BITS
#: Sizes of sets from which a second bitmap tells apart what falls together in the first one: of two sets
#: of 40 tokens that differ in 12, 22 in a hundred look similar by 64 bits, and 7 by 128 (simulated).
WIDE = 24
#: Lines before a line that are looked at first, of each of the three tokens by which it finds them.
BACK = 5
#: Lines that agree in the first and the last of these tokens, from which on all lines with one of them are tried first.
#: Smaller groups are left to the join: so many lines are at most half as many pairs a line.
LARGE_GROUP = 32
#: Logarithm of the partitions of the input whose lines are tried together, and of those whose first
#: lines of a group are.
PARTS, FIRST_PARTS = 4, 10
#: Rows (of at most five whole numbers, so 64 MB) up to which a side is broadcast after it was counted;
#: beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def _side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, broadcast if it is small."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _plain(text: Column, blanks: str = "\t\x0b\f\r") -> Column:
    """The text in lower case, its blanks as spaces; lines stay lines."""
    plain = text
    for blank in blanks:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.when(text.rlike(f"[{blanks}]"), F.lower(plain)).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    """The lower-cased words, with empty ones where blanks meet."""
    return F.split(_plain(text), " ")


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - RARITY_BITS)


def _levels(sets: DataFrame, scratch: Scratch) -> Column:
    """What turns a hash of each bin into a token, by exclusive or, as one array, a scalar; its size does
    not depend on the data."""
    counted = sets.select(F.explode("hashes").alias("h")).groupBy(_bin(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    none = sets.sparkSession.range(1 << RARITY_BITS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("n"))
    bins = counted.unionByName(none).groupBy("b").agg(F.sum("n").alias("n"))
    level = F.when(F.col("n") > 1, F.least(F.floor(LEVELS_AN_OCTAVE * F.log2("n")), F.lit(127))).otherwise(0).cast("long")
    own = F.shiftleft(level.bitwiseXOR(F.shiftright("b", RARITY_BITS + HASH_BITS - 64)), HASH_BITS)
    parts = bins.groupBy(F.floor(F.col("b") / BINS_A_ROW).alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", own.alias("own")))), lambda x: x["own"]).alias("own"))
    told = parts.groupBy().agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row", "own"))), lambda x: x["own"])).alias("levels"))
    return scratch.cut(told, "lines-levels").scalar()


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: any number of its own (``lid``), place, the hashes of its different words in order,
    their number, how many are below zero, and two hashes of them all."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), _plain(text).alias("_text"))
    lines = rows.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("_line", "_text"))
    each = F.array_distinct(F.transform(F.split("_text", " "), lambda w: F.xxhash64(w)))
    hashes = F.sort_array(F.array_remove(each, F.xxhash64(F.lit(""))))
    told = lines.select("_id", "_th", "_line", hashes.alias("hashes"))
    zero = F.lit(0).cast("long")
    below = F.array_position(F.sort_array(F.concat("hashes", F.array(zero))), zero).cast("int") - 1
    return told.select(F.monotonically_increasing_id().alias("lid"), "_id", "_th", "_line", F.size("hashes").alias("n"), below.alias("below"), F.xxhash64("hashes").alias("h1"), F.xxhash64(F.lit(1), "hashes").alias("h2"), "hashes")


def _prefixes(sets: DataFrame, percent: int, levels: Column) -> DataFrame:
    """The sets with the part of their prefix that is in other lines, rarest tokens first: 31 bits of
    each, how many tokens come before, and the three by which lines are tried first. 64 bits of ``bits``
    each tell if an odd number of words fell on it; ``half`` has those of one half of all words, for large
    sets. Two sets differ in as many words as their bits differ, or more.

    Spark interprets what a function with a lambda takes in, so these take columns of the select before;
    it keeps the selects apart where one of the columns is used twice."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(bit(k)))
    cols = ["lid", "_id", "_th", "_line", "n"]
    # no token is null, and Spark sorts such arrays as plain numbers if it knows that
    token = lambda h: F.coalesce(F.get("levels", _bin(h)).bitwiseXOR(h), F.lit(0).cast("long"))
    levelled = sets.withColumn("levels", levels).select(*cols, "below", "hashes", F.transform("hashes", token).alias("tokens"))
    size = F.size("tokens")
    prefix = F.slice(F.sort_array("tokens"), F.lit(1), size - F.floor((size * percent + 99) / 100).cast("int") + 1)
    halves = levelled.select(*cols, F.slice("hashes", F.lit(1), F.col("below")).alias("low"), F.slice("hashes", F.col("below") + 1, F.col("n") - F.col("below")).alias("high"), prefix.alias("prefix"))
    # tokens of other lines only are the rule
    common = F.when(F.get("prefix", F.lit(0)) >= SHARED, F.col("prefix")).otherwise(F.filter("prefix", lambda k: k >= SHARED))
    shared = halves.select(*cols, parity("low").alias("low"), parity("high").alias("high"), F.size("prefix").alias("width"), common.alias("shared"))
    own = F.transform("shared", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    told = shared.select(*cols, F.col("low").bitwiseXOR(F.col("high")).alias("bits"), F.when(F.col("n") >= WIDE, F.col("low")).alias("half"), (F.col("width") - F.size("shared")).alias("alone"), own.alias("prefix"))
    ends = told.select("*", F.sort_array("prefix").alias("sorted"))
    least = F.get("sorted", F.lit(0))
    return ends.select(*told.columns, least.alias("least"), (-F.get("sorted", F.size("sorted") - 1)).alias("greatest"), F.coalesce(F.get("sorted", F.lit(1)), least).alias("second"))


def _enough(common: Column, ns: Column, nt: Column, percent: int) -> Column:
    """So many common tokens make sets of these sizes similar."""
    return common * (100 + percent) >= (ns + nt) * percent


def _apart(s: str, t: str) -> Column:
    """Bits in which the bitmaps of two sets differ."""
    bits, half = F.col(f"{s}bits").bitwiseXOR(F.col(f"{t}bits")), F.col(f"{s}half").bitwiseXOR(F.col(f"{t}half"))
    return F.coalesce(F.bit_count(half) + F.bit_count(bits.bitwiseXOR(half)), F.bit_count(bits))


def _near(s: str, t: str, percent: int) -> Column:
    """Sizes and bitmaps allow that the sets are similar."""
    ns, nt = F.col(f"{s}n"), F.col(f"{t}n")
    return (ns * 100 >= nt * percent) & (nt * 100 >= ns * percent) & _enough(F.shiftright(ns + nt - _apart(s, t), 1), ns, nt, percent)


def _matched(pairs: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> DataFrame:
    """(late, early): those of the pairs (a, b) whose sets of words are similar, told from the texts."""
    wanted = scratch.cut(pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid"))).distinct(), "lines-wanted")
    places = scratch.cut(sets.select("lid", "_id", "_th", "_line").join(_side(wanted), "lid"), "lines-places")
    by_doc = scratch.cut(places.groupBy(F.col("_id").alias("i"), F.col("_th").alias("t")).agg(F.collect_list(F.struct("lid", "_line")).alias("at")), "lines-by-place")
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text")).where("_text is not null")
    found = own.join(_side(by_doc, places.count()), own["_id"].eqNullSafe(F.col("i")) & (own["_th"] == F.col("t")))
    lines = found.select("_id", "_th", "at", F.split("_text", "\n").alias("lines"))
    placed = lines.select("_id", "_th", F.explode(F.transform("at", lambda p: F.struct(p["lid"].alias("lid"), p["_line"].alias("line"), F.get("lines", p["_line"]).alias("text")))).alias("p"))
    texts = scratch.cut(placed.select("p.lid", F.struct("_id", "_th", "p.line", "p.lid").alias("o"), F.array_distinct(F.array_remove(_words(F.col("p.text")), "")).alias("w")), "lines-texts")
    of = lambda k: texts.select(F.col("lid").alias(k), F.col("o").alias(f"o{k}"), F.col("w").alias(f"w{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    # shared / (sizes - shared) >= percent / 100
    similar = both.where(F.col("shared") * (100 + percent) >= (F.size("wa") + F.size("wb")) * percent)
    later = F.col("oa") > F.col("ob")
    return scratch.cut(similar.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("late"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("early")), "lines-matched")


def _tried(unique: DataFrame, percent: int, part: Column, scratch: Scratch) -> DataFrame:
    """(a, b): for each line of a large group, of the lines just before it among those that agree with it in one of the two
    least hashes of the prefix or in the greatest, the one with the nearest bitmap, if it may be similar. Lines are taken by
    their ``part``, so none is too many for a task. A group is large where many lines agree in the least and the greatest."""
    kept = ["lid", "n", "bits", "half"]
    many = unique.groupBy("least", "greatest").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LARGE_GROUP)
    keys = scratch.cut(many.select(F.explode(F.array("least", "greatest")).alias("key")).distinct(), "lines-large-groups")
    heads = unique.select(*kept, "_id", "_line", part.alias("part"), F.explode(F.array("least", "greatest", "second")).alias("key")).join(_side(keys), "key", "left_semi")
    order = Window.partitionBy("key", "part").orderBy("_id", "_line", "lid")
    before = [F.lag(F.struct(*kept), k).over(order) for k in range(1, BACK + 1)] + [F.first(F.struct(*kept)).over(order)]
    seen = heads.select(F.struct(*kept).alias("s"), F.array(*before).alias("before"))
    pairs = seen.select("s", F.explode("before").alias("t")).where("t.lid <> s.lid")
    likely = pairs.where(_near("s.", "t.", percent)).groupBy(F.col("s.lid").alias("a")).agg(F.min(F.struct(_apart("s.", "t.").alias("apart"), F.col("t.lid").alias("b"))).alias("m"))
    return likely.select("a", "m.b")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(_id, _th, _line) of the lines that match an earlier line, and (_id, _th, _rows) of rows that repeat.

    Lines of one token set are merged first: the later ones go. The others share a bucket with every
    line that has a token of their prefix. Each line of a large group is first compared with one line of its part
    of the corpus that is likely to be similar; the later one of a similar pair is done. So are then the first
    lines of each part's groups with one another, so a group of many variants of a line costs a few pairs
    per variant. Then all pairs of a bucket that pass the length, positional and bitmap filters are
    compared, but for those of two lines that are done, so nothing is left out. Sets too small to match a
    different set are in no bucket.
    """
    with Scratch(docs.sparkSession, numbers=True) as early:  # the hashes of all words go before the lines meet
        # conditions hold on what was written: before, Spark would work out the hashes once more for them
        lines = early.cut(_sets(docs, id_col, text_col), "lines-sets")
        rows = lines.where("_line = 0").groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("_rows"))
        repeated = scratch.cut(rows.where("_rows > 1"), "lines-repeated-rows")
        sets = lines.where("n > 0")
        many = scratch.cut(sets.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"), "lines-many")
        own = scratch.cut(sets.select("h1", "h2", F.struct("_id", "_th", "_line", "lid").alias("at")).join(_side(many), ["h1", "h2"]), "lines-equal-places")
        firsts = own.groupBy("h1", "h2").agg(F.min("at").alias("first")).select(F.col("first.lid").alias("lid"))
        equal = scratch.cut(own.select("at.*").join(_side(scratch.cut(firsts, "lines-firsts")), "lid", "left_anti"), "lines-equal")
        able = sets.where(F.col("n") * 100 >= (F.col("n") + 1) * percent).join(_side(equal.select("lid")), "lid", "left_anti")
        unique = scratch.cut(_prefixes(able, percent, _levels(sets, scratch)), "lines-unique").where("least is not null")
    matched = lambda pairs: _matched(pairs, unique, docs, id_col, text_col, percent, scratch)
    told = matched(scratch.cut(_tried(unique, percent, F.shiftright("lid", 33 + PARTS), scratch), "lines-tried"))
    done = scratch.cut(told.select(F.col("late").alias("lid")).distinct(), "lines-done")
    heads = told.select(F.col("early").alias("lid")).distinct().join(_side(done), "lid", "left_anti")
    among = unique.join(_side(scratch.cut(heads, "lines-heads")), "lid", "left_semi")
    more = matched(scratch.cut(_tried(among, percent, F.shiftright("lid", 33 + FIRST_PARTS), scratch), "lines-tried"))
    done = scratch.cut(done.unionByName(more.select(F.col("late").alias("lid"))).distinct(), "lines-done")

    flagged = unique.join(_side(done.withColumn("_done", F.lit(1))), "lid", "left")
    sizes = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("alone").cast("long"))
    # where ids are whole numbers they tell the later line of two documents, which alone counts
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    place = F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63))) if whole else F.lit(0).cast("long")
    entry = lambda prefix: flagged.select("lid", place.alias("at"), F.coalesce("_done", F.lit(0)).alias("done"), sizes.alias("sizes"), "bits", "half", F.posexplode(prefix).alias("pos", "key"))
    # size, place and if it is done in one number
    code = F.col("sizes") * 2 + F.col("pos") * 2 + F.col("done")
    entries = lambda prefix: entry(prefix).select("key", "lid", "at", code.alias("code"), "bits", "half").where("lid is not null and code is not null and bits is not null and key is not null")
    parts = lambda k: {f"{k}n": F.shiftright(f"{k}.code", 33).cast("int"), f"{k}pos": F.shiftright(F.col(f"{k}.code").bitwiseAND(F.lit((1 << 33) - 1)), 1).cast("int"), f"{k}done": F.col(f"{k}.code").bitwiseAND(F.lit(1))}
    s, t = parts("s"), parts("t")
    ns, nt = s["sn"], t["tn"]
    fits = (ns * 100 >= nt * percent) & (nt * 100 >= ns * percent) & _enough(F.least(ns - s["spos"], nt - t["tpos"]), ns, nt, percent) & _enough(F.shiftright(ns + nt - _apart("s.", "t."), 1), ns, nt, percent)
    asked = F.when(F.col("s.at") > F.col("t.at"), s["sdone"] == 0).when(F.col("s.at") < F.col("t.at"), t["tdone"] == 0).otherwise(s["sdone"] + t["tdone"] < 2)
    # Two sets share at least 2 p / (100 + p) of the smaller one's words and p / 100 of the larger one's. So the first
    # word of both is among the first n - 2 n p / (100 + p) + 1 of the smaller set, half as many as a whole prefix has.
    least = F.floor((2 * F.col("n") * percent + 99 + percent) / (100 + percent)).cast("int")
    head = F.slice("prefix", F.lit(1), F.greatest(F.col("n") - least + 1 - F.col("alone"), F.lit(0)))
    ordered = (ns > nt) | ((ns == nt) & (F.col("s.lid") > F.col("t.lid")))
    joined = entries("prefix").alias("s").join(entries(head).alias("t"), (F.col("s.key") == F.col("t.key")) & ordered & fits & asked)
    pairs = scratch.cut(joined.select(F.col("s.lid").alias("a"), F.col("t.lid").alias("b")).distinct(), "lines-candidates")
    found = matched(pairs).select(F.col("late").alias("lid"))
    late = scratch.cut(done.unionByName(found).distinct(), "lines-gone")
    places = ["_id", "_th", "_line"]
    return unique.select("lid", *places).join(_side(late), "lid", "left_semi").select(*places).unionByName(equal.select(*places)), repeated


def _gone_by_document(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(_id, _th, _gone): of each document that loses lines, their numbers in order."""
    with Scratch(docs.sparkSession, numbers=True) as scratch:
        gone, many = repeated_lines(docs.select(id_col, text_col), id_col, text_col, percent, scratch)
        # rows that repeat: their second copy is all repeated lines, but they take the answer of the first
        if not many.count():  # the rule: then no line comes twice
            return cut(gone.groupBy("_id", "_th").agg(F.sort_array(F.collect_list("_line")).alias("_gone")), "lines-by-document")
        per_line = gone.groupBy("_id", "_th", "_line").agg(F.count(F.lit(1)).alias("_n"))
        told = per_line.join(_side(many), per_line["_id"].eqNullSafe(many["_id"]) & (per_line["_th"] == many["_th"]), "left")
        told = told.where(F.col("_n") >= F.coalesce("_rows", F.lit(1))).select(per_line["_id"].alias("_id"), per_line["_th"].alias("_th"), "_line")
        return cut(told.groupBy("_id", "_th").agg(F.sort_array(F.collect_list("_line")).alias("_gone")), "lines-by-document")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with lines removed that match an earlier line of the corpus; other columns as they came.

    A line is removed when any line before it (smaller id, then smaller line number) has a word set
    whose Jaccard similarity is ``percent`` or more; equal lines are such lines. Added columns:
    ``n_lines``, ``n_removed``.

    * Blank lines are never removed; null text stays null (no lines), empty text stays empty.
    * A null id comes before all others. Rows that repeat both id and text share one answer; rows of
      one id with other texts come in the order of a hash of the text.
    * Columns of the added names are replaced; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    source = docs.select(*[f"`{c}`" for c in names]).withColumn("__th", F.xxhash64(text_col))
    by_doc = _gone_by_document(docs, id_col, text_col, percent)
    lines_gone = by_doc.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0]
    side = _side(by_doc, lines_gone)
    joined = source.join(side, source[id_col].eqNullSafe(by_doc["_id"]) & (source["__th"] == by_doc["_th"]), "left")
    lines, gone_at = F.split(F.col(text_col), "\n"), F.col("_gone")
    since = F.concat(F.array(F.lit(-1)), F.slice(gone_at, F.lit(1), F.size(gone_at) - 1))
    runs = F.zip_with(gone_at, since, lambda g, p: F.concat(F.array_repeat(F.lit(True), g - p - 1), F.array(F.lit(False))))
    stays = F.concat(F.flatten(runs), F.array_repeat(F.lit(True), F.size("__all") - F.element_at(gone_at, -1) - 1))
    kept = F.array_join(F.zip_with(F.col("__all"), stays, lambda line, stay: F.when(stay, line)), "\n")
    text = F.when(gone_at.isNull(), F.col(text_col)).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    n_lines = F.coalesce(F.size("__all"), F.lit(0))
    some = F.col(text_col).isNotNull()
    return joined.withColumn("__all", lines).select(*columns, F.when(some, n_lines).otherwise(0).alias("n_lines"), F.when(some & gone_at.isNotNull(), F.size(gone_at)).otherwise(0).alias("n_removed"))
