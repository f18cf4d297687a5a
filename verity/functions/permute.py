"""A keyed permutation of the numbers below n, worked out for each number by itself.

Numbers are taken as two digits of about the root of n, which are moved by one another's keyed remainder
in turn (Feistel rounds), a bijection of slightly more than n numbers; a result of n or more is moved
again until it is below n (cycle walking). The rule is stated once, for Spark columns and for SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half rounds; remainders are by the prime 2^31 - 1.
ROUNDS, PRIME = 6, 2147483647
#: Moves beyond the first. Fewer than the root of n results are n or more, so up to n = 4096 these are
#: enough for any; beyond, each move ends the walk but for one in the root of n.
WALK = 64


def _keys(seed: int) -> list[int]:
    return [(seed * 7919 + r * 104729 + 13) % PRIME for r in range(ROUNDS)]


def _step(own: str, other: str, key: int, size: str) -> str:
    """One half round in SQL."""
    return f"(({own} + (((({other} + {key}) * 48271) % {PRIME}) * 69621 + {key}) % {PRIME}) % {size})"


def permuted(place: Column, n: Column, seed: int) -> Column:
    """Where ``place`` (0 to n - 1) goes under this seed: again 0 to n - 1, each once."""
    keys = F.array(*[F.lit(k).cast("long") for k in _keys(seed)])

    def half(s: Column, key: Column) -> Column:
        moved = F.pmod(s["p"] + F.pmod(F.pmod((s["q"] + key) * F.lit(48271), F.lit(PRIME)) * F.lit(69621) + key, F.lit(PRIME)), s["a"])
        return F.struct(s["q"].alias("p"), moved.alias("q"), s["b"].alias("a"), s["a"].alias("b"))  # the digits change sides

    def once(s: Column) -> Column:
        digits = F.struct(F.floor(s["x"] / s["b"]).cast("long").alias("p"), F.pmod(s["x"], s["b"]).alias("q"), s["a"].alias("a"), s["b"].alias("b"))
        return F.aggregate(keys, digits, half, lambda d: d["p"] * d["b"] + d["q"])

    def walk(s: Column) -> Column:
        first = F.struct(once(s).alias("x"), s["n"].alias("n"), s["a"].alias("a"), s["b"].alias("b"))
        on = lambda t, _: F.struct(F.when(t["x"] < t["n"], t["x"]).otherwise(once(t)).alias("x"), t["n"].alias("n"), t["a"].alias("a"), t["b"].alias("b"))
        lost = F.raise_error(F.lit("a walk of the permutation does not end")).cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, on, lambda t: F.when(t["x"] < t["n"], t["x"]).otherwise(lost))

    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    start = F.struct(place.cast("long").alias("x"), n.cast("long").alias("n"), root.alias("a"), F.ceil(n.cast("double") / root).cast("long").alias("b"))
    return F.get(F.transform(F.array(start), walk), F.lit(0))  # the place is worked out once, however often it is named


def permuted_sql(place: str, n: str, seed: int) -> str:
    """The same in SQL."""
    a = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"
    b = f"CAST(ceil(CAST({n} AS DOUBLE) / {a}) AS BIGINT)"

    def once(x: str) -> str:
        first, second = f"(({x}) // {b})", f"(({x}) % {b})"
        for r, key in enumerate(_keys(seed)):
            if r % 2 == 0:
                first = _step(first, second, key, a)
            else:
                second = _step(second, first, key, b)
        return f"({first} * {b} + {second})"

    return f"list_reduce(list_prepend(CAST({once(place)} AS BIGINT), list_transform(range({WALK}), lambda z: CAST(z AS BIGINT))), lambda x, z: CASE WHEN x < {n} THEN x ELSE {once('x')} END)"
