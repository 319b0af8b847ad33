"""Spans of regular expressions with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold over an array takes in one piece.
WIDTH = 64
EMPTY = "array<struct<s:int,e:int,v:string,before:string,after:string>>"


def gaps(text: Column, pattern: str) -> Column:
    """The parts between the leftmost non-overlapping matches, one more than
    these; null where there is no match, so that one scan is enough there."""
    return F.when(text.rlike(pattern), F.split(text, pattern, -1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column, levels: int = 3) -> Column:
    """For each element the sum of those before it.

    A fold that appends to an array copies it each time, so it only runs over
    pieces of WIDTH elements; the pieces' totals are summed likewise. The work
    is linear up to WIDTH ** levels elements, and beyond that the square only
    of their number divided by WIDTH ** (levels - 1)."""

    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(part, start, lambda acc, n: F.struct((acc["p"] + n).alias("p"), F.concat(acc["a"], F.array(acc["p"])).alias("a")))

    if levels == 1:
        return fold(lengths)["a"]

    def pieces(every: Column) -> Column:
        n = F.ceil(F.size(every) / WIDTH).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: fold(F.slice(every, i * WIDTH + 1, F.lit(WIDTH))))
        joined = let(cut, lambda c: F.flatten(F.zip_with(c, sums_before(F.transform(c, lambda x: x["p"]), levels - 1), lambda x, t: F.transform(x["a"], lambda v: v + t))))
        return F.when(n > 1, joined).otherwise(fold(every)["a"])

    return let(lengths, pieces)


def spans(text: Column, pattern: str, parts: Column, context: int = 0) -> Column:
    """Array of structs: start, end (exclusive, in code points), value, and
    ``context`` characters on either side up to the neighbouring match.

    ``parts`` must be a column that holds :func:`gaps`. Positions are running
    sums of the lengths of gaps and matches; matches must not be empty.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(values: Column) -> Column:
        lengths = F.zip_with(values, F.slice(parts, 1, F.size(values)), lambda m, g: F.length(g) + F.length(m))
        return F.zip_with(values, F.zip_with(sums_before(lengths), F.slice(parts, 1, F.size(values)), lambda at, g: at + F.length(g)), lambda m, at: F.struct(m.alias("v"), at.alias("s")))

    def full(x: Column, i: Column) -> Column:
        before = F.right(F.get(parts, i), F.lit(context)) if context else F.lit("")
        after = F.left(F.get(parts, i + 1), F.lit(context)) if context else F.lit("")
        return F.struct(x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e"), x["v"].alias("v"), before.alias("before"), after.alias("after"))

    return F.coalesce(F.transform(let(found, place), full), F.array().cast(EMPTY))


def named(found: Column, kind: str, order: int, keep=None) -> Column:
    """``k`` (order of the kind), ``s``, ``e``, ``t`` ("kind:start:end") of
    those spans that ``keep`` lets through."""
    kept = F.filter(found, keep) if keep else found
    return F.transform(kept, lambda x: F.struct(F.lit(order).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")).alias("t")))


def joined(found: Column, by_start: bool) -> Column:
    """Comma-joined spans, by start then kind, or by kind then start."""
    if by_start:
        found = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["t"].alias("t")))
    return F.array_join(F.transform(F.array_sort(found), lambda x: x["t"]), ",")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")
