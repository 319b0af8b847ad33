"""Ranks within groups that may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.shared import kept, store

#: Leading hex digits of a hash that deal a group into ranges.
DIGITS = 3


def ranked(df: DataFrame, digits: Column, ties: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_rank`` from 1 by (digits, ties) and ``_size``, per group.

    ``digits`` are hex digits of a hash. Rows are ordered within ranges of
    their leading digits and the ranges are counted, so that a task orders a
    4096th of a group, and one task never all of it.

    Counts and rows both read ``df``, so it is stored unless it only scans files.
    """
    keyed = kept(df, "ranked").withColumn("_digits", digits).withColumn("_range", F.substring("_digits", 1, DIGITS))
    counts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"_by_{i}" for i, c in enumerate((*by, "_range"))}
    counts = counts.select(*(F.col(c).alias(n) for c, n in names.items()), before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_digits", *ties))
    fits = None
    for c, n in names.items():
        fits = F.col(c).eqNullSafe(F.col(n)) if fits is None else fits & F.col(c).eqNullSafe(F.col(n))
    joined = keyed.withColumn("_within", within).join(counts, fits)
    return joined.withColumn("_rank", F.col("_before") + F.col("_within")).drop(*names.values(), "_digits", "_range", "_before", "_within")


def lowest_marked(df: DataFrame, keep: Callable[[Column], Column], digits: Column, ties: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_low``: whether a row is among the ``keep(size)`` lowest of
    its group by (digits, ties).

    A radix selection: ranges of the leading digits are counted, and all but one
    of a group's lie on one side of its bound as a whole. Only the rows of that
    one range are ordered; the others are neither shuffled nor sorted, as the
    bounds, a row for each group, come to them.
    """
    names = {c: f"_by_{i}" for i, c in enumerate(by)}
    keyed = kept(df, "ranked").withColumn("_digits", digits).withColumn("_range", F.substring("_digits", 1, DIGITS))
    counts = keyed.groupBy(*(F.col(c).alias(n) for c, n in names.items()), "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*names.values())
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("*", before.alias("_before"), keep(F.sum("_n").over(group)).alias("_keep"))
    whole = F.col("_before") + F.col("_n") <= F.col("_keep")
    cut = ~whole & (F.col("_before") < F.col("_keep"))
    bounds = counts.groupBy(*names.values()).agg(F.max(F.when(whole, F.col("_range"))).alias("_last"), F.max(F.when(cut, F.col("_range"))).alias("_edge"), F.max(F.when(cut, F.col("_keep") - F.col("_before"))).alias("_need"))
    if by:
        bounds = store(bounds, "bounds")
        joined = keyed.join(bounds, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items())))
        last, edge, need = F.col("_last"), F.col("_edge"), F.col("_need")
    else:
        found = bounds.first()
        joined, (last, edge, need) = keyed, (F.lit(found[c]) for c in ("_last", "_edge", "_need"))
        last, edge = last.cast("string"), edge.cast("string")
    at_edge = F.coalesce(F.col("_range") == edge, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_digits", *ties))
    sure = joined.where(~at_edge).withColumn("_low", F.coalesce(F.col("_range") <= last, F.lit(False)))
    told = joined.where(at_edge).withColumn("_low", rank <= need)
    return sure.unionByName(told).drop("_digits", "_range", "_last", "_edge", "_need", *names.values())
