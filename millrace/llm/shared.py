"""Packed rows, tables, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import clear, drop, store

__all__ = ["clear", "components", "drop", "rows_of", "sieved", "store", "table"]

#: Bits of a broadcast bitmap: 8 MB.
SIEVE = 1 << 26


def rows_of(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns in one struct ``_row``, so that no name of
    theirs meets one of an operator's; ``select("_row.*")`` unpacks them."""
    return docs.select(F.struct("*").alias("_row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sieved(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be among ``keys`` (one long column), and the
    others, null keys too. The first are all that are, and of those that aren't
    a share that grows with the number of keys.

    A bitmap of hashes is broadcast, of SIEVE bits whatever the number of keys,
    so that an exact join behind it shuffles little of the other rows."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SIEVE)) + 1
    own = place(keys[keys.columns[0]])
    bits = keys.where(keys[keys.columns[0]].isNotNull()).groupBy(F.bitmap_bucket_number(own).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1
    # the hash of a null is a number
    hit = (F.bitmap_bucket_number(place(key)) == F.col("_bucket")) & there & key.isNotNull()
    return rows.join(F.broadcast(bits), hit, "left_semi"), rows.join(F.broadcast(bits), hit, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long node ids.

    ``edges`` has columns ``a, b``. Returns ``node, root`` for every node that
    can reach a smaller one; ``root`` is the smallest id reachable.
    Alternates the large-star and small-star steps (Kiveris et al. 2014) until
    the edge set no longer changes. Each step groups by node with map-side
    combining and joins the minimum back: no node's edges are aggregated in one
    task, while the join on a hub is a skewed one, left to adaptive execution,
    which splits it; each result is written to the shared folder.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = _signature(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = store(small, "cc")
        drop(now)
        now, before = after, seen
        seen = _signature(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)
