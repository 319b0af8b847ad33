"""Reference-loss cache: dedup, conflicts, and the guarded join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.buckets import HEAT
from millrace.sources.shared import store


def dedup_cache(cache: DataFrame, order: tuple[str, ...] = ("part", "row")) -> DataFrame:
    """One loss per hash: of several the first in file and row order."""
    return cache.groupBy("content_hash").agg(F.min_by("ref_loss", F.struct(*order)).alias("ref_loss"))


def conflicts(cache: DataFrame) -> DataFrame:
    """Hashes with more than one loss."""
    return cache.groupBy("content_hash").agg(F.count_distinct("ref_loss").alias("n_losses"), F.count("*").alias("n_rows")).where("n_losses > 1")


def missing(rows: DataFrame, cache: DataFrame) -> DataFrame:
    return rows.join(cache.select("content_hash"), "content_hash", "left_anti")


def with_loss(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``rows`` with ``ref_loss`` and ``_hit``, whether the cache has their hash.

    Bucketed rows (with ``heat``) and a cache of as many buckets meet without a
    shuffle. The hashes of hot rows are fewer than the buckets, so their part of
    the cache is broadcast and the rows stay where they are."""
    hits = cache.select(F.col("content_hash").alias("_hash"), F.col("ref_loss").cast("double").alias("ref_loss"))

    def meet(some: DataFrame, found: DataFrame) -> DataFrame:
        return some.join(found, F.col("content_hash") == F.col("_hash"), "left").withColumn("_hit", F.col("_hash").isNotNull()).drop("_hash")

    if HEAT not in rows.columns:
        return meet(rows, hits)
    hot = rows.where(F.col(HEAT) == "hot")
    named = hot.select(F.col("content_hash").alias("_hash")).where("_hash is not null").distinct()
    few = hits.join(F.broadcast(named), "_hash", "left_semi")
    return meet(rows.where(F.col(HEAT) == "cold"), hits).unionByName(meet(hot, F.broadcast(few)))


def join_ref_loss(rows: DataFrame, cache: DataFrame, allow_missing: float = 0.0) -> DataFrame:
    """``rows`` with ``ref_loss``; rows without one go, and more of these than
    allowed end with an error. ``cache`` holds each hash once.

    The join runs once: its result is stored, and counted there."""
    joined = store(with_loss(rows, cache), "ref-loss")
    n, lost = joined.agg(F.count("*"), F.count(F.when(~F.col("_hit"), 1))).first()
    if lost and lost / max(n, 1) > allow_missing:
        some = [r[0] for r in joined.where("not _hit").select("content_hash").limit(10).collect()]
        raise RuntimeError(f"reference loss missing for {lost} of {n} rows ({100 * lost / n:.2f}%), more than the allowed fraction {allow_missing}: {some}")
    return joined.where(F.col("ref_loss").isNotNull()).drop("_hit", HEAT)
