"""Deterministic samples, caps, balance and the held-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import hash01, hash_digits
from millrace.operators.packing import running_start
from millrace.operators.ranking import lowest_marked


def lowest(df: DataFrame, keep: int, salt: str, by: tuple[str, ...] = (), key: str = "content_hash", ties: tuple[str, ...] = ()) -> DataFrame:
    """Per group the ``keep`` rows with the lowest salted hash."""
    return lowest_marked(df, lambda _: F.lit(keep).cast("long"), hash_digits(salt, F.col(key)), (key, *ties), by).where("_low").drop("_low")


def sample_documents(docs: DataFrame, fraction: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Each document with this probability, by its key's hash."""
    return docs if fraction >= 1 else docs.where(hash01(f"doc:{seed}", F.col(key).cast("string")) < F.lit(float(fraction)))


def first_documents(docs: DataFrame, most: int | None, by: tuple[str, ...] = ("domain", "origin"), order: tuple[str, ...] = ("part", "doc")) -> DataFrame:
    """The first documents of each origin, in reading order."""
    if most is None:
        return docs
    placed = running_start(docs.withColumn("_one", F.lit(1)), list(by), *order, "_one")
    return placed.where(F.col("start") < most).drop("start", "_one")


def split_holdout(blocks: DataFrame, fraction: float, seed: int = 42, floor: int = 0, by: tuple[str, ...] = ("domain", "origin")) -> DataFrame:
    """``split``: per group the blocks with the lowest hash are held out.

    Their number is the fraction, rounded up, or the floor; at most a fifth of
    the group but one at least, and never the whole group.
    """
    if not 0.0 <= fraction < 1.0:
        raise ValueError(f"holdout fraction must be in [0, 1), got {fraction}")

    def held(n: Column) -> Column:
        k = F.greatest(F.ceil(n * F.lit(float(fraction))), F.least(F.lit(floor), n))
        k = F.least(k, F.greatest(F.lit(1), F.floor(n * F.lit(0.2))))
        return F.when(k >= n, F.greatest(F.lit(0), n - 1)).otherwise(k)

    rows = lowest_marked(blocks, held, hash_digits(str(seed), F.col("content_hash")), ("content_hash", "block"), by)
    return rows.withColumn("split", F.when(F.col("_low"), "holdout").otherwise("train")).drop("_low")


def balance_replay(blocks: DataFrame, seed: int = 42) -> DataFrame:
    """All adaptation blocks, and of more replay blocks about as many."""
    adapt = F.count(F.when(F.col("origin_tag") == 0, 1))
    # share of the replay blocks to keep; over 1, or null without any, keeps all
    share = blocks.agg(F.try_divide(adapt, F.count("*") - adapt).alias("share")).scalar()
    return blocks.where((F.col("origin_tag") == 0) | (F.coalesce(share, F.lit(2.0)) >= 1) | (hash01(f"pool:{seed}", F.col("content_hash")) < share))


def cap_per_origin(rows: DataFrame, cap: int | None, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each origin (over all domains)."""
    return lowest(rows, cap, f"val:{seed}", ("origin",), ties=("block",)) if cap else rows


def cap_blocks(rows: DataFrame, cap: int | None, seed: int, by: tuple[str, ...]) -> DataFrame:
    """At most ``cap`` blocks of each domain or of each domain and origin."""
    return lowest(rows, cap, f"cap:{seed}:{by[-1]}", by, ties=("origin", "block")) if cap else rows


def report(blocks: DataFrame) -> DataFrame:
    """Counts of train and held-out blocks per domain and origin."""
    count = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(s)
    return blocks.groupBy("domain", "origin").agg(F.max("capability").alias("capability"), count("train"), count("holdout"), F.count("*").alias("total"))
