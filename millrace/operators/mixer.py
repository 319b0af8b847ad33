"""Training and validation rows of a run from a blocks table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import hash_digits
from millrace.operators.sampling import cap_per_origin, lowest


def choose_domains(blocks: DataFrame, adapt_domain: str, replay_share: float = 1.0, seed: int = 42) -> DataFrame:
    """All blocks of the adaptation domain and a share of the others; a share
    of 0 or less leaves the adaptation domain alone."""
    if replay_share >= 1:
        return blocks.where(F.col("domain").isNotNull())
    adapt, other = blocks.where(F.col("domain") == adapt_domain), blocks.where(F.col("domain") != adapt_domain)
    if replay_share <= 0:
        return adapt
    k = other.agg(F.bround(F.count("*") * F.lit(float(replay_share))).cast("long")).first()[0]
    other = lowest(other, k, f"mix:{seed}", ties=("domain", "origin", "block")) if k else other.limit(0)
    return adapt.unionByName(other)


def train_rows(kept: DataFrame) -> DataFrame:
    return kept.where(F.coalesce("split", F.lit("train")) == "train")


def validation_rows(blocks: DataFrame, kept: DataFrame, full_holdout: bool = True, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Held-out rows: of all blocks, whatever the replay share, or of the kept."""
    return cap_per_origin((blocks if full_holdout else kept).where(F.col("split") == "holdout"), cap, seed)


def shuffled(rows: DataFrame, seed: int, salt: str = "valshuf") -> DataFrame:
    """A fixed random order, the same for every run."""
    return rows.orderBy(hash_digits(f"{salt}:{seed}", F.col("content_hash")), "content_hash", "origin", "block")


def with_fallback(val: DataFrame, train: DataFrame, capped: bool, n: int = 64) -> DataFrame:
    """Under a read cap a run without held-out rows validates on a few train rows."""
    if capped and val.limit(1).count() == 0:
        return train.orderBy("origin", "block").limit(n)
    return val
