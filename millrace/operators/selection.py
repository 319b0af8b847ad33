"""Selecting a training batch from each step's scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRATEGIES = ("top_k", "fixed_ratio", "replay_only_rho", "fixed_ratio_rho")


def usable() -> Column:
    """Candidates: no padding, and a finite rho."""
    return (F.col("sample_mask") > 0) & F.col("rho").isNotNull() & ~F.isnan("rho") & (F.abs("rho") < float("inf"))


def _quota(k: int, ratio: float) -> tuple[Column, Column]:
    """Adaptation and replay rows of a step by its counts ``_na, _nr``; what
    one side lacks the other fills."""
    total = F.least(F.lit(k), F.col("_na") + F.col("_nr"))
    replay = F.least(F.bround(total * F.lit(float(ratio))).cast("long"), F.col("_nr"))
    adapt = F.least(total - replay, F.col("_na"))
    return adapt, F.least(total - adapt, F.col("_nr"))


def select(pool: DataFrame, k: int, strategy: str = "top_k", replay_ratio: float = 0.25, seed: int = 42) -> DataFrame:
    """The selected rows of ``pool`` with ``sel_rank`` from 1.

    ``pool``: step, block_id, rho, sample_mask, origin_tag and more. ``top_k``
    ranks both corpora jointly; the others hold the replay corpus to a share
    and pick in each corpus by rho or at random (by hash). Ties go to the
    smaller id; a step without a candidate selects nothing.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    good = pool.where(usable())
    if strategy == "top_k":
        rank = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("rho"), "block_id"))
        return good.withColumn("sel_rank", rank).where(F.col("sel_rank") <= k)
    if "origin_tag" not in pool.columns:
        raise ValueError(f"{strategy} needs origin_tag")
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"sel:{seed}:"), F.col("step").cast("string"), F.lit(":"), F.col("block_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    by_rho = {"fixed_ratio": F.lit(False), "replay_only_rho": F.col("origin_tag") == 1, "fixed_ratio_rho": F.lit(True)}[strategy]
    rank = F.row_number().over(Window.partitionBy("step", "origin_tag").orderBy(F.when(by_rho, -F.col("rho")).otherwise(chance), "block_id"))
    # no corpus gives more than k rows, which bounds the window before the counts are joined
    ranked = good.where(F.col("origin_tag").isin(0, 1)).withColumn("_r", rank).where(F.col("_r") <= k)
    count = lambda t: F.count(F.when(F.col("origin_tag") == t, 1))
    counts = good.groupBy(F.col("step").alias("_s")).agg(count(0).alias("_na"), count(1).alias("_nr"))
    adapt, replay = _quota(k, replay_ratio)
    out = ranked.join(counts, F.col("step") == F.col("_s"))
    out = out.withColumn("_ka", adapt).withColumn("_kr", replay).where(F.col("_r") <= F.when(F.col("origin_tag") == 0, F.col("_ka")).otherwise(F.col("_kr")))
    return out.withColumn("sel_rank", (F.col("_r") + F.when(F.col("origin_tag") == 1, F.col("_ka")).otherwise(0)).cast("int")).drop("_r", "_s", "_na", "_nr", "_ka", "_kr")


def flagged(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """``pool`` with ``selected``."""
    marks = selected.select("step", "block_id", F.lit(True).alias("_sel"))
    return pool.join(marks, ["step", "block_id"], "left").withColumn("selected", F.coalesce("_sel", F.lit(False))).drop("_sel")
