"""Validation losses by corpus and origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import metric_safe


def corpus_sums(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over valid samples (target_loss, ref_loss, origin_tag,
    sample_mask); a missing reference loss counts as 0."""
    ref = F.coalesce(F.col("ref_loss"), F.lit(0.0))
    rho, valid = F.col("target_loss") - ref, F.col("sample_mask") > 0
    adapt, replay = valid & (F.col("origin_tag") == 0), valid & (F.col("origin_tag") == 1)
    total = lambda v, w: F.coalesce(F.sum(F.when(w, v)), F.lit(0.0))
    out = [total(v, w).alias(f"{n}_sum_{c}") for c, w in (("adapt", adapt), ("replay", replay)) for n, v in (("target", F.col("target_loss")), ("ref", ref), ("rho", rho))]
    count = lambda w: F.count(F.when(w, 1))
    return samples.groupBy(*by).agg(*out, count(replay & (rho > 0)).alias("n_rho_replay_above_zero"), count(adapt).alias("n_adapt"), count(replay).alias("n_replay"))


def corpus_means(sums: DataFrame) -> DataFrame:
    """Means from any number of rows of :func:`corpus_sums`: the same however
    the samples were dealt to shards."""
    rows = {c: F.sum(c) for c in sums.columns if "_sum_" in c or c.startswith("n_")}
    ratio = lambda a, b: rows[a] / F.greatest(rows[b], F.lit(1))
    out = [ratio(f"{n}_sum_{c}", f"n_{c}").alias(f"{m}_{c}") for c in ("adapt", "replay") for n, m in (("target", "target_loss"), ("ref", "ref_loss"), ("rho", "rho_mean"))]
    return sums.agg(*out, ratio("n_rho_replay_above_zero", "n_replay").alias("frac_rho_replay_above_zero"))


def validation_loss(samples: DataFrame, batches: int = 0) -> DataFrame:
    """Mean of the batches' losses weighted by their valid samples; the first
    ``batches`` only, if above 0. Every batch (``batch``) holds ``target_loss``."""
    rows = samples.where(F.col("batch") < batches) if batches > 0 else samples
    each = rows.groupBy("batch").agg(F.sum("sample_mask").alias("w"), (F.sum(F.col("target_loss") * F.col("sample_mask")) / F.greatest(F.sum("sample_mask"), F.lit(1.0))).alias("v"))
    w = F.coalesce(F.sum("w"), F.lit(0.0))
    return each.agg((F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)) / F.when(w == 0, 1.0).otherwise(w)).alias("val_loss"), F.count("*").alias("n_batches"))


def loss_by_origin(samples: DataFrame) -> DataFrame:
    return samples.where("sample_mask > 0").groupBy(metric_safe(F.col("origin")).alias("origin")).agg(F.avg("target_loss").alias("target_loss"), F.avg(F.coalesce("ref_loss", F.lit(0.0))).alias("ref_loss"), F.count("*").alias("n"))


def merge_microbatches(rows: DataFrame, means: tuple[str, ...] = ("global_valid_seqs", "global_valid_toks")) -> DataFrame:
    """One row per batch and metric of (batch, metric, value)."""
    return rows.groupBy("batch", "metric").agg(F.when(F.col("metric").isin(*means), F.avg("value")).otherwise(F.sum("value")).alias("value"))
