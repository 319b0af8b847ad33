"""Selection metrics of a step, as one row or as a long table of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import corpus_name, origin_key

QUANTILES = ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99"))
CORPORA = ((0, "adapt"), (1, "replay"))


def mean_or_nan(value: Column, where: Column) -> Column:
    """Mean over the rows, NaN where there is none."""
    return F.coalesce(F.avg(F.when(where, value)), F.lit(float("nan")))


def share(count: Column, of: Column) -> Column:
    """Ratio of counts; of nothing, 0."""
    return count / F.greatest(of, F.lit(1))


def masked_mean(value: Column, mask: Column, norm: Column) -> Column:
    return F.sum(value * mask) / F.greatest(norm, F.lit(1.0))


def score_metrics(pool: DataFrame) -> DataFrame:
    """Per step the candidates' loss and number; never called just loss."""
    n = F.sum("sample_mask")
    return pool.groupBy("step").agg(masked_mean(F.col("target_loss"), F.col("sample_mask"), n).alias("candidate_loss"), n.alias("num_valid_candidates"))


def selection_metrics(pool: DataFrame) -> DataFrame:
    """Per step means, counts and shares by corpus, and what selected and
    dropped rows look like. ``pool`` has ``selected``; steps without a valid
    row give none."""
    valid = pool.where("sample_mask > 0").withColumn("ref_loss", F.col("target_loss") - F.col("rho"))
    count = lambda c: F.count(F.when(c, 1))
    picked, out = F.col("selected"), []
    for tag, name in CORPORA:
        own = F.col("origin_tag") == tag
        out += [mean_or_nan(F.col(c), own).alias(f"{c.replace('rho', 'rho_mean')}_{name}") for c in ("target_loss", "ref_loss", "rho")]
        out += [count(own & picked).alias(f"n_selected_{name}"), share(count(own & picked), count(own)).alias(f"frac_selected_{name}")]
    out += [share(count((F.col("origin_tag") == 1) & (F.col("rho") > 0)), count(F.col("origin_tag") == 1)).alias("frac_rho_replay_above_zero")]
    out += [share(count(F.col("origin_tag") == 0), F.count("*")).alias("frac_adapt_in_candidate"), count(picked).alias("k_effective")]
    out += [mean_or_nan(F.col(c), w).alias(f"{c}_mean_{n}") for n, w in (("selected", picked), ("dropped", ~picked)) for c in ("rho", "target_loss", "ref_loss")]
    return valid.groupBy("step").agg(*out)


def rho_percentiles(pool: DataFrame, period: int = 1) -> DataFrame:
    """Exact percentiles of rho per corpus, in every ``period``-th step."""
    rows = pool.where((F.col("sample_mask") > 0) & F.col("origin_tag").isin(0, 1) & (F.col("step") % period == 0))
    at = F.percentile("rho", F.array(*(F.lit(q) for q, _ in QUANTILES)))
    out = rows.groupBy("step", corpus_name(F.col("origin_tag")).alias("corpus")).agg(at.alias("_p"))
    return out.select("step", "corpus", *(F.get("_p", F.lit(i)).alias(n) for i, (_, n) in enumerate(QUANTILES)))


def by_origin(pool: DataFrame) -> DataFrame:
    """Candidates, selected rows and rho per corpus and origin; origins
    without a valid row are left out."""
    rows = pool.where("sample_mask > 0")
    n, picked = F.count("*"), F.count(F.when(F.col("selected"), 1))
    return rows.groupBy("step", corpus_name(F.col("origin_tag")).alias("corpus"), origin_key(F.col("origin")).alias("origin")).agg(
        n.alias("n_candidate"), picked.alias("n_selected"), share(picked, n).alias("frac_selected"), F.avg("rho").alias("rho_mean"), F.avg((F.col("rho") > 0).cast("double")).alias("frac_above_zero"),
    )


_PREFIX = {"target_loss": "loss", "ref_loss": "loss", "rho_mean": "rho", "frac_rho": "rho", "n_selected": "selection", "frac_selected": "selection", "frac_adapt": "selection", "k_effective": "selection"}


def metric_name(column: str) -> str:
    if column.endswith(("_selected", "_dropped")) and "_mean_" in column:
        return f"selection_sanity/{column}"
    return next((f"{p}/{column}" for k, p in _PREFIX.items() if column.startswith(k)), column)


def long_table(metrics: DataFrame, prefix: str = "train") -> DataFrame:
    """``step, prefix, metric, value`` rows of a table with a column per metric."""
    names = [c for c in metrics.columns if c != "step"]
    pairs = F.explode(F.array(*(F.struct(F.lit(metric_name(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
    return metrics.select("step", F.lit(prefix).alias("prefix"), pairs.alias("_m")).select("step", "prefix", "_m.*")


def reduce_train(rows: DataFrame, means: tuple[str, ...] = ("lr", "wd", "global_valid_seqs", "global_valid_toks")) -> DataFrame:
    """Step metrics of micro-batches (step, metric, value): rates and global
    counts are averaged, all else is summed."""
    return rows.groupBy("step", "metric").agg(F.avg("value").alias("_mean"), F.sum("value").alias("_sum")).select("step", "metric", F.when(F.col("metric").isin(*means), F.col("_mean")).otherwise(F.col("_sum")).alias("value"))
