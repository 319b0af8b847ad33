"""Reference losses: a pass per domain appends to one cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.mixer import choose_domains
from millrace.operators.scoring import Scorer, with_target_loss
from millrace.sources.corpus import append_cache


def precompute(blocks: DataFrame, domain: str, scorer: Scorer, cache_path: str, max_rows: int = -1, buckets: int | None = None) -> None:
    """Scores one domain's blocks, held-out ones too, each hash once: the
    first of its origin, bucketed like the blocks if ``buckets`` says so. With ``max_rows`` only the first so many, in order."""
    rows = choose_domains(blocks, domain, 0.0)
    rows = rows.groupBy("content_hash").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "content_hash")), F.struct("origin", "block")).alias("_row")).select("content_hash", "_row.*")
    if max_rows >= 0:
        rows = rows.orderBy("origin", "block").limit(max_rows)
    scored = with_target_loss(rows, scorer)
    append_cache(scored.select("content_hash", "origin", "origin_tag", F.col("target_loss").alias("ref_loss"), (F.size("token_ids") - 1).alias("n_response_tokens")), cache_path, buckets=buckets)
