"""Names of origins and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dataset-family prefixes that an origin's name loses; the first that fits.
ORIGIN_PREFIXES = ("Nemotron-Pretraining-Legal-", "Nemotron-Pretraining-", "Nemotron-CC-", "Nemotron-")


def clean_origin(name: Column) -> Column:
    """A subset's directory name as a short lower-case origin."""
    bare = F.regexp_replace(F.trim(name), f"(?i)^(?:{'|'.join(ORIGIN_PREFIXES)})", "")
    clean = F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def origin_key(name: Column) -> Column:
    """An origin as part of a metric's name."""
    safe = F.translate(F.trim(name), " \t\n/", "____")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))


def metric_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_.\-]", "_")


def corpus_name(tag: Column) -> Column:
    return F.when(tag == 0, "adapt").when(tag == 1, "replay").otherwise(F.concat(F.lit("tag"), tag.cast("string")))
