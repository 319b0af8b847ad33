"""Weighted merge of two tables of weight tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_weights(base: DataFrame, other: DataFrame, weight: float) -> DataFrame:
    """``name, shape, dtype, values, merged``: (1 - w) base + w other in
    single precision for tensors of one name, shape and floating type; the
    base tensor for all others."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError(f"weight must be in [0, 1], got {weight}")
    spec = other.select(F.col("name").alias("_n"), F.col("shape").alias("_s"), F.col("dtype").alias("_d"), F.col("values").alias("_v"))
    fits = F.col("_n").isNotNull() & (F.col("shape") == F.col("_s")) & F.col("dtype").startswith("float") & F.col("_d").startswith("float")
    w, rest = F.lit(weight).cast("float"), F.lit(1.0 - weight).cast("float")
    mixed = F.zip_with("values", "_v", lambda b, s: (b * rest + s * w).cast("float"))
    return base.join(spec, F.col("name") == F.col("_n"), "left").select("name", "shape", "dtype", F.when(fits, mixed).otherwise(F.col("values")).alias("values"), F.coalesce(fits, F.lit(False)).alias("merged"))
