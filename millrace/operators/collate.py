"""Block rows as training samples, and batches of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a sample holds where its row has no value. The reference loss has none.
DEFAULTS = {"origin": "unknown", "origin_tag": 0, "content_hash": ""}


def samples(rows: DataFrame, idx: str = "block_id") -> DataFrame:
    """A sample per block row: its tokens with a mask of ones, as the whole
    block is trained on; length, origin, tag and hash with their defaults, a
    multiplier of one, its number, and the reference loss if there is one."""
    value = lambda c: F.coalesce(c, F.lit(DEFAULTS[c])) if c in rows.columns else F.lit(DEFAULTS[c])
    ref = F.col("ref_loss") if "ref_loss" in rows.columns else F.lit(None)
    return rows.select(
        F.col(idx).cast("long").alias("idx"), "token_ids", F.transform("token_ids", lambda _: F.lit(1.0)).alias("token_mask"), F.size("token_ids").alias("length"),
        value("origin").alias("origin"), value("origin_tag").cast("int").alias("origin_tag"), value("content_hash").alias("content_hash"), F.lit(1.0).alias("loss_multiplier"), ref.cast("double").alias("ref_loss"),
        *(c for c in ("step", "sample_mask") if c in rows.columns),
    )


def conversations(turns: DataFrame, roles: tuple[str, ...] = ("assistant",), by: str = "conv_id", order: str = "turn") -> DataFrame:
    """A sample per conversation from its messages (``role, tokens``): all
    tokens in order, and a mask that is one on those of ``roles``. Messages of
    a null role count as others'; null tokens are none."""
    own = F.coalesce(F.col("role").isin(*roles), F.lit(False)).cast("double")
    tokens = F.coalesce("tokens", F.array().cast("array<int>"))
    message = F.struct(F.col(order).alias("at"), tokens.alias("tokens"), F.transform(tokens, lambda _: own).alias("mask"))
    found = turns.groupBy(by).agg(F.sort_array(F.collect_list(message)).alias("_m"))
    return found.select(by, F.flatten("_m.tokens").alias("token_ids"), F.flatten("_m.mask").alias("token_mask"))


def collated(rows: DataFrame, by: str = "step") -> DataFrame:
    """``rows`` as batches (``by``) must hold them: a tag on every row, and in
    a batch reference losses on all rows or on none. Missing origins and hashes
    get their defaults.

    The check travels with the plan: a batch that breaks it ends the query.
    Its counts are one small row a batch, joined back.
    """
    told = rows.groupBy(F.col(by).alias("_batch")).agg(F.count("*").alias("_rows"), F.count("ref_loss").alias("_refs"), F.count("origin_tag").alias("_tags"))
    wrong = F.when(F.col("_tags") < F.col("_rows"), "origin_tag is missing on a row of batch ").when((F.col("_refs") > 0) & (F.col("_refs") < F.col("_rows")), "ref_loss is missing on a row of batch ")
    told = told.select("_batch", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col("_batch").cast("string"))).cast("int")).otherwise(0).alias("_ok"))
    out = rows.join(told, F.col(by).eqNullSafe(F.col("_batch"))).where("_ok = 0").drop("_batch", "_ok")
    for c in ("origin", "content_hash"):
        out = out.withColumn(c, F.coalesce(c, F.lit(DEFAULTS[c])))
    return out
