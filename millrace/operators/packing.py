"""Packing documents into fixed-length token blocks, each of one origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.hashing import content_hash
from millrace.sources.shared import store

#: Documents whose lengths one task sums in order.
STRIDE = 1 << 16


def running_start(df: DataFrame, group: list[str], major: str, minor: str, n: str) -> DataFrame:
    """``df`` with ``start``: the sum of ``n`` over the rows before, per group,
    by (major, minor).

    Rows are summed within strides of the minor key and strides are summed per
    group, so a group with a third of all rows is not ordered in one task.
    """
    stride = F.floor(F.col(minor) / STRIDE)
    keyed = df.withColumn("_stride", stride)
    within = F.sum(n).over(Window.partitionBy(*group, major, "_stride").orderBy(minor).rowsBetween(Window.unboundedPreceding, -1))
    sums = keyed.groupBy(*group, major, "_stride").agg(F.sum(n).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(major, "_stride").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, major, "_stride", F.coalesce(before, F.lit(0)).alias("_before"))
    return keyed.withColumn("_within", F.coalesce(within, F.lit(0))).join(sums, [*group, major, "_stride"]).withColumn("start", F.col("_before") + F.col("_within")).drop("_stride", "_within", "_before")


def pack(docs: DataFrame, block_size: int, eod: int, keep_partial: bool = False, group: tuple[str, ...] = ("domain", "origin"), major: str = "part", minor: str = "doc", tokens: str = "tokens") -> DataFrame:
    """``group..., block, token_ids``: an end-of-document token follows every
    document, also an empty one; the stream of each group, by (major, minor),
    is cut into blocks. A last block that is short goes unless kept.

    Tokens are stored once with their number, so that a tokenizer runs once:
    offsets are found from the numbers alone. ``drop`` of the result removes
    them, once what is made of it is stored."""
    if block_size <= 0:
        raise ValueError(f"block_size must be positive, got {block_size}")
    group = list(group)
    kept = store(docs.select(*group, major, minor, F.concat(tokens, F.array(F.lit(eod))).alias("_toks")).withColumn("_len", F.size("_toks").cast("long")), "tokens")
    # the tokens join their offsets again by document
    spans = running_start(kept.select(*group, major, minor, "_len"), group, major, minor, "_len")
    placed = kept.drop("_len").join(spans, [*group, major, minor])
    size = F.lit(block_size)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("_len") - 1) / size)
    cut = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * size)
    high = F.least(F.col("start") + F.col("_len"), (F.col("block") + 1) * size)
    part = F.slice("_toks", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    blocks = cut.select(*group, "block", F.struct(low.alias("at"), part.alias("part")).alias("_p")).groupBy(*group, "block").agg(F.sort_array(F.collect_list("_p")).alias("_parts"))
    blocks = blocks.select(*group, "block", F.flatten("_parts.part").alias("token_ids"))
    out = blocks if keep_partial else blocks.where(F.size("token_ids") == block_size)
    out._millrace_path = kept._millrace_path
    return out



def pack_more(docs: DataFrame, tails: DataFrame | None, block_size: int, eod: int, group: tuple[str, ...] = ("domain", "origin")) -> tuple[DataFrame, DataFrame]:
    """Packs documents behind what was packed before: the full blocks that they
    complete, numbered on, and the new ``tails``.

    ``tails`` (``group..., block, token_ids``) holds for each group the number
    of its next block and the tokens that wait for it, fewer than a block. They
    go before the group's first new document. What is packed in steps is what
    :func:`pack` makes at once, if the later documents are the later ones in
    (part, doc) order. Nothing that was packed is read again."""
    group = list(group)
    rows = docs.select(*group, F.lit(1).alias("_new"), "part", "doc", "tokens")
    if tails is not None:
        # a tail ends with a document's end, which packing adds again
        waiting = tails.where(F.size("token_ids") > 0).select(*group, F.lit(0).alias("_new"), F.lit("").alias("part"), F.lit(0).cast("long").alias("doc"), F.expr("slice(token_ids, 1, size(token_ids) - 1)").alias("tokens"))
        rows = rows.unionByName(waiting.join(docs.select(*group).distinct(), group, "left_semi"))
    # tails come first whatever the names of the parts
    packed = store(pack(rows.withColumn("part", F.struct("_new", "part")), block_size, eod, True, tuple(group)), "packed")
    if tails is not None:
        packed = packed.join(tails.select(*group, F.col("block").alias("_base")), group, "left").withColumn("block", F.col("block") + F.coalesce("_base", F.lit(0))).drop("_base")
    full = packed.where(F.size("token_ids") == block_size)
    short = F.size("token_ids") < block_size
    now = packed.groupBy(*group).agg((F.max("block") + F.when(F.bool_or(short), 0).otherwise(1)).alias("block"), F.coalesce(F.max(F.when(short, F.col("token_ids"))), F.array().cast("array<int>")).alias("token_ids"))
    if tails is not None:
        now = now.unionByName(tails.join(now.select(*group), group, "left_anti"))
    return full, now


def tag(blocks: DataFrame, adapt_domain: str, capabilities: DataFrame | None = None, n_bytes: Column | None = None) -> DataFrame:
    """Block rows with origin tag, capability, byte count and content hash.

    ``capabilities`` (origin, capability) is a small table; an origin that it
    lacks is its own capability. ``n_bytes`` is null without a decoder.
    """
    out = blocks
    if capabilities is not None:
        out = out.join(capabilities.select("origin", F.col("capability").alias("_cap")), "origin", "left")
    capability = F.coalesce("_cap", "origin") if capabilities is not None else F.col("origin")
    return out.select(
        "token_ids", "origin", F.when(F.col("domain") == adapt_domain, 0).otherwise(1).alias("origin_tag"), "domain", capability.alias("capability"),
        (F.lit(None) if n_bytes is None else n_bytes).cast("long").alias("n_bytes"), content_hash(F.col("origin"), F.col("token_ids")).alias("content_hash"), "block",
    )
