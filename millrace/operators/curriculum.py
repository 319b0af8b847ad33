"""Selection traces, and training in the order that they recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.shared import store


def trace_rows(selected: DataFrame, period: int = 1) -> DataFrame:
    """What a trace holds of the selected rows, in every ``period``-th step."""
    rows = selected.where(F.col("step") % period == 0) if period > 1 else selected
    return rows.select("step", "content_hash", "origin", "origin_tag", "rho", "target_loss", F.col("sel_rank").alias("rank"))


def last_batch(trace: DataFrame, batch_size: int) -> DataFrame:
    """Of a step that was done again the last ``batch_size`` rows, in file and
    line order (``file, line``), numbered ``pos`` from 0."""
    recent = F.row_number().over(Window.partitionBy("phase", "step").orderBy(F.desc("file"), F.desc("line")))
    kept = trace.withColumn("_r", recent).where(F.col("_r") <= batch_size)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("phase", "step").orderBy("file", "line")) - 1).drop("_r")


def restarted(trace: DataFrame) -> DataFrame:
    """Without a batch size: a step seen again after another one starts anew,
    and only its last run of rows stays.

    Where a run begins is found from the row before; rows are compared within
    a file, and across files by the last row of the file before.
    """
    order = Window.partitionBy("phase", "file").orderBy("line")
    ends = trace.groupBy("phase", "file").agg(F.max_by("step", "line").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("phase").orderBy("file"))).select("phase", "file", "_before")
    rows = trace.join(ends, ["phase", "file"]).withColumn("_prev", F.coalesce(F.lag("step").over(order), "_before"))
    rows = rows.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("step")), F.struct("file", "line")))
    begin = rows.groupBy("phase", "step").agg(F.max("_new").alias("_begin"))
    kept = rows.join(begin, ["phase", "step"]).where(F.struct("file", "line") >= F.col("_begin"))
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("phase", "step").orderBy("file", "line")) - 1).drop("_prev", "_before", "_new", "_begin")


def build_curriculum(blocks: DataFrame, trace: DataFrame, batch_size: int | None = None) -> DataFrame:
    """Blocks in recorded order: ``phase, step, pos`` and the block's columns,
    repeats and all. Of blocks that share a hash the last counts; a step of
    another size, or a hash without a block, ends with an error.

    Only blocks that the trace names are gathered by hash. The result is
    stored once, and checked there by one aggregate."""
    steps = store((last_batch(trace, batch_size) if batch_size else restarted(trace)).select("phase", "step", "pos", "content_hash"), "curriculum-steps")
    rest = [c for c in blocks.columns if c != "content_hash"]
    named = blocks.join(steps.select("content_hash").distinct(), "content_hash", "left_semi")
    one = named.groupBy("content_hash").agg(F.max_by(F.struct(*rest), F.struct("domain", "origin", "block")).alias("_row"))
    joined = store(steps.join(one, "content_hash", "left"), "curriculum")
    told = joined.groupBy("phase", "step").agg(F.count("*").alias("n"), F.count(F.when(F.col("_row").isNull(), 1)).alias("lost"))
    wrong = F.col("n") != (batch_size or F.col("n"))
    odd, lost = told.agg(F.min(F.when(wrong, F.struct("phase", "step", "n"))), F.coalesce(F.sum("lost"), F.lit(0))).first()
    if odd is not None:
        raise ValueError(f"step {odd['step']} of phase {odd['phase']} has {odd['n']} samples, the batch size is {batch_size}")
    if lost:
        raise RuntimeError(f"{lost} curriculum samples are not in the blocks table")
    return joined.select("phase", "step", "pos", "content_hash", "_row.*").orderBy("phase", "step", "pos")
