"""Preparing a run's rows, and the loop: score, select, learn, log."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.hashing import hash_digits
from millrace.functions.permutation import EpochOrder
from millrace.operators.cache import dedup_cache, join_ref_loss
from millrace.operators.curriculum import build_curriculum, trace_rows
from millrace.operators.metrics import by_origin, long_table, rho_percentiles, score_metrics, selection_metrics
from millrace.operators.mixer import choose_domains, shuffled, train_rows, validation_rows, with_fallback
from millrace.operators.ranking import ranked
from millrace.operators.scoring import Scorer, with_rho, with_target_loss
from millrace.operators.selection import select, usable
from millrace.operators.validation import corpus_means, corpus_sums, loss_by_origin, validation_loss
from millrace.plans.config import MixerConfig, TrainConfig
from millrace.sources.commits import CommitLog
from millrace.sources.corpus import TRACE_SCHEMA, append_trace, read_blocks, read_cache, read_trace
from millrace.sources.shared import delete, drop, kept, new_path, release, store

METRIC_SCHEMA = "step long, prefix string, metric string, value double"


@dataclass
class State:
    """Where a run stands; saved to continue it."""

    epoch: int = 0
    step: int = 0
    total_steps: int = 0
    consumed_samples: int = 0
    total_valid_tokens: int = 0


def prepare(spark: SparkSession, cfg: MixerConfig) -> tuple[DataFrame, DataFrame]:
    """Training rows and, in a fixed order, validation rows."""
    blocks = read_blocks(spark, cfg.corpus_path, cfg.max_blocks)
    kept = choose_domains(blocks, cfg.adapt_domain, cfg.replay_share, cfg.seed)
    train = train_rows(kept)
    if cfg.curriculum_trace_dirs:
        train = build_curriculum(blocks, read_trace(spark, list(cfg.curriculum_trace_dirs)), cfg.curriculum_batch_size)
    val = with_fallback(validation_rows(blocks, kept, cfg.full_val_holdout, cfg.max_val_samples_per_origin, cfg.seed), train, cfg.max_blocks is not None)
    if cfg.ref_loss_cache_path:
        cache = dedup_cache(read_cache(spark, cfg.ref_loss_cache_path))
        train, val = (join_ref_loss(rows, cache, cfg.allow_missing_fraction) for rows in (train, val))
    return train, shuffled(val, cfg.seed)


def pools(rows: DataFrame, size: int, salt: str | None, whole: bool = True) -> DataFrame:
    """``rows`` with ``step`` and ``block_id``: pools of ``size``, in a salted
    order, or in curriculum order (phase, step, pos) without a salt. A last
    pool that is short is dropped, unless ``whole`` is false."""
    if salt is None:
        counts = rows.groupBy("phase", "step").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy("phase", "step").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select("phase", "step", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_size"))
        placed = rows.join(counts, ["phase", "step"]).withColumn("block_id", F.col("_before") + F.col("pos")).drop("_before", "step")
    else:
        placed = ranked(rows, hash_digits(salt, F.col("content_hash")), ("content_hash", "origin", "block")).withColumn("block_id", F.col("_rank") - 1).drop("_rank")
    out = placed.withColumn("step", F.floor(F.col("block_id") / size))
    return (out.where((F.col("step") + 1) * size <= F.col("_size")) if whole else out).drop("_size")


def validation_batches(val: DataFrame, cfg: TrainConfig, batch: int) -> DataFrame:
    """Validation rows by batches, in the order of every run."""
    rows = pools(val, batch, f"valshuf:{cfg.seed}", whole=False).withColumnRenamed("step", "batch").withColumn("sample_mask", F.lit(1.0))
    rows = rows.where(F.col("batch") < cfg.val_batches) if cfg.val_batches > 0 else rows
    return rows if "ref_loss" in rows.columns else rows.withColumn("ref_loss", F.lit(None).cast("double"))


def validate(val: DataFrame, scorer: Scorer, cfg: TrainConfig, batch: int) -> DataFrame:
    """``metric, value`` of a validation pass over rows in any order."""
    return validation_metrics(validation_losses(validation_batches(val, cfg, batch), scorer))


def validation_losses(batches: DataFrame, scorer: Scorer) -> DataFrame:
    """The losses, stored, as several aggregates read them."""
    return store(with_target_loss(batches, scorer).select("batch", "origin", "origin_tag", "sample_mask", "target_loss", "ref_loss"), "validation")


def validation_metrics(rows: DataFrame) -> DataFrame:
    means = corpus_means(corpus_sums(rows, ("batch",)))
    out = validation_loss(rows).select(F.lit("val_loss").alias("metric"), F.col("val_loss").alias("value"))
    out = out.unionByName(means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in means.columns))).alias("m")).select("m.*"))
    per = loss_by_origin(rows)
    return out.unionByName(per.select(F.explode(F.array(*(F.struct(F.concat(F.lit("loss_by_origin_"), "origin", F.lit(f"/{c}")).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("target_loss", "ref_loss", "n")))).alias("m")).select("m.*"))


def chosen_rows(scored: DataFrame, cfg: TrainConfig) -> DataFrame:
    """The selected rows of a scored pool with ``sel_rank``; stored, if they
    are not the whole pool."""
    if not cfg.enable_selection:
        return scored.withColumn("sel_rank", F.col("block_id"))
    found = lambda rows: select(rows, cfg.top_k, cfg.selection_strategy, cfg.fixed_replay_ratio, cfg.seed)
    if cfg.top_k <= Numbered.LISTED:
        return store(found(scored), "selected-rows")
    # a ranking meets in one task: of many rows it gets what it ranks by alone
    ranks = found(scored.select("step", "block_id", "rho", "sample_mask", "origin_tag")).select(F.col("block_id").alias("_id"), "sel_rank")
    return store(scored.join(ranks, F.col("block_id") == F.col("_id")).drop("_id"), "selected-rows")


def marked(scored: DataFrame, chosen: DataFrame, cfg: TrainConfig) -> DataFrame:
    """The scored pool with ``selected``. Marks are ``top_k`` rows at most, and
    come to the pool unless that is more than a step may list."""
    marks = chosen.select("block_id", F.lit(True).alias("_sel"))
    out = scored.join(F.broadcast(marks) if cfg.top_k <= Numbered.LISTED else marks, "block_id", "left")
    return out.withColumn("selected", F.coalesce("_sel", F.lit(False))).drop("_sel")


class Numbered:
    """Training rows by dense numbers, written once a run and clustered by
    them; an epoch is an order of the numbers.

    Numbers follow a salted hash, or the curriculum. A step computes the numbers
    of its rows (:class:`EpochOrder`) and reads these alone: folders of
    PART_ROWS numbers are pruned by name, row groups by the numbers' range. No
    epoch is sorted, shuffled or written.

    The numbers of a pool of up to LISTED rows are a table that tasks get by
    broadcast. Those of a larger one are never listed: the driver goes through
    them LISTED at a time, for the folders that they lie in, and tasks compute
    each row's position from its number and keep those of the step."""

    PART_ROWS = 1 << 16
    LISTED = 1 << 16

    def __init__(self, rows: DataFrame, cfg: TrainConfig):
        spark, self.cfg = rows.sparkSession, cfg
        base = kept(rows, "training-rows")
        placed = pools(base, 1, None if cfg.curriculum else f"order:{cfg.seed}", whole=False).drop("step").withColumnRenamed("block_id", "_number")
        placed = placed.withColumn("_part", F.floor(F.col("_number") / self.PART_ROWS).cast("int"))
        self.spark, self.path = spark, new_path(spark, "numbered")
        self.schema = placed.drop("_part").schema
        placed.repartitionByRange(F.col("_number")).sortWithinPartitions("_number").write.partitionBy("_part").parquet(self.path)
        if base is not rows:
            drop(base)
        self.table = spark.read.schema(placed.schema).parquet(self.path)
        self.n = self.table.count()
        self.steps = self.n // cfg.pool_size

    def order(self, epoch: int) -> EpochOrder:
        cfg = self.cfg
        return EpochOrder(self.n, f"epoch:{cfg.seed}:{epoch}" if cfg.shuffle and not cfg.curriculum else None, cfg.shuffle_chunk)

    def pool(self, epoch: int, step: int) -> DataFrame:
        """The rows of a step with ``step`` and their position ``block_id``."""
        order, start, end = self.order(epoch), step * self.cfg.pool_size, (step + 1) * self.cfg.pool_size
        parts, least, most = set(), self.n, -1
        for k in range(start, end, self.LISTED):
            positions = np.arange(k, min(k + self.LISTED, end))
            numbers = order.numbers(positions)
            parts.update(np.unique(numbers // self.PART_ROWS).tolist())
            least, most = min(least, int(numbers.min())), max(most, int(numbers.max()))
        own = self.table.where(F.col("_part").isin(sorted(parts)) & F.col("_number").between(least, most))
        if end - start <= self.LISTED:
            at = self.spark.createDataFrame(pa.table({"_at": numbers, "block_id": positions}))
            rows = own.join(F.broadcast(at), F.col("_number") == F.col("_at")).drop("_number", "_part", "_at")
        else:
            position = F.pandas_udf(lambda n: pd.Series(order.positions(n.to_numpy())), "long")
            rows = own.withColumn("block_id", position("_number")).where(F.col("block_id").between(start, end - 1)).drop("_number", "_part")
        return rows.withColumn("sample_mask", F.lit(1.0)).withColumn("step", F.lit(step).cast("long"))

    def drop(self) -> None:
        delete(self.spark, self.path)


class RunLog:
    """What a run puts out: traces, metrics, model and state, one commit for all.

    Steps write their trace and metrics into folders of their own; ``save`` puts
    the model beside them and names all in one manifest, with the state that
    they lead to. What a lost run wrote after its last commit is never read; the
    run that goes on does these steps again and clears it away."""

    def __init__(self, spark: SparkSession, path: str | None, scorer: Scorer):
        self.spark, self.scorer = spark, scorer
        self.log = CommitLog(spark, path) if path else None
        last = self.log.last() if self.log else None
        self.number = last[0] if last else 0
        self.pending: dict[str, list[str]] = {}
        if self.log:
            self.log.vacuum()

    def _folder(self, kind: str, at: int) -> str:
        name = self.log.new(kind, at)
        self.pending.setdefault(kind, []).append(name)
        return self.log.place(name)

    def metrics(self, at: int, *rows: DataFrame) -> None:
        if self.log:
            reduce(DataFrame.unionByName, rows).coalesce(1).write.parquet(self._folder("metrics", at))

    def trace(self, at: int, rows: DataFrame) -> None:
        if self.log:
            append_trace(rows, self._folder("trace", at))

    def save(self, state: State) -> None:
        if not self.log:
            return
        last = self.log.last()
        if last and not self.pending and last[1]["state"] == asdict(state):
            return
        if hasattr(self.scorer, "save"):
            self.scorer.save(self.spark, self._folder("model", state.total_steps))
        self.number = self.log.commit({**self.pending, "state": asdict(state)}, self.number)
        self.pending = {}


def run_trace(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The trace of a run as of a commit, the last one by default."""
    found = CommitLog(spark, path).snapshot("trace", upto)
    return spark.read.schema(TRACE_SCHEMA).json(found) if found else spark.createDataFrame([], TRACE_SCHEMA)


def run_metrics(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The metrics of a run as of a commit, the last one by default."""
    found = CommitLog(spark, path).snapshot("metrics", upto)
    return spark.read.schema(METRIC_SCHEMA).parquet(*found) if found else spark.createDataFrame([], METRIC_SCHEMA)


def train_loop(rows: DataFrame, val: DataFrame | None, scorer: Scorer, cfg: TrainConfig, state: State | None = None, out: str | None = None) -> State:
    """Runs steps until the rows, ``max_steps``, ``max_epochs`` or the time end.

    A step's pool is scored once and stored while the step lasts, and so are
    the rows selected of it: what counts them, learns from them and writes
    metrics and trace are short plans over files. The driver thus never holds
    a scorer's plan more than once, nor within the plans of what follows; after
    each step it lets go of that step's plans, with their shuffle files and
    broadcasts on all machines. A pool without a usable candidate is passed over: it
    counts as a step of the epoch, but neither in the total nor as consumed.

    ``out`` gets a commit (:class:`RunLog`) every ``save_period`` steps and at
    the end. Tables that the loop needs are removed when it ends.
    """
    spark = rows.sparkSession
    state, began = state or State(), time.time()
    if cfg.enable_selection and "ref_loss" not in rows.columns:
        raise RuntimeError("selection needs ref_loss")
    rows = rows if "ref_loss" in rows.columns else rows.withColumn("ref_loss", F.lit(None).cast("double"))
    log = RunLog(spark, out, scorer)
    forget = getattr(scorer, "forget", lambda: None)
    numbered, batches = Numbered(rows, cfg), None
    release(spark)

    def check(step: int) -> None:
        if batches is not None:
            losses = validation_losses(batches, scorer)
            try:
                log.metrics(step, validation_metrics(losses).select(F.lit(step).cast("long").alias("step"), F.lit("validation").alias("prefix"), "metric", "value"))
            finally:
                drop(losses)
                forget()

    try:
        if val is not None:
            base = kept(val, "validation-rows")
            batches = store(validation_batches(base, cfg, cfg.top_k), "validation-batches")
            if base is not val:
                drop(base)
        if cfg.val_at_start and state.total_steps == 0:
            check(0)
        while state.epoch < cfg.max_epochs:
            while state.step < numbered.steps:
                step_began = time.time()
                scored, chosen = store(with_rho(with_target_loss(numbered.pool(state.epoch, state.step), scorer)), "scored-pool"), None
                try:
                    forget()
                    chosen = chosen_rows(scored, cfg)
                    usable_rows, tokens = chosen.agg(F.count("*"), F.coalesce(F.sum(F.size("token_ids")), F.lit(0))).first()
                    if not usable_rows and cfg.enable_selection:
                        usable_rows = scored.where(usable()).count()
                    if usable_rows:
                        scorer.update(chosen)
                        state.total_steps += 1
                        state.total_valid_tokens += tokens
                        state.consumed_samples += cfg.pool_size
                        at = F.lit(state.total_steps).cast("long")
                        rate = tokens / max(time.time() - step_began, 1e-9) / cfg.devices
                        log.metrics(state.total_steps, spark.createDataFrame([(state.total_steps, "timing", "valid_tokens_per_sec_per_gpu", rate)], METRIC_SCHEMA), *(step_metrics(marked(scored, chosen, cfg).withColumn("step", at), cfg, state.total_steps) if cfg.enable_selection else ()))
                        if cfg.log_selected:
                            log.trace(state.total_steps, trace_rows(chosen.withColumn("step", at), cfg.log_selected_period))
                finally:
                    drop(scored)
                    if chosen is not None:
                        drop(chosen)
                    forget()
                    release(spark)
                state.step += 1
                late = cfg.timeout_s is not None and time.time() - began > cfg.timeout_s
                full = cfg.max_steps is not None and state.total_steps >= cfg.max_steps
                last = full or state.step == numbered.steps and state.epoch == cfg.max_epochs - 1
                if usable_rows and (last or cfg.val_period and state.total_steps % cfg.val_period == 0):
                    check(state.total_steps)
                if last or late or cfg.save_period and state.total_steps % cfg.save_period == 0:
                    log.save(state)
                if late or full:
                    return state
            state.epoch, state.step = state.epoch + 1, 0
        log.save(state)
        return state
    finally:
        numbered.drop()
        if batches is not None:
            drop(batches)


def step_metrics(pool: DataFrame, cfg: TrainConfig, step: int) -> list[DataFrame]:
    """Long rows of what a step logs; the rich ones in every so many steps."""
    origins = by_origin(pool)
    out = [long_table(selection_metrics(pool)), long_table(score_metrics(pool), "score"), _named(origins, "selection_by_origin", ("n_candidate", "n_selected", "frac_selected"))]
    if step % max(cfg.rich_log_period, 1) == 0:
        out += [_named(origins, "rho_by_origin", ("rho_mean", "frac_above_zero")), _named(rho_percentiles(pool), "rho_dist", ("p10", "p50", "p90", "p99"))]
    return out


def load_state(spark: SparkSession, path: str) -> State | None:
    """The state of a run's last commit; none before the first."""
    found = CommitLog(spark, path).last()
    return State(**found[1]["state"]) if found else None


def resume(spark: SparkSession, path: str, scorer: Scorer) -> State | None:
    """The last commit's state, its model loaded into ``scorer``."""
    log = CommitLog(spark, path)
    found = log.last()
    if found and found[1].get("model") and hasattr(scorer, "load"):
        scorer.load(spark, log.place(found[1]["model"][-1]))
    return State(**found[1]["state"]) if found else None


def _named(table: DataFrame, family: str, columns: tuple[str, ...]) -> DataFrame:
    """Long rows ``family/corpus[/origin]/column``."""
    where = ["corpus", "origin"] if "origin" in table.columns else ["corpus"]
    pairs = F.explode(F.array(*(F.struct(F.concat_ws("/", F.lit(family), *where, F.lit(c.replace("rho_mean", "mean"))).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
    return table.select("step", F.lit("train").alias("prefix"), pairs.alias("_m")).select("step", "prefix", "_m.*")
