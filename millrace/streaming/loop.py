"""The selection loop as a stream: each micro-batch is a scored pool or more.

Pools arrive as Parquet files (step, block_id, content_hash, origin,
origin_tag, sample_mask, target_loss, ref_loss). :func:`run` takes files that
hold whole steps; :func:`run_scattered` takes rows in any files and order, and
gathers each step in keyed state until its last row has come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.curriculum import trace_rows
from millrace.operators.metrics import long_table, selection_metrics
from millrace.operators.scoring import with_rho
from millrace.operators.selection import flagged, select

#: Kept in the state of a step: its rows until they are released.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
POOL_SCHEMA = "step long, block_id long, content_hash string, origin string, origin_tag int, sample_mask double, target_loss double, ref_loss double"
POOL_COLUMNS = [c.split()[0] for c in POOL_SCHEMA.split(", ")]


def run(spark: SparkSession, pools: str, out: str, checkpoint: str, k: int, strategy: str = "top_k", ratio: float = 0.25, seed: int = 42, files_per_trigger: int = 1) -> StreamingQuery:
    """Selects from the pools that are there and stops; started again it goes
    on after the last finished micro-batch.

    Each micro-batch overwrites its own folder of trace and metrics, so one
    that is done again after a failure leaves no second copy.
    """
    source = spark.readStream.schema(POOL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(pools)
    return _write(source, _selecting(out, k, strategy, ratio, seed), checkpoint)


def _selecting(out: str, k: int, strategy: str, ratio: float, seed: int) -> Callable[[DataFrame, int], None]:
    def step(batch: DataFrame, batch_id: int) -> None:
        pool = with_rho(batch).persist()
        try:
            chosen = select(pool, k, strategy, ratio, seed)
            trace_rows(chosen).write.mode("overwrite").parquet(f"{out}/trace/batch={batch_id}")
            long_table(selection_metrics(flagged(pool, chosen))).write.mode("overwrite").parquet(f"{out}/metrics/batch={batch_id}")
        finally:
            pool.unpersist()

    return step


def _write(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Gather(StatefulProcessor):
    """Holds a step's rows until ``step_rows`` of them have come, then gives
    them all and forgets them; what comes of a step that was given is a second
    delivery and is dropped. State is as large as the steps that are open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", POOL_SCHEMA)
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        size = None
        for part in rows:
            if seen < 0:
                continue
            size = int(part["step_rows"].iloc[0])
            # a row may come twice as well
            self.rows.appendList([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in part.drop(columns="step_rows").itertuples(index=False, name=None)])
            seen += len(part)
        if size is not None:
            held = pd.DataFrame(list(self.rows.get()), columns=POOL_COLUMNS).drop_duplicates("block_id")
            if len(held) >= size:
                self.rows.clear()
                self.seen.update((-1,))
                yield held
            else:
                self.seen.update((seen,))

    def close(self) -> None:
        pass


def run_scattered(spark: SparkSession, pools: str, out: str, checkpoint: str, k: int, strategy: str = "top_k", ratio: float = 0.25, seed: int = 42, files_per_trigger: int = 1) -> StreamingQuery:
    """The same over files that hold rows of many steps, and steps that lie in
    many files. Rows also have ``step_rows``, how many rows their step has; a
    step is selected from in the micro-batch that brings its last one. Open
    steps are in the checkpoint: a stopped run goes on with what it held."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    source = spark.readStream.schema(f"{POOL_SCHEMA}, step_rows int").option("maxFilesPerTrigger", files_per_trigger).parquet(pools)
    whole = source.groupBy("step").transformWithStateInPandas(Gather(), POOL_SCHEMA, "Append", "None")
    return _write(whole, _selecting(out, k, strategy, ratio, seed), checkpoint)


def consumed(trace: DataFrame, pool_size: int) -> DataFrame:
    """Candidates consumed up to each step: pools, not selected rows."""
    from pyspark.sql.window import Window

    return trace.select("step").distinct().withColumn("consumed_samples", F.row_number().over(Window.orderBy("step")) * pool_size)
