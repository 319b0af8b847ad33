"""Scorers: models that give per-token log-probabilities.

The built-in one is a smoothed unigram count model, a stand-in for a neural
language model; any object with the same two methods plugs in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import shifted, target_loss

#: Largest vocabulary whose counts are held by every task.
MAX_VOCABULARY = 1 << 20


class Scorer(Protocol):
    """A scorer that learns may also have ``save(spark, path)`` and
    ``load(spark, path)``; a commit then holds its model. One that stores what
    it scores has ``forget()``, called once a step's rows were read."""

    def logprobs(self, blocks: DataFrame) -> DataFrame:
        """``blocks`` with ``token_logprobs``: one per token of ``token_ids``."""

    def update(self, selected: DataFrame) -> None:
        """Learn from the selected blocks."""


def token_counts(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.explode("token_ids").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


class UnigramScorer:
    """Add-one smoothed unigram model over token ids below ``vocabulary``."""

    def __init__(self, vocabulary: int, blocks: DataFrame | None = None):
        if vocabulary > MAX_VOCABULARY:
            raise ValueError(f"vocabulary of more than {MAX_VOCABULARY} tokens")
        self.counts = np.zeros(vocabulary, dtype=np.int64)
        if blocks is not None:
            self.update(blocks)

    def copy(self) -> UnigramScorer:
        out = UnigramScorer(len(self.counts))
        out.counts = self.counts.copy()
        return out

    def update(self, selected: DataFrame) -> None:
        found = token_counts(selected).where(F.col("token").between(0, len(self.counts) - 1)).toPandas()
        np.add.at(self.counts, found["token"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64))

    def save(self, spark: SparkSession, path: str) -> None:
        there = np.flatnonzero(self.counts)
        rows = pd.DataFrame({"token": there, "n": self.counts[there]})
        spark.createDataFrame(rows, "token int, n long").coalesce(1).write.parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        found = spark.read.schema("token int, n long").parquet(path).toPandas()
        self.counts[:] = 0
        self.counts[found["token"].to_numpy()] = found["n"].to_numpy()

    def logprobs(self, blocks: DataFrame) -> DataFrame:
        table = np.log((self.counts + 1.0) / (self.counts.sum() + len(self.counts)))

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield part.map(lambda ids: table[np.asarray(ids, dtype=np.int64)])

        return blocks.withColumn("token_logprobs", score("token_ids"))


class FixedScorer:
    """Log-probabilities by an expression over each token id; it never learns."""

    def __init__(self, logprob: Callable[[Column], Column]):
        self.logprob = logprob

    def update(self, selected: DataFrame) -> None:
        pass

    def logprobs(self, blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("token_logprobs", F.transform("token_ids", self.logprob))


class OnnxScorer:
    """A causal language model in an ONNX file, readable at the same path on
    every machine; it is scored with and never learns.

    The model takes token ids (batch, length) and gives logits (batch, length,
    vocabulary), of which those at a token tell the next one. Blocks of one
    length run together, ``batch`` at a time, one by default: a block of 4,096
    tokens and 131,072 ids already has 2 GB of logits. Each worker loads the
    file once."""

    def __init__(self, path: str, batch: int = 1):
        self.path, self.batch = path, batch

    def update(self, selected: DataFrame) -> None:
        pass

    def logprobs(self, blocks: DataFrame) -> DataFrame:
        path, batch = self.path, self.batch

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                rows = [np.asarray(ids, dtype=np.int64) for ids in part]
                out: list = [np.zeros(len(ids)) for ids in rows]
                by_length = sorted(range(len(rows)), key=lambda i: len(rows[i]))
                for n, same in groupby(by_length, key=lambda i: len(rows[i])):
                    some = list(same) if n > 1 else []
                    for k in range(0, len(some), batch):
                        for i, found in zip(some[k : k + batch], _next_logprobs(path, np.stack([rows[i] for i in some[k : k + batch]]))):
                            out[i][1:] = found
                yield pd.Series(out, index=part.index)

        return blocks.withColumn("token_logprobs", score("token_ids"))


@lru_cache(maxsize=2)
def _session(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


#: Logits that are raised at a time: 64 MB in single precision.
RAISED = 1 << 24


def _next_logprobs(path: str, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each token but the first, given those before it.
    Logits stay in the model's precision and are summed by slices of positions,
    so that no second array of their size is made."""
    model = _session(path)
    logits = model.run(None, {model.get_inputs()[0].name: ids})[0][:, :-1]
    own = np.take_along_axis(logits, ids[:, 1:, None], axis=2)[..., 0].astype(np.float64)
    out = np.empty(own.shape)
    width = max(1, RAISED // max(1, logits.shape[0] * logits.shape[2]))
    for k in range(0, logits.shape[1], width):
        part = logits[:, k : k + width].astype(np.float32)
        top = part.max(axis=2, keepdims=True)
        part -= top
        np.exp(part, out=part)
        out[:, k : k + width] = own[:, k : k + width] - top[..., 0] - np.log(part.sum(axis=2, dtype=np.float64))
    return out


def with_target_loss(blocks: DataFrame, scorer: Scorer) -> DataFrame:
    """``target_loss`` over all tokens that have one before them; padding rows
    (sample_mask 0) get 0."""
    rows = blocks if "sample_mask" in blocks.columns else blocks.withColumn("sample_mask", F.lit(1.0))
    scored = scorer.logprobs(rows)
    ones = F.transform(shifted(F.col("token_ids")), lambda _: F.lit(1.0))
    loss = target_loss(shifted(F.col("token_logprobs")), ones, F.col("sample_mask").cast("double"))
    return scored.withColumn("target_loss", loss).drop("token_logprobs")


def with_rho(scored: DataFrame, missing_ok: bool = False) -> DataFrame:
    """``rho``: target loss less reference loss (0 where missing is allowed)."""
    ref = F.coalesce("ref_loss", F.lit(0.0)) if missing_ok else F.col("ref_loss")
    return scored.withColumn("rho", F.col("target_loss") - ref)
