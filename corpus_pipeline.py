"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

``run`` applies STAGES to ``documents``; what a stage returns is written as
Parquet in the shared folder and read again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``; the last returns, of
each document that the mix takes, its id, source, size and taken words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, mixing, quality_crf, simhash_dedup
from millrace.llm.shared import store, table

#: Five-word shingles, a similarity of 0.8 or more, and segments for up to
#: thirty million distinct documents: eighteen of 20 bits in six words.
NEAR = simhash_dedup.near_scheme(30_000_000, least=0.8, shingle=5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the line labels reject."""
    model = quality_crf.train(quality_crf.training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality_crf.judged_rows(docs, model).where("_quality.kept").select("_row.*")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated three-line passages out of the texts; documents that
    consist of such alone go."""
    told = line_dedup.deduped(docs)
    told = told.where((F.col("_lines.n_removed") == 0) | F.col("_lines.text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_lines.text"), "n_chars": F.when(F.col("_lines.n_removed") == 0, F.col("_row.n_chars")).otherwise(F.length("_lines.text").cast("long")) if "n_chars" in docs.columns else None}
    return told.select(*(new[c].alias(c) if new.get(c) is not None else F.col("_row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.keep_one(docs, NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many of their words."""
    return mixing.mix(docs).where("taken > 0").select("doc_id", F.get("sources", F.lit(0)).alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
]

#: The CRF, the fingerprints and the benchmark windows are beyond SQL; the
#: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
