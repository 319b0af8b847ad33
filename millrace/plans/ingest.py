"""Raw text to a blocks table, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokenizers
from millrace.functions.arrays import with_bos, word_tokens
from millrace.operators.packing import pack, pack_more, tag
from millrace.operators.pretokens import tokens_by_dictionary
from millrace.operators.sampling import balance_replay, cap_blocks, first_documents, report, sample_documents, split_holdout
from millrace.plans.config import IngestConfig
from millrace.sources.commits import CommitLog
from millrace.sources.corpus import file_states, read_documents, write_blocks
from millrace.sources.shared import store


def documents(spark: SparkSession, cfg: IngestConfig, adapt: bool, files: list[str] | None = None) -> DataFrame:
    """One domain's documents after sampling and limits, before tokenization."""
    glob, domain, fraction, most = (cfg.adapt_glob, cfg.adapt_domain, cfg.adapt_doc_fraction, cfg.max_docs_adapt) if adapt else (cfg.replay_glob, cfg.replay_domain, cfg.replay_doc_fraction, cfg.max_docs_replay)
    docs = read_documents(spark, glob, domain, cfg.per_subset, cfg.origin_map, cfg.text_column, files).withColumn("domain", F.lit(domain))
    docs = sample_documents(docs.withColumn("_key", F.concat_ws(":", "part", "doc")), fraction, cfg.seed, "_key").drop("_key")
    return first_documents(docs, most)


def blocks_of(docs: DataFrame, cfg: IngestConfig, tokenizer: Callable[[Column], Column] = word_tokens, byte_lengths: Callable[[Column], Column] | None = None) -> DataFrame:
    """Blocks of (domain, origin, part, doc, text), capped and split. With a
    decoder's ``byte_lengths`` they know how many bytes their text has."""
    return chosen(tagged(pack(tokenized(docs, cfg, tokenizer), cfg.block_size, cfg.eod_id), cfg, byte_lengths), cfg)


def tokenized(docs: DataFrame, cfg: IngestConfig, tokenizer: Callable[[Column], Column]) -> DataFrame:
    if cfg.by_dictionary:
        if not (cfg.tokenizer or "").endswith(".json"):
            raise ValueError("a dictionary of pre-tokens needs a tokenizer file of kind .json")
        return tokens_by_dictionary(docs, cfg.tokenizer).withColumn("tokens", with_bos(F.col("tokens"), cfg.bos_id))
    return docs.select("domain", "origin", "part", "doc", with_bos(tokenizer(F.col("text")), cfg.bos_id).alias("tokens"))


def tagged(packed: DataFrame, cfg: IngestConfig, byte_lengths: Callable[[Column], Column] | None) -> DataFrame:
    """Packed blocks with what is known of each by itself."""
    spark = packed.sparkSession
    capabilities = spark.createDataFrame(sorted(cfg.capability_map.items()), "origin string, capability string") if cfg.capability_map else None
    n_bytes = None if byte_lengths is None else byte_lengths(F.col("token_ids"))
    return store(tag(packed, cfg.adapt_domain, None if capabilities is None else F.broadcast(capabilities), n_bytes), "blocks")


def chosen(rows: DataFrame, cfg: IngestConfig) -> DataFrame:
    """The blocks that caps and balance leave, with their split: what depends
    on all the blocks of an origin or domain."""
    rows = cap_blocks(rows, cfg.max_blocks_per_origin, cfg.seed, ("domain", "origin"))
    for domain, own in ((cfg.adapt_domain, cfg.max_blocks_adapt), (cfg.replay_domain, cfg.max_blocks_replay)):
        cap = own if own is not None else cfg.max_blocks_per_domain
        if cap:
            rows = cap_blocks(rows.where(F.col("domain") == domain), cap, cfg.seed, ("domain",)).unionByName(rows.where(F.col("domain") != domain))
    rows = split_holdout(rows, cfg.holdout_fraction, cfg.seed, cfg.holdout_floor)
    return balance_replay(rows, cfg.seed) if cfg.balance_replay else rows


def assert_disjoint(docs: DataFrame) -> None:
    """Origins must not be shared by domains: hashes don't hold the domain."""
    both = docs.select("domain", "origin").distinct().groupBy("origin").count().where("count > 1").limit(5).collect()
    if both:
        raise ValueError(f"origins in more than one domain: {sorted(r['origin'] for r in both)}")


def build_corpus(spark: SparkSession, cfg: IngestConfig) -> DataFrame:
    """Writes the blocks table to ``cfg.out`` and returns its report. Texts go
    through the tokenizer file, or the built-in word hash where none is given,
    which has no decoder and so leaves ``n_bytes`` null."""
    docs = documents(spark, cfg, True).unionByName(documents(spark, cfg, False))
    assert_disjoint(docs)
    encode, lengths = _coder(cfg)
    write_blocks(blocks_of(docs, cfg, encode, lengths), cfg.out, cfg.shard_rows, cfg.buckets)
    return report(spark.read.parquet(cfg.out))


def _coder(cfg: IngestConfig) -> tuple[Callable[[Column], Column], Callable[[Column], Column] | None]:
    return (word_tokens, None) if cfg.tokenizer is None else (tokenizers.tokenizer(cfg.tokenizer), tokenizers.byte_lengths(cfg.tokenizer))


#: Settings that what was packed depends on.
_FIXED = ("adapt_glob", "replay_glob", "adapt_domain", "replay_domain", "block_size", "eod_id", "bos_id", "tokenizer", "seed", "adapt_doc_fraction", "replay_doc_fraction", "per_subset", "origin_map", "capability_map", "text_column")


def ingest_more(spark: SparkSession, cfg: IngestConfig, log_path: str) -> int | None:
    """Packs the files that have come since the last commit under ``log_path``
    and commits them; the commit's number, or none if no file is new.

    One manifest names the new files, their blocks and the tails that wait for
    more, so a run that dies leaves nothing of itself. New files are packed
    behind the old ones, in their own order. A packed file that has changed, and
    settings other than the first run's, are errors, as packed blocks stay.
    Limits on documents count from the start, so they can't be used here."""
    if cfg.max_docs_adapt or cfg.max_docs_replay:
        raise ValueError("limits on documents don't go with ingestion in steps")
    log, settings = CommitLog(spark, log_path), {k: getattr(cfg, k) for k in _FIXED}
    last = log.last()
    if last and last[1]["settings"] != settings:
        raise ValueError(f"settings differ from those of the first run: {sorted(k for k in _FIXED if last[1]['settings'].get(k) != settings[k])}")
    states = file_states(spark, cfg.adapt_glob).withColumn("adapt", F.lit(True)).unionByName(file_states(spark, cfg.replay_glob).withColumn("adapt", F.lit(False)))
    if last:
        known = spark.read.schema(states.schema).parquet(*log.snapshot("files"))
        both = states.join(known.select("path", "adapt", F.struct("length", "time").alias("_was")), ["path", "adapt"], "left")
        changed = [r["path"] for r in both.where(F.col("_was").isNotNull() & (F.col("_was") != F.struct("length", "time"))).limit(5).collect()]
        if changed:
            raise ValueError(f"files have changed since they were packed: {changed}")
        states = both.where(F.col("_was").isNull()).drop("_was")
    states = store(states, "files")
    new = {adapt: sorted(r["path"] for r in states.where(F.col("adapt") == adapt).select("path").collect()) for adapt in (True, False)}
    if not any(new.values()):
        return None
    docs = [documents(spark, cfg, adapt, files) for adapt, files in new.items() if files]
    docs = docs[0] if len(docs) == 1 else docs[0].unionByName(docs[1])
    encode, lengths = _coder(cfg)
    tails = spark.read.parquet(log.place(last[1]["tails"][0])) if last else None
    origins = docs.select("domain", "origin")
    assert_disjoint(origins if tails is None else origins.unionByName(tails.select("domain", "origin")))
    full, waiting = pack_more(tokenized(docs, cfg, encode), tails, cfg.block_size, cfg.eod_id)
    at = last[0] if last else 0
    named = {kind: log.new(kind, at + 1) for kind in ("files", "blocks", "tails")}
    for kind, rows in (("files", states), ("blocks", tagged(full, cfg, lengths)), ("tails", waiting)):
        rows.write.parquet(log.place(named[kind]))
    return log.commit({"settings": settings, **{kind: [name] for kind, name in named.items()}}, at if last else None)


def packed_blocks(spark: SparkSession, log_path: str, upto: int | None = None) -> DataFrame:
    """All blocks that were committed, or those as of a commit."""
    return spark.read.parquet(*CommitLog(spark, log_path).snapshot("blocks", upto))


def publish(spark: SparkSession, cfg: IngestConfig, log_path: str) -> DataFrame:
    """Writes the blocks table of all that was committed to ``cfg.out`` and
    returns its report. Texts aren't touched: caps and splits are found anew
    from the blocks, on all of which they depend."""
    write_blocks(chosen(packed_blocks(spark, log_path), cfg), cfg.out, cfg.shard_rows, cfg.buckets)
    return report(spark.read.parquet(cfg.out))
