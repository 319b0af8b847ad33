"""A query per operator over the test tables; their SQL is in ``sql``.

Stand-ins: German documents are the adaptation corpus, all others the replay
corpus; language and source name the origin; ``events`` serve as scored
candidates in whole milli-units, so that sums are exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, names
from millrace.functions.permutation import EpochOrder
from millrace.operators import cache as caching
from millrace.operators import collate, curriculum, merge, metrics, mixer, packing, sampling, selection, validation
from millrace.operators.ngram import NgramScorer
from millrace.operators.scoring import FixedScorer, token_counts, with_rho, with_target_loss
from millrace.plans.config import IngestConfig, TrainConfig
from millrace.plans.precompute import precompute
from millrace.plans.train import load_state, pools, resume, run_metrics, run_trace, train_loop, validate
from millrace.sources import corpus
from millrace.sources.shared import drop, new_path, release, store

BLOCK, EOD, SEED, POOL, K = 64, 2, 42, 64, 16
ADAPT = "german"

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; those of fewer files than cores are dealt out, as a file
    of one row group is a single task."""
    found, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and len(found.inputFiles()) < cores else found


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null and text <> ''")
    return docs.select("doc_id", F.when(F.col("lang") == "de", ADAPT).otherwise("general").alias("domain"), F.concat_ws("_", "lang", "source").alias("origin"), F.lit("").alias("part"), F.col("doc_id").alias("doc"), "text")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "domain", "origin", "part", "doc", arrays.word_tokens(F.col("text")).alias("tokens"))


def capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as capabilities; Spanish origins have none and keep their name."""
    found = table(spark, sf, "documents").select(F.concat_ws("_", "lang", "source").alias("origin"), "lang").distinct()
    return found.where("lang in ('de', 'en', 'fr')").select("origin", F.concat(F.lit("cap_"), "lang").alias("capability"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks table; stored, so that what reads it twice packs once. What
    packing left is let go of."""
    packed = packing.pack(tokens(spark, sf), BLOCK, EOD)
    out = store(packing.tag(packed, ADAPT, capabilities(spark, sf)), "blocks")
    drop(packed)
    release(spark)
    return out


def split(rows: DataFrame) -> DataFrame:
    return sampling.split_holdout(rows, 0.05, SEED, 3)


def cache(rows: DataFrame) -> DataFrame:
    """A cache of two files: nine in ten blocks, then one in ten again, half of
    these with another loss."""
    digit = lambda salt: F.conv(F.substring(F.sha2(F.concat(F.lit(salt), "content_hash"), 256), 1, 8), 16, 10).cast("long")
    rows = rows.select("content_hash", (digit("loss:") % 4000 / 1000).cast("double").alias("ref_loss"), digit("cov:").alias("_c"), F.concat_ws("/", "domain", "origin").alias("_o"), F.col("block").alias("row"))
    first = rows.where("_c % 10 < 9").select("content_hash", "ref_loss", F.concat(F.lit("f0/"), "_o").alias("part"), "row")
    again = rows.where("_c % 10 = 0").select("content_hash", (F.col("ref_loss") + F.when(F.col("_c") % 20 == 0, 0.5).otherwise(0.0)).alias("ref_loss"), F.concat(F.lit("f1/"), "_o").alias("part"), "row")
    return first.unionByName(again)


def fixed() -> FixedScorer:
    """Losses in whole numbers: an id's remainder stands for its loss."""
    return FixedScorer(lambda t: -(t % 7).cast("double"))


def with_reference(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ref_loss", (F.get("token_ids", F.lit(0)) % 5).cast("double"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(
        F.col("event_id").alias("block_id"), F.floor(F.col("event_id") / POOL).alias("step"), F.col("event_type").alias("origin"), F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"),
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(1).alias("origin_tag"), F.when(F.col("event_id") % 17 == 0, 0.0).otherwise(1.0).alias("sample_mask"),
        F.floor(F.col("value") * 1000).cast("double").alias("target_loss"), (F.col("user_id") % 50 * 1000).cast("double").alias("ref_loss"),
    )
    return with_rho(rows)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = pool(spark, sf)
    return selection.flagged(rows, selection.select(rows, K))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Ten rows of a step at a time, steps coming round again, over files that
    end within a step."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("i"))
    return e.select(F.lit(0).alias("phase"), F.format_string("f%05d", F.floor(F.col("i") / 3005)).alias("file"), (F.col("i") % 3005).alias("line"), (F.floor(F.col("i") / 10) % 40).alias("step"), F.sha2(F.col("i").cast("string"), 256).alias("content_hash"))


def listed(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


BLOCK_KEY = ("domain", "origin", "block")


@query
def tokenize(spark, sf):
    return tokens(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), listed("tokens"))


@query
def tokenize_bos(spark, sf):
    return tokens(spark, sf).withColumn("tokens", arrays.with_bos(F.col("tokens"), 1)).select("doc_id", listed("tokens"))


@query
def pack_blocks(spark, sf):
    return packing.pack(tokens(spark, sf), BLOCK, EOD).select(*BLOCK_KEY, listed("token_ids"))


@query
def pack_blocks_keep_partial(spark, sf):
    return packing.pack(tokens(spark, sf), BLOCK, EOD, True).select(*BLOCK_KEY, F.size("token_ids").cast("long").alias("n_tokens"), listed("token_ids"))



@query
def pack_in_steps(spark, sf):
    """Documents that come in three parts, by id: each is packed behind what
    the parts before it left over."""
    docs = tokens(spark, sf)
    most, out, tails = docs.agg(F.max("doc_id")).first()[0] or 0, None, None
    for low, high in ((None, most // 3), (most // 3, most // 2), (most // 2, None)):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        full, tails = packing.pack_more(part if high is None else part.where(F.col("doc_id") <= high), tails, BLOCK, EOD)
        tails = store(tails, "tails")
        out = full if out is None else out.unionByName(full)
    return out.select(*BLOCK_KEY, listed("token_ids"))


@query
def content_hashes(spark, sf):
    return blocks(spark, sf).select(*BLOCK_KEY, "origin_tag", "content_hash")


@query
def block_bytes(spark, sf):
    """Byte counts with a decoder: here ids joined by blanks."""
    text = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return packing.tag(packing.pack(tokens(spark, sf), BLOCK, EOD), ADAPT, n_bytes=F.octet_length(text)).select(*BLOCK_KEY, "n_bytes")


@query
def capability_tag(spark, sf):
    return blocks(spark, sf).groupBy("origin", "capability").agg(F.count("*").alias("n_blocks"))


@query
def doc_sample(spark, sf):
    return sampling.sample_documents(documents(spark, sf), 0.3, SEED).select("doc_id", "domain", "origin")


@query
def max_docs_per_origin(spark, sf):
    return sampling.first_documents(documents(spark, sf), 3).select("doc_id", "domain", "origin")


@query
def holdout_split(spark, sf):
    return split(blocks(spark, sf)).select(*BLOCK_KEY, "content_hash", "split")


@query
def balance_replay(spark, sf):
    return sampling.balance_replay(split(blocks(spark, sf)), SEED).select(*BLOCK_KEY, "content_hash", "split")


@query
def cap_per_origin(spark, sf):
    return sampling.cap_per_origin(blocks(spark, sf), 20, SEED).select(*BLOCK_KEY, "content_hash")


@query
def cap_per_domain(spark, sf):
    rows = sampling.cap_blocks(blocks(spark, sf), 30, SEED, ("domain", "origin"))
    return sampling.cap_blocks(rows, 400, SEED, ("domain",)).select(*BLOCK_KEY, "content_hash")


@query
def corpus_report(spark, sf):
    return sampling.report(split(blocks(spark, sf)))


@query
def clean_origin(spark, sf):
    raw = table(spark, sf, "documents").select(F.concat(F.element_at(F.array(*map(F.lit, ("Nemotron-CC-", "nemotron-", " Some ", "Nemotron-Pretraining-Legal-"))), (F.col("doc_id") % 4 + 1).cast("int")), "lang", F.lit("--"), "source", F.lit("_")).alias("name"))
    return raw.distinct().select("name", names.clean_origin(F.col("name")).alias("origin"))


@query
def metric_names(spark, sf):
    raw = table(spark, sf, "part").select("p_name", (F.col("p_partkey") % 4).cast("int").alias("tag")).distinct().withColumn("name", F.concat(F.lit(" "), "p_name", F.lit("/x y")))
    return raw.select("name", "tag", names.origin_key(F.col("name")).alias("key"), names.metric_safe(F.trim("name")).alias("safe"), names.corpus_name(F.col("tag")).alias("corpus"))


@query
def discover_origins(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.format_string("/data/general/part_%s.parquet", F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("/data/general/"), F.upper("lang"), F.lit(" "), "source", F.lit("/a/p.parquet"))).alias("path"))
    return files.select("doc_id", corpus.origin_of(F.col("path"), "/data/general", "general", True, {"EN src1": "english_one", "DE src2": ""}).alias("origin"))


@query
def pick_spread(spark, sf):
    files = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_partkey").cast("string")).alias("files"))
    n = (F.length("p_brand") + F.size("files") % 7 - 4).cast("int")
    return files.select("p_brand", F.array_join(arrays.pick_spread(F.col("files"), n), ",").alias("chosen"))


@query
def staging_plan(spark, sf):
    part = table(spark, sf, "part")
    files = part.select(F.lit("repo").alias("repo"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 9 == 0, ".txt").otherwise(".parquet")).alias("path"))
    spec = part.select("p_brand").distinct().select(F.lower("p_brand").alias("origin"), F.lit("repo").alias("repo"), F.concat("p_brand", F.lit("/")).alias("prefix"), F.lit("parts").alias("capability"), F.lit(5).alias("n_shards"))
    plan = corpus.staging_plan(spec, files, 0.5)
    return plan.select("origin", "capability", F.col("n_available").cast("long").alias("n_available"), F.array_join("chosen", ",").alias("chosen"))


@query
def staging_copy(spark, sf):
    """Documents' files, staged in small waves by two runs, told from the copies;
    and whether all ranges of a document's file are what was copied."""
    from millrace.sources import staging

    raw, out = new_path(spark, "raw"), new_path(spark, "staged")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").parquet(raw)
    langs = sorted(r[0] for r in table(spark, sf, "documents").select("lang").distinct().collect())
    spec = [{"origin": f"docs_{x}", "repo": raw, "prefix": f"lang={x}/", "n_shards": 1 << 20} for x in langs]
    for part in (spec[:2], spec):
        staging.stage(spark, part, out, wave=1 << 20, piece=1 << 16)
    whole = staging.verify(spark, out).groupBy(F.col("target").alias("_path")).agg(F.bool_and("whole").alias("whole"), (F.sum("n") == F.first("length")).alias("covered"))
    path = F.regexp_replace(F.col("part"), "^file:/+", "/")
    docs = corpus.read_documents(spark, f"{out}/**/*.parquet", "docs")
    return docs.join(whole, path == F.regexp_replace("_path", "^file:/+", "/"), "left").select("origin", F.sha2("text", 256).alias("digest"), "whole", "covered")


@query
def ref_cache_dedup(spark, sf):
    return caching.dedup_cache(cache(blocks(spark, sf)))


@query
def cache_conflicts(spark, sf):
    return caching.conflicts(cache(blocks(spark, sf)))


@query
def join_ref_loss(spark, sf):
    rows = blocks(spark, sf)
    return caching.join_ref_loss(split(rows), caching.dedup_cache(cache(rows)), 0.2).select(*BLOCK_KEY, "content_hash", "ref_loss")


@query
def join_ref_loss_bucketed(spark, sf):
    """The same from blocks and a two-pass cache that were written by buckets."""
    rows, places = blocks(spark, sf), [new_path(spark, n) for n in ("blocks", "cache")]
    corpus.write_blocks(split(rows), places[0], buckets=8)
    for domain in ("general", ADAPT):
        precompute(rows, domain, fixed(), places[1], buckets=8)
    joined = caching.join_ref_loss(corpus.read_blocks(spark, places[0]), caching.dedup_cache(corpus.read_cache(spark, places[1])))
    return joined.select(*BLOCK_KEY, "content_hash", "split", "ref_loss")


@query
def missing_ref_loss(spark, sf):
    rows = blocks(spark, sf)
    return caching.missing(split(rows), caching.dedup_cache(cache(rows))).select(*BLOCK_KEY, "content_hash")


def mixed(spark, sf, share=1.0):
    rows = store(split(blocks(spark, sf)), "split")
    return rows, mixer.choose_domains(rows, ADAPT, share, SEED)


@query
def mix_train(spark, sf):
    rows, kept = mixed(spark, sf)
    return caching.join_ref_loss(mixer.train_rows(kept), caching.dedup_cache(cache(rows)), 0.2).select(*BLOCK_KEY, "ref_loss", "capability")


@query
def mix_val(spark, sf):
    rows, kept = mixed(spark, sf, 0.25)
    return mixer.validation_rows(rows, kept, True, 2, SEED).select(*BLOCK_KEY, "content_hash")


@query
def mix_fixed_replay(spark, sf):
    return mixer.train_rows(mixed(spark, sf, 0.25)[1]).select(*BLOCK_KEY, "content_hash")


@query
def precompute_slice(spark, sf):
    return mixed(spark, sf, 0.0)[1].select(*BLOCK_KEY, "split")


@query
def read_cap_fallback(spark, sf):
    """A read cap that leaves no held-out rows: the first train rows stand in."""
    rows = store(split(blocks(spark, sf)), "split").where("split = 'train'")
    return mixer.with_fallback(rows.where("split = 'holdout'"), rows, True, 64).select(*BLOCK_KEY, "content_hash")


@query
def pool_batches(spark, sf):
    return pools(blocks(spark, sf), 32, "epoch:42:0").select(*BLOCK_KEY, "step", "block_id")


@query
def token_histogram(spark, sf):
    return token_counts(blocks(spark, sf))


@query
def target_loss(spark, sf):
    """Losses in whole numbers: an id's remainder stands for its loss."""
    rows = blocks(spark, sf).withColumn("lp", F.transform("token_ids", lambda t: -(t % 7).cast("double"))).withColumn("tm", F.transform("token_ids", lambda t: F.when(t % 3 == 0, 0.0).otherwise(1.0))).withColumn("sm", F.when(F.col("block") % 5 == 0, 0.0).otherwise(1.0))
    mask = arrays.shifted(F.col("tm"))
    return rows.select(*BLOCK_KEY, arrays.target_loss(arrays.shifted(F.col("lp")), mask, F.col("sm")).alias("target_loss"), arrays.response_tokens(mask, F.col("sm")).alias("n_response_tokens"))


@query
def assistant_mask(spark, sf):
    """Tokens of a conversation, and which of them count: the assistant's."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", arrays.word_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = collate.conversations(turns)
    return found.select("conv_id", F.size("token_ids").cast("long").alias("n_tokens"), arrays.total(F.col("token_mask")).cast("long").alias("n_response_tokens"), listed("token_ids"), F.array_join(F.transform("token_mask", lambda m: m.cast("int").cast("string")), "").alias("mask"))


@query
def rho(spark, sf):
    return pool(spark, sf).select("step", "block_id", "rho", (F.col("target_loss") - F.col("rho")).alias("ref_loss"))


@query
def score_metrics(spark, sf):
    return metrics.score_metrics(pool(spark, sf))


def selected(spark, sf, strategy, ratio=0.25):
    return selection.select(pool(spark, sf), K, strategy, ratio, SEED).select("step", "block_id", "origin_tag", "rho", "sel_rank")


@query
def select_top_k(spark, sf):
    return selected(spark, sf, "top_k")


@query
def select_fixed_ratio(spark, sf):
    return selected(spark, sf, "fixed_ratio")


@query
def select_replay_only_rho(spark, sf):
    return selected(spark, sf, "replay_only_rho")


@query
def select_fixed_ratio_rho(spark, sf):
    return selected(spark, sf, "fixed_ratio_rho")


@query
def select_backfill(spark, sf):
    """A replay share that no pool can fill: adaptation rows fill it up."""
    return selection.select(pool(spark, sf), 48, "fixed_ratio_rho", 0.95, SEED).select("step", "block_id", "origin_tag", "sel_rank")


@query
def gather_selected(spark, sf):
    """What a step trains on: the selected rows with their losses, in order."""
    return selection.select(pool(spark, sf), K).select("step", (F.col("sel_rank") - 1).cast("int").alias("pos"), "block_id", "content_hash", "target_loss", "ref_loss")


@query
def collate_samples(spark, sf):
    """Block rows of which some lack an origin, a tag or a loss."""
    gaps = {"origin": 4, "origin_tag": 3, "content_hash": 7}
    rows = with_reference(blocks(spark, sf)).select("token_ids", "block", F.col("content_hash").alias("key"), F.when(F.col("block") % 2 == 0, F.col("ref_loss")).alias("ref_loss"), *(F.when(F.col("block") % n != 0, F.col(c)).alias(c) for c, n in gaps.items()))
    found = collate.samples(rows, "block")
    return found.select("idx", "length", "origin", "origin_tag", "content_hash", "loss_multiplier", "ref_loss", arrays.total(F.col("token_mask")).alias("n_trained"))


@query
def collate_batches(spark, sf):
    """Batches of which every other has no reference losses."""
    rows = pool(spark, sf).withColumn("ref_loss", F.when(F.col("step") % 2 == 0, F.col("ref_loss"))).withColumn("origin", F.when(F.col("block_id") % 3 > 0, F.col("origin")))
    return collate.collated(rows).select("step", "block_id", "origin", "origin_tag", "content_hash", "ref_loss")


@query
def selection_metrics(spark, sf):
    return metrics.selection_metrics(flagged(spark, sf))


@query
def metrics_long(spark, sf):
    return metrics.long_table(metrics.selection_metrics(flagged(spark, sf)))


@query
def metric_log(spark, sf):
    """Metrics that two kinds of steps append to one log."""
    path, rows = new_path(spark, "metrics"), pool(spark, sf)
    for odd in (0, 1):
        metrics.long_table(metrics.score_metrics(rows.where(F.col("step") % 2 == odd)), ("train", "score")[odd]).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query
def rho_percentiles(spark, sf):
    found = metrics.rho_percentiles(pool(spark, sf), 5)
    return found.select("step", "corpus", *(F.round(c, 3).alias(c) for c in ("p10", "p50", "p90", "p99")))


@query
def selection_by_origin(spark, sf):
    return metrics.by_origin(flagged(spark, sf))


@query
def reduce_train_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / POOL).alias("step"), F.when(F.col("event_type") == "click", "lr").otherwise(F.col("event_type")).alias("metric"), F.floor(F.col("value")).cast("double").alias("value"))
    return metrics.reduce_train(e)


@query
def merge_microbatch_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / POOL).alias("batch"), F.when(F.col("event_type") == "click", "global_valid_seqs").otherwise(F.col("event_type")).alias("metric"), F.floor(F.col("value")).cast("double").alias("value"))
    return validation.merge_microbatches(e)


def batched(spark, sf):
    return pool(spark, sf).withColumn("batch", F.col("step"))


@query
def val_loss_weighted(spark, sf):
    """Over all batches, and over the first ten as a run may be told."""
    rows = batched(spark, sf)
    every, some = validation.validation_loss(rows), validation.validation_loss(rows, 10)
    cut = lambda found, name: found.select(F.lit(name).alias("batches"), F.round("val_loss", 4).alias("val_loss"), "n_batches")
    return cut(every, "all").unionByName(cut(some, "first"))


@query
def validation_pass(spark, sf):
    """All that a validation pass logs, over the held-out rows."""
    rows = with_reference(split(blocks(spark, sf)).where("split = 'holdout'"))
    return validate(rows, fixed(), TrainConfig(pool_size=32, top_k=32), 32).select("metric", F.round("value", 6).alias("value"))


@query
def val_shuffle(spark, sf):
    """Places of the held-out rows in the order of every run."""
    rows = split(blocks(spark, sf)).where("split = 'holdout'")
    return pools(rows, 32, f"valshuf:{SEED}", whole=False).select(*BLOCK_KEY, F.col("step").alias("batch"), F.col("block_id").alias("pos"))


@query
def corpus_sums(spark, sf):
    return validation.corpus_sums(batched(spark, sf), ("batch",))


@query
def corpus_means(spark, sf):
    return validation.corpus_means(validation.corpus_sums(batched(spark, sf), ("batch",)))


@query
def val_loss_by_origin(spark, sf):
    return validation.loss_by_origin(pool(spark, sf))


@query
def trace_period(spark, sf):
    chosen = selection.select(pool(spark, sf), K)
    return curriculum.trace_rows(chosen, 3)


@query
def trace_last_batch(spark, sf):
    return curriculum.last_batch(trace(spark, sf), 10).select("step", "pos", "content_hash")


@query
def trace_restart(spark, sf):
    return curriculum.restarted(trace(spark, sf)).select("step", "pos", "content_hash")


@query
def trace_round_trip(spark, sf):
    """Two recorded phases, read back line by line."""
    rows, paths = pool(spark, sf), [new_path(spark, f"trace-{n}") for n in (0, 1)]
    for path, strategy in zip(paths, ("top_k", "fixed_ratio_rho")):
        corpus.append_trace(curriculum.trace_rows(selection.select(rows, K, strategy, 0.25, SEED)), path)
    return curriculum.last_batch(corpus.read_trace(spark, paths), K).select("phase", "step", "pos", "content_hash")


@query
def build_curriculum(spark, sf):
    rows = blocks(spark, sf)
    recorded = pools(rows, 8, "cur").select(F.lit(0).alias("phase"), F.lit("f").alias("file"), F.col("block_id").alias("line"), "step", "content_hash")
    return curriculum.build_curriculum(rows, recorded, 8).select("step", F.col("pos").cast("long").alias("pos"), "content_hash", *BLOCK_KEY)


@query
def curriculum_order(spark, sf):
    """Pools that replay a curriculum: steps of eight rows, sixteen to a pool."""
    rows = blocks(spark, sf)
    recorded = pools(rows, 8, "cur").select(F.lit(0).alias("phase"), F.lit("f").alias("file"), F.col("block_id").alias("line"), "step", "content_hash")
    return pools(curriculum.build_curriculum(rows, recorded, 8), 16, None).select("step", "block_id", "content_hash")


@query
def merge_weights(spark, sf):
    """A third of the other model's tensors have another shape, a fifth another
    name; a digest tells all values."""
    digest = lambda v: F.md5(F.array_join(F.transform(v, lambda x: F.floor(x.cast("double") * 1000).cast("string")), ","))
    found = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "vec_id", "embedding")
    base = found.select("name", F.when(F.col("vec_id") % 7 == 0, "int8").otherwise("float32").alias("dtype"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("values"))
    renamed = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("x"), "name")).otherwise(F.col("name"))
    other = found.select(renamed.alias("name"), F.lit("float32").alias("dtype"), F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.size("embedding"))).alias("shape"), F.transform("embedding", lambda x: x * 3).alias("values"))
    return merge.merge_weights(base, other, 0.25).select("name", "merged", digest(F.col("values")).alias("digest"), F.size("values").cast("long").alias("n"))


@query
def tensors_round_trip(spark, sf):
    from millrace.sources.tensors import read_tensors, write_tensors

    path = new_path(spark, "tensors")
    found = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.array(F.size("embedding")).alias("shape"), F.lit("float32").alias("dtype"), F.col("embedding").alias("values"))
    write_tensors(found, path)
    values = F.array_join(F.transform("values", lambda x: F.floor(x.cast("double") * 1000).cast("string")), ",")
    return read_tensors(spark, path).select("name", "dtype", F.get("shape", F.lit(0)).alias("length"), F.md5(values).alias("digest"))


def pool_size(rows: DataFrame) -> int:
    """Eight pools an epoch."""
    return max(K, rows.count() // 8)


def learnt(rows: DataFrame) -> NgramScorer:
    """Trigrams of the replay blocks, learnt in three parts."""
    scorer = NgramScorer(rows.sparkSession)
    for part in range(3):
        scorer.update(rows.where((F.col("origin_tag") == 1) & (F.col("block") % 3 == part)))
    return scorer


@query
def ngram_counts(spark, sf):
    """Of each order and token: contexts that it follows, and how often."""
    return learnt(blocks(spark, sf)).grams().groupBy("n", "token").agg(F.count("*").alias("contexts"), F.sum("c").alias("c"))


@query
def ngram_losses(spark, sf):
    """All blocks by what was learnt of the replay blocks: losses in whole
    millionths, token by token, so that their sums are exact."""
    rows = blocks(spark, sf)
    scored = learnt(rows).logprobs(rows.select(*BLOCK_KEY, "token_ids"))
    micro = F.aggregate(F.transform("token_logprobs", lambda p: F.round(p * -1_000_000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return scored.select(*BLOCK_KEY, micro.alias("loss"), F.size("token_logprobs").cast("long").alias("n_tokens"))


#: One in so many rows of a pool is selected by ``training_loop``, K at least.
ONE_IN = 9


@query
def training_loop(spark, sf):
    """An epoch of the loop with a trigram model that learns: what each step
    selected. It starts from the replay blocks; the reference has seen all. What
    is selected and learnt of a pool grows with it. Tables and models go as soon
    as nothing reads them any more."""
    rows, out = blocks(spark, sf), new_path(spark, "run")
    both = NgramScorer(spark, blocks=rows)
    scored = store(with_target_loss(rows, both).withColumnRenamed("target_loss", "ref_loss").drop("sample_mask"), "scored")
    both.close()
    drop(rows)
    replay, size = learnt(scored), pool_size(scored)
    train_loop(scored, None, replay, TrainConfig(pool_size=size, top_k=max(K, size // ONE_IN), log_selected=True), out=out)
    replay.close()
    drop(scored)
    return run_trace(spark, out)


@query
def loop_resume(spark, sf):
    """Two epochs with a scorer that doesn't learn; the run stops within the
    first one and goes on from its last commit."""
    rows, out = with_reference(blocks(spark, sf)), new_path(spark, "run")
    for most in (3, None):
        cfg = TrainConfig(pool_size=pool_size(rows), top_k=K, max_steps=most, max_epochs=2, log_selected=True)
        train_loop(rows, None, fixed(), cfg, resume(spark, out, fixed()), out)
    return run_trace(spark, out).select("step", "content_hash", "origin", "rho", "rank")


@query
def run_snapshot(spark, sf):
    """A run that commits every two steps, read as of its second commit: its
    trace, and the steps that its metrics hold."""
    rows, out = with_reference(blocks(spark, sf)), new_path(spark, "run")
    train_loop(rows, None, fixed(), TrainConfig(pool_size=pool_size(rows), top_k=K, save_period=2, log_selected=True), out=out)
    steps = run_metrics(spark, out, 2).where("metric = 'selection/k_effective'").select("step", F.col("value").cast("long").alias("k"))
    return run_trace(spark, out, 2).join(steps, "step").select("step", "k", "content_hash", "rank")


@query
def loop_plain(spark, sf):
    """Without selection: whole pools, no reference losses."""
    rows, out = blocks(spark, sf), new_path(spark, "run")
    size = pool_size(rows)
    train_loop(rows, None, fixed(), TrainConfig(pool_size=size, top_k=size, enable_selection=False, log_selected=True), out=out)
    return run_trace(spark, out).select("step", "content_hash", F.col("rank").cast("long").alias("block_id"))


@query
def loop_counters(spark, sf):
    """The state after an epoch in which every third pool has no candidate."""
    rows = with_reference(blocks(spark, sf))
    out, size = new_path(spark, "run"), pool_size(rows)
    placed = pools(rows, size, f"order:{SEED}", whole=False).withColumn("ref_loss", F.when(F.col("step") % 3 == 1, float("nan")).otherwise(F.col("ref_loss"))).drop("step", "block_id")
    train_loop(placed, None, fixed(), TrainConfig(pool_size=size, top_k=K, shuffle=False), out=out)
    return spark.createDataFrame([load_state(spark, out)], "epoch long, step long, total_steps long, consumed_samples long, total_valid_tokens long")


@query
def epoch_order(spark, sf):
    """Positions of all blocks in three epochs: numbers by hash, then a keyed
    permutation; the last epoch keeps runs of five numbers together."""
    rows = blocks(spark, sf)
    numbered = store(pools(rows, 1, f"order:{SEED}", whole=False).select(*BLOCK_KEY, F.col("block_id").alias("number")), "numbers")
    n, out = numbered.count(), None
    for epoch, chunk in ((0, 1), (1, 1), (2, 5)):
        order = EpochOrder(n, f"epoch:{SEED}:{epoch}", chunk)
        number = F.pandas_udf(lambda p, order=order: pd.Series(order.numbers(p.to_numpy())), "long")
        at = spark.range(n).select(F.lit(epoch).alias("epoch"), F.col("id").alias("position"), number("id").alias("number"))
        out = at if out is None else out.unionByName(at)
    return numbered.join(out, "number").select(*BLOCK_KEY, "epoch", "position")


@query
def cache_passes(spark, sf):
    """Two passes into one cache: replay rows, then adaptation rows."""
    rows, path = blocks(spark, sf), new_path(spark, "cache")
    for domain in ("general", ADAPT):
        precompute(rows, domain, fixed(), path)
    return caching.dedup_cache(corpus.read_cache(spark, path)).select("content_hash", F.col("ref_loss").cast("double").alias("ref_loss"))


@query
def cache_pass_cap(spark, sf):
    """A pass that stops after the first rows, as a trial run may."""
    path = new_path(spark, "cache")
    precompute(blocks(spark, sf), ADAPT, fixed(), path, 100)
    return spark.read.schema(corpus.CACHE_SCHEMA).parquet(path).select("content_hash", "origin", "origin_tag", "n_response_tokens")


@query
def read_documents(spark, sf):
    """A tree of files by language, one of which has no texts."""
    path = new_path(spark, "raw")
    docs = table(spark, sf, "documents")
    docs.select(F.concat(F.lit("Nemotron-CC-"), "lang").alias("folder"), "text", "n_chars").write.partitionBy("folder").parquet(path)
    docs.select("doc_id").write.parquet(f"{path}/Metadata")
    found = corpus.read_documents(spark, f"{path}/**/*.parquet", "general")
    return found.select("origin", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


@query
def read_documents_glob(spark, sf):
    """A narrower pattern over a tree in which held-out files lie beside."""
    path, docs = new_path(spark, "raw"), table(spark, sf, "documents").where("text <> ''")
    for name, odd in (("train-1", 0), ("val-1", 1)):
        docs.where(F.col("doc_id") % 2 == odd).select(F.concat(F.lit("cc-"), "lang").alias("folder"), "text").write.partitionBy("folder").parquet(f"{path}/{name}")
    found = corpus.read_documents(spark, f"{path}/**/train-*/folder=cc-[de]*/*.parquet", "general")
    return found.select("origin", F.sha2("text", 256).alias("digest"))


@query
def read_blocks_cap(spark, sf):
    """A read cap counts rows in the files' order, whatever these hold."""
    path = new_path(spark, "blocks")
    corpus.write_blocks(split(blocks(spark, sf)), path, 500)
    return corpus.read_blocks(spark, path, 300).agg(F.count("*").alias("n_rows"), F.count_distinct("domain").alias("n_domains"))


@query
def cap_gate(spark, sf):
    """No cap, and a cap of nothing, leave all rows."""
    rows = blocks(spark, sf)
    both = sampling.cap_per_origin(rows, None).unionByName(sampling.cap_per_origin(rows, 0))
    return both.groupBy("origin").agg(F.count("*").alias("n"))


@query
def map_round_trip(spark, sf):
    path = f"{new_path(spark, 'map')}.json"
    corpus.write_map(spark, {r["origin"]: r["capability"] for r in capabilities(spark, sf).collect()}, path)
    return spark.createDataFrame(sorted(corpus.read_map(spark, path).items()), "origin string, capability string")


@query
def tokenize_by_dictionary(spark, sf):
    """Tokens of a public tokenizer, each distinct pre-token merged once."""
    import public_tokenizers

    from millrace.operators.pretokens import tokens_by_dictionary

    return tokens_by_dictionary(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), ("doc_id",)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), listed("tokens"))


@query
def ingest_tokenizer(spark, sf):
    """Blocks of a public tokenizer's tokens with their decoded length."""
    import public_tokenizers

    from millrace.functions import tokenizers
    from millrace.plans.ingest import blocks_of

    path = public_tokenizers.path("piece_bpe_32k.model")
    cfg = IngestConfig("", "", "", block_size=BLOCK, eod_id=EOD, holdout_fraction=0.05, adapt_domain=ADAPT, seed=SEED)
    found = blocks_of(documents(spark, sf), cfg, tokenizers.tokenizer(path), tokenizers.byte_lengths(path))
    return found.select(*BLOCK_KEY, listed("token_ids"), "n_bytes", "content_hash", "split")


@query
def streaming_loop(spark, sf):
    """The same by Structured Streaming: whole steps in each file, a file per
    micro-batch."""
    from millrace.streaming.loop import run

    source, out, at = (new_path(spark, n) for n in ("pools", "out", "checkpoint"))
    pool(spark, sf).drop("rho").repartitionByRange(8, "step").write.parquet(source)
    run(spark, source, out, at, K).awaitTermination()
    return spark.read.parquet(f"{out}/trace").drop("batch")


@query
def streaming_scattered(spark, sf):
    """Steps scattered over files, their rows gathered in keyed state; the run
    stops after half of the files and goes on with the steps that are open."""
    from pyspark.sql.window import Window

    from millrace.streaming.loop import POOL_COLUMNS, run_scattered

    source, out, at = (new_path(spark, n) for n in ("pools", "out", "checkpoint"))
    rows = pool(spark, sf).drop("rho").withColumn("step_rows", F.count("*").over(Window.partitionBy("step")).cast("int")).select(*POOL_COLUMNS, "step_rows")
    half = F.xxhash64("block_id") % 2 == 0
    rows.where(half).repartition(4, F.xxhash64("block_id") % 4).write.parquet(source)
    run_scattered(spark, source, out, at, K).awaitTermination()
    rows.where(~half).repartition(4, F.xxhash64("block_id") % 4).write.mode("append").parquet(source)
    run_scattered(spark, source, out, at, K).awaitTermination()
    return spark.read.parquet(f"{out}/trace").drop("batch")


@query
def stream_consumed(spark, sf):
    from millrace.streaming.loop import consumed

    return consumed(curriculum.trace_rows(selection.select(pool(spark, sf), K)), POOL)


@query
def jsonl_round_trip(spark, sf):
    path = new_path(spark, "rows")
    corpus.write_rows(blocks(spark, sf), path)
    return corpus.read_rows(spark, path).groupBy("origin", "origin_tag", "capability").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("n_hashes"))


@query
def blocks_round_trip(spark, sf):
    path = new_path(spark, "blocks")
    corpus.write_blocks(split(blocks(spark, sf)), path, 500)
    return corpus.read_blocks(spark, path).select(*BLOCK_KEY, "content_hash", "split")
