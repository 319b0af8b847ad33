"""The command line and tensor files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.plans import train
from millrace.sources import corpus, tensors


def put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, content in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)


def test_tensor_files_round_trip():
    rows = [("a", [2, 2], "float32", [1.5, -2.0, 0.25, 9.0]), ("b", [3], "bfloat16", [1.0, -0.5, 3.140625]), ("c", [1], "int8", [-7.0]), ("d", [2], "float16", [0.5, 2.0])]
    got = tensors.decode(tensors.encode(rows))
    assert [(n, s, k, v.tolist()) for n, s, k, v in got] == rows


def test_merge_command(spark, tmp_path):
    put(f"{tmp_path}/base", {"m1.safetensors": tensors.encode([("w", [2], "float32", [0.0, 4.0])]), "m2.safetensors": tensors.encode([("only", [1], "float32", [7.0]), ("i", [1], "int8", [1.0])]), "unused.safetensors": tensors.encode([("x", [1], "float32", [1.0])]), "model.safetensors.index.json": json.dumps({"weight_map": {"w": "m1.safetensors", "only": "m2.safetensors", "i": "m2.safetensors"}}).encode(), "config.json": b"{}"})
    put(f"{tmp_path}/spec", {"s.safetensors": tensors.encode([("w", [2], "float32", [8.0, 0.0]), ("i", [1], "int8", [9.0])])})
    main(["merge", "--base", f"{tmp_path}/base", "--specialist", f"{tmp_path}/spec", "--weight", "0.25", "--out", f"{tmp_path}/out"], spark)
    got = {r["name"]: r["values"] for r in tensors.read_tensors(spark, f"{tmp_path}/out").collect()}
    assert got == {"w": [2.0, 3.0], "only": [7.0], "i": [1.0]} and os.path.exists(f"{tmp_path}/out/config.json")
    os.remove(f"{tmp_path}/base/m1.safetensors")
    with pytest.raises(FileNotFoundError, match="m1"):
        tensors.shards(spark, f"{tmp_path}/base")


def test_ingest_precompute_train(spark, tmp_path):
    for domain in ("legal", "general"):
        rows = [(" ".join(f"{domain}{(i * 3 + j) % 41}" for j in range(40)),) for i in range(60)]
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{tmp_path}/raw/{domain}/Sub-{domain}")
    with open(f"{tmp_path}/map.json", "w") as f:
        json.dump({"Sub-legal": "law"}, f)
    main(["ingest", "--adapt-glob", f"{tmp_path}/raw/legal/**/*.parquet", "--replay-glob", f"{tmp_path}/raw/general/**/*.parquet", "--out", f"{tmp_path}/blocks", "--block-size", "16", "--origin-map", f"{tmp_path}/map.json", "--balance-replay"], spark)
    blocks = corpus.read_blocks(spark, f"{tmp_path}/blocks")
    assert {r[0] for r in blocks.select("origin").distinct().collect()} == {"law", "sub_general"}
    for domain in ("legal", "general"):
        main(["precompute", "--blocks", f"{tmp_path}/blocks", "--domain", domain, "--cache", f"{tmp_path}/cache", "--vocabulary", "1000"], spark)
    with open(f"{tmp_path}/run.json", "w") as f:
        json.dump({"mixer": {"corpus_path": f"{tmp_path}/blocks", "adapt_domain": "legal", "ref_loss_cache_path": f"{tmp_path}/cache"}, "train": {"pool_size": 32, "top_k": 8, "max_steps": 2}}, f)
    with open(f"{tmp_path}/over.json", "w") as f:
        json.dump({"train": {"max_steps": 1, "log_selected": True}}, f)
    main(["train", "--config", f"{tmp_path}/run.json", f"{tmp_path}/over.json", "--out", f"{tmp_path}/run", "--vocabulary", "1000"], spark)
    assert corpus.read_trace(spark, [f"{tmp_path}/run"]).count() == 8
    main(["train", "--config", f"{tmp_path}/run.json", f"{tmp_path}/over.json", "--set", "train.max_steps=2", "train.top_k=4", "--out", f"{tmp_path}/run", "--vocabulary", "1000"], spark)
    assert corpus.read_trace(spark, [f"{tmp_path}/run"]).groupBy("step").count().orderBy("step").collect() == [(1, 8), (2, 4)]
    assert np.isfinite(train.run_metrics(spark, f"{tmp_path}/run").where("metric = 'val_loss'").first()["value"])


def test_stage(spark, tmp_path):
    for i in range(10):
        put(f"{tmp_path}/repo/high", {f"p{i}.parquet": b"x", "readme.md": b""})
    spec = [{"origin": "high", "repo": f"{tmp_path}/repo", "prefix": "high/", "capability": "web", "n_shards": 6}, {"origin": "none", "repo": f"{tmp_path}/repo", "prefix": "low/", "n_shards": 2}]
    with open(f"{tmp_path}/spec.json", "w") as f:
        json.dump(spec, f)
    args = ["stage", "--spec", f"{tmp_path}/spec.json", "--out", f"{tmp_path}/out", "--shards-scale", "0.5", "--capability-map-out", f"{tmp_path}/caps.json"]
    main([*args, "--dry-run"], spark)
    assert not os.path.exists(f"{tmp_path}/out")
    main(args, spark)
    assert sorted(f for f in os.listdir(f"{tmp_path}/out/high") if not f.startswith(".")) == ["p0.parquet", "p3.parquet", "p6.parquet"]
    assert corpus.read_map(spark, f"{tmp_path}/caps.json") == {"high": "web", "none": "none"}


def test_precompute_settings(monkeypatch):
    from millrace.__main__ import _precompute_settings, parser

    read = lambda *args: _precompute_settings(parser().parse_args(["precompute", *args]))
    with pytest.raises(SystemExit, match="--domain or MILLRACE_PRECOMPUTE_DOMAIN"):
        read("--blocks", "b")
    monkeypatch.setenv("MILLRACE_PRECOMPUTE_DOMAIN", "legal")
    assert read("--blocks", "b", "--set", "mixer.ref_loss_cache_path=c") == {"blocks": "b", "domain": "legal", "cache": "c"}


def test_ingest_with_a_log_reads_new_files_only(spark, tmp_path):
    def add(step):
        for domain in ("legal", "general"):
            rows = [(" ".join(f"{domain}{step}{(i * 3 + j) % 41}" for j in range(40)),) for i in range(12)]
            spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{tmp_path}/raw/{domain}/sub/s{step}")

    given = ["ingest", "--adapt-glob", f"{tmp_path}/raw/legal/**/*.parquet", "--replay-glob", f"{tmp_path}/raw/general/**/*.parquet", "--no-per-subset", "--block-size", "16"]
    for step in (1, 2):
        add(step)
        main([*given, "--out", f"{tmp_path}/steps", "--log", f"{tmp_path}/log"], spark)
    main([*given, "--out", f"{tmp_path}/once"], spark)
    steps, once = (sorted(map(tuple, corpus.read_blocks(spark, f"{tmp_path}/{n}").select("domain", "block", "content_hash", "split").collect())) for n in ("steps", "once"))
    assert steps == once and len(once) == 2 * (24 * 41 // 16)


def test_ingestion_with_a_library_tokenizer(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    for domain in ("legal", "general"):
        spark.createDataFrame([(f"some {domain} words, number {i}. " * 9,) for i in range(20)], "text string").coalesce(1).write.parquet(f"{tmp_path}/raw/{domain}/Sub-{domain}")
    main(["ingest", "--adapt-glob", f"{tmp_path}/raw/legal/**/*.parquet", "--replay-glob", f"{tmp_path}/raw/general/**/*.parquet", "--out", f"{tmp_path}/blocks", "--block-size", "32", "--eod-id", "50256", "--tokenizer", public_tokenizers.path("byte_bpe_50k.json")], spark)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus.read_blocks(spark, f"{tmp_path}/blocks").orderBy("domain", "origin", "block").collect()
    ids = [t for i in range(20) for t in [*tok.encode(f"some general words, number {i}. " * 9).ids, 50256]]
    own = [r for r in rows if r["domain"] == "general"]
    assert [t for r in own for t in r["token_ids"]] == ids[: 32 * (len(ids) // 32)]
    assert all(r["n_bytes"] == len(tok.decode(r["token_ids"], skip_special_tokens=False).encode()) for r in rows)


def test_a_model_file_scores_the_blocks(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    from tests.test_operators import tiny_model

    table = np.random.default_rng(1).normal(size=(30, 30)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(tiny_model(table))
    rows = [([i % 30, (i * 7) % 30, 3], "o", 0, "legal", "o", None, f"h{i}", i, "train") for i in range(12)]
    corpus.write_blocks(spark.createDataFrame(rows, corpus.BLOCK_SCHEMA), f"{tmp_path}/blocks")
    main(["precompute", "--blocks", f"{tmp_path}/blocks", "--domain", "legal", "--cache", f"{tmp_path}/cache", "--model", f"{tmp_path}/m.onnx"], spark)
    logprob = table - np.log(np.exp(table).sum(axis=1, keepdims=True))
    got = {r["content_hash"]: r["ref_loss"] for r in corpus.read_cache(spark, f"{tmp_path}/cache").collect()}
    assert got == pytest.approx({f"h{i}": -(logprob[i % 30, (i * 7) % 30] + logprob[(i * 7) % 30, 3]) / 2 for i in range(12)}, abs=1e-5)


def test_shards_are_bounded_by_their_bytes(spark, tmp_path):
    rows = [(f"t{i}", [n], "float32", [float(i)] * n) for i, n in enumerate([3, 3, 30, 2, 2, 2])]
    found = spark.createDataFrame(rows, tensors.SCHEMA)
    files = tensors.write_tensors(found, f"{tmp_path}/m", shard_bytes=32)
    held = [[r[0] for r in tensors.decode(open(f"{tmp_path}/m/{f}", "rb").read())] for f in files]
    assert held == [["t0", "t1"], ["t2"], ["t3", "t4", "t5"]]
    assert sorted(map(tuple, tensors.read_tensors(spark, f"{tmp_path}/m").select("name", "dtype").collect())) == [(r[0], "float32") for r in rows]


def test_tasks_read_tensors_by_ranges(spark, tmp_path):
    rows = [(f"t{i}", [i + 1], "bfloat16" if i % 2 else "float32", [float(i)] * (i + 1)) for i in range(9)]
    put(f"{tmp_path}/m", {"a.safetensors": tensors.encode(rows[:6]), "b.safetensors": tensors.encode(rows[6:]), "c.safetensors": tensors.encode([])})
    found = tensors.read_tensors(spark, f"{tmp_path}/m", part_bytes=20)
    parts = found.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sort_array(F.collect_list("name")).alias("names")).collect()
    # 4, 4 and 12 bytes, then 8, 20, 12; in the other file 28, 16 and 36
    assert sorted(r["names"] for r in parts) == [["t0", "t1", "t2"], ["t3"], ["t4"], ["t5"], ["t6"], ["t7"], ["t8"]]
    assert sorted(tuple(r) for r in found.collect()) == rows
    put(f"{tmp_path}/e", {"c.safetensors": tensors.encode([])})
    assert tensors.read_tensors(spark, f"{tmp_path}/e").count() == 0


def test_an_index_names_what_tasks_wrote(spark, tmp_path):
    rows = [(f"t{i:02d}", [2], "float32", [float(i), -1.0]) for i in range(40)]
    model = spark.createDataFrame(rows, tensors.SCHEMA)
    first = tensors.write_tensors(model, f"{tmp_path}/m", shard_bytes=64)
    assert len(first) >= 5 and set(first) == {f for f in os.listdir(f"{tmp_path}/m") if f.endswith(".safetensors")}
    assert sorted(tuple(r) for r in tensors.read_tensors(spark, f"{tmp_path}/m").collect()) == rows
    second = tensors.write_tensors(model.where("name < 't20'"), f"{tmp_path}/m", shard_bytes=64)
    assert set(second) == {f for f in os.listdir(f"{tmp_path}/m") if f.endswith(".safetensors")} and not set(first) & set(second)
    assert tensors.read_tensors(spark, f"{tmp_path}/m").count() == 20
    with pytest.raises(Exception, match="one name"):
        tensors.write_tensors(model.union(model), f"{tmp_path}/m")
    assert tensors.read_tensors(spark, f"{tmp_path}/m").count() == 20  # a failed write changes nothing
    assert len(tensors.write_tensors(model.limit(0), f"{tmp_path}/none")) == 1
    assert tensors.read_tensors(spark, f"{tmp_path}/none").count() == 0
