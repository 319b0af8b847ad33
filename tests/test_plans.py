"""Whole runs on a small corpus tree."""

import dataclasses
import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import permutation
from millrace.operators.scoring import UnigramScorer
from millrace.plans import config, ingest, precompute, train
from millrace.sources import commits, corpus, shared


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for domain, subset, n in (("legal", "CaseHOLD", 60), ("legal", "eCFR", 60), ("general", "Nemotron-CC-v2", 60), ("general", "Nemotron-CC-Math-v1", 60)):
        rows = [(" ".join(f"w{subset[-1]}{(i * 7 + j) % 97}" for j in range(30)), i) for i in range(n)] + [("", 0), (None, 0)]
        spark.createDataFrame(rows, "text string, extra int").coalesce(1).write.parquet(f"{root}/{domain}/{subset}")
    spark.createDataFrame([("x",)], "rel_path string").coalesce(1).write.parquet(f"{root}/general/Nemotron-Code-Metadata")
    return root


def settings(tree, out, **kw):
    return config.IngestConfig(f"{tree}/legal/**/*.parquet", f"{tree}/general/**/*.parquet", str(out), block_size=16, **kw)


@pytest.fixture(scope="module")
def built(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    counts = ingest.build_corpus(spark, settings(tree, out / "blocks", holdout_fraction=0.05, capability_map={"v2": "web"}))
    blocks = corpus.read_blocks(spark, str(out / "blocks"))
    cache = str(out / "cache")
    for domain in ("general", "legal"):
        precompute.precompute(blocks, domain, UnigramScorer(1000, blocks.where(F.col("domain") == domain)), cache)
    return out, counts.collect(), cache


def test_ingestion(spark, tree, built, tmp_path):
    _, counts, _ = built
    assert {(r["domain"], r["origin"]) for r in counts} == {("legal", "casehold"), ("legal", "ecfr"), ("general", "v2"), ("general", "math_v1")}
    assert all(r["total"] == 60 * 31 // 16 and r["holdout"] == 6 for r in counts)
    assert {r["origin"]: r["capability"] for r in counts}["v2"] == "web"
    capped = ingest.build_corpus(spark, settings(tree, tmp_path / "b", max_blocks_adapt=30, max_blocks_replay=80, max_docs_replay=50)).groupBy("domain").agg(F.sum("total").alias("n"))
    assert {r["domain"]: r["n"] for r in capped.collect()} == {"legal": 30, "general": 80}
    coarse = ingest.documents(spark, settings(tree, tmp_path / "c", per_subset=False, origin_map={"eCFR": "rules"}), True)
    assert [r[0] for r in coarse.select("origin").distinct().collect()] == ["legal"]
    with pytest.raises(FileNotFoundError):
        corpus.list_files(spark, f"{tree}/none/**/*.parquet")
    with pytest.raises(ValueError):
        ingest.assert_disjoint(spark.createDataFrame([("a", "o"), ("b", "o")], "domain string, origin string"))


def test_ingestion_goes_on_with_new_files(spark, tmp_path):
    """Files that come in three steps give the blocks of one step."""

    def add(step, domain, subset, n):
        rows = [(" ".join(f"{subset}{step}w{i}x{k}" for k in range(5 + (7 * i + step) % 23)),) for i in range(n)]
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(str(tmp_path / "raw" / domain / subset / f"s{step}"))

    key = ("domain", "origin", "block", "content_hash")
    held = lambda rows: sorted(tuple(r) for r in rows.select(*key).collect())
    cfg = config.IngestConfig(f"{tmp_path}/raw/legal/**/*.parquet", f"{tmp_path}/raw/general/**/*.parquet", str(tmp_path / "out"), block_size=16, holdout_fraction=0.1)
    log = str(tmp_path / "log")
    add(1, "legal", "a", 20), add(1, "general", "b", 11), add(1, "general", "c", 1)
    assert ingest.ingest_more(spark, cfg, log) == 1 and ingest.ingest_more(spark, cfg, log) is None
    first = held(ingest.packed_blocks(spark, log))
    add(2, "general", "b", 13), add(2, "general", "d", 4)
    assert ingest.ingest_more(spark, cfg, log) == 2
    # what a lost writer left is not read
    spark.range(3).write.parquet(f"{log}/data/blocks-000000000003-lost")
    add(3, "legal", "a", 2), add(3, "general", "c", 9), add(3, "general", "b", 1)
    assert ingest.ingest_more(spark, cfg, log) == 3
    once = ingest.blocks_of(ingest.documents(spark, cfg, True).unionByName(ingest.documents(spark, cfg, False)), cfg)
    assert held(ingest.packed_blocks(spark, log)) == held(once) and held(ingest.packed_blocks(spark, log, 1)) == first
    told = {r["origin"]: r["total"] for r in ingest.publish(spark, cfg, log).collect()}
    assert told == {r["origin"]: r["n"] for r in once.groupBy("origin").agg(F.count("*").alias("n")).collect()} and len(told) == 4
    with pytest.raises(ValueError, match="settings"):
        ingest.ingest_more(spark, dataclasses.replace(cfg, block_size=8), log)
    with pytest.raises(ValueError, match="limits"):
        ingest.ingest_more(spark, dataclasses.replace(cfg, max_docs_adapt=1), log)
    (changed,) = (tmp_path / "raw/legal/a/s1").glob("*.parquet")
    changed.write_bytes(changed.read_bytes() + b" ")
    with pytest.raises(ValueError, match="changed"):
        ingest.ingest_more(spark, cfg, log)


def test_mixer(spark, built):
    out, _, cache = built
    both = config.MixerConfig(str(out / "blocks"), "legal", ref_loss_cache_path=cache)
    rows, val = train.prepare(spark, both)
    assert rows.where("ref_loss is null").count() == 0 and rows.select("domain").distinct().count() == 2
    alone, val_alone = train.prepare(spark, config.MixerConfig(str(out / "blocks"), "legal", replay_share=0.0, max_val_samples_per_origin=2))
    assert [r[0] for r in alone.select("domain").distinct().collect()] == ["legal"]
    assert val_alone.groupBy("origin").count().where("count <> 2").count() == 0 and val_alone.select("origin").distinct().count() == 4
    assert [r["content_hash"] for r in val.collect()] == [r["content_hash"] for r in train.prepare(spark, both)[1].collect()]
    corpus.write_rows(rows, str(out / "rows"))
    line = json.loads(spark.read.text(str(out / "rows")).first()[0])
    assert set(line) == {"token_ids", "origin", "origin_tag", "content_hash", "ref_loss", "capability", "n_bytes"} and line["n_bytes"] is None


def test_training_trace_resume_and_curriculum(spark, built):
    out, _, cache = built
    rows, val = train.prepare(spark, config.MixerConfig(str(out / "blocks"), "legal", ref_loss_cache_path=cache))
    cfg = config.TrainConfig(pool_size=64, top_k=16, max_steps=2, log_selected=True, rich_log_period=1, val_at_start=True)
    run, before = str(out / "run"), set(shared.folders(spark, f"{shared.shared_dir(spark)}/millrace"))
    state = train.train_loop(rows, val, UnigramScorer(1000), cfg, out=run)
    assert (state.total_steps, state.consumed_samples, state.step, state.total_valid_tokens) == (2, 128, 2, 2 * 16 * 16)
    assert train.load_state(spark, run) == state
    go_on = config.TrainConfig(pool_size=64, top_k=16, max_steps=3, log_selected=True)
    scorer = UnigramScorer(1000)
    saved = train.resume(spark, run, scorer)
    assert saved == state and scorer.counts.sum() == 2 * 16 * 16
    after = train.train_loop(rows, None, scorer, go_on, saved, run)
    assert after.total_steps == 3 and train.load_state(spark, run) == after
    straight = UnigramScorer(1000)
    train.train_loop(rows, None, straight, go_on)
    assert (straight.counts == scorer.counts).all()
    assert set(shared.folders(spark, f"{shared.shared_dir(spark)}/millrace")) == before  # the loop leaves no table behind
    logged = train.run_metrics(spark, run)
    names = {r[0] for r in logged.select("metric").distinct().collect()}
    assert {"selection/k_effective", "candidate_loss", "val_loss", "target_loss_adapt"} <= names and any(n.startswith("selection_by_origin/adapt/") for n in names) and any(n.startswith("rho_dist/") for n in names)
    assert logged.where("prefix = 'validation'").select("step").distinct().count() == 2  # at the start and at the end
    blocks_path = str(out / "blocks")
    again, _ = train.prepare(spark, config.MixerConfig(blocks_path, "legal", curriculum_trace_dirs=(run,), curriculum_batch_size=16))
    assert again.count() == 48
    placed = train.pools(again, 16, None)
    trace = corpus.read_trace(spark, [run])
    for step in range(3):
        a = [r["content_hash"] for r in placed.where(F.col("step") == step).orderBy("block_id").collect()]
        assert a == [r["content_hash"] for r in trace.where(F.col("step") == step + 1).orderBy("file", "line").collect()]


def test_plain_mode_and_settings(spark, built):
    out, _, _ = built
    rows, _ = train.prepare(spark, config.MixerConfig(str(out / "blocks"), "legal"))
    with pytest.raises(RuntimeError):
        train.train_loop(rows, None, UnigramScorer(1000), config.TrainConfig(pool_size=64, top_k=16))
    state = train.train_loop(rows, None, UnigramScorer(1000), config.TrainConfig(pool_size=128, top_k=128, enable_selection=False, max_steps=1))
    assert state.total_valid_tokens == 128 * 16
    with pytest.raises(ValueError):
        config.TrainConfig(pool_size=4, top_k=2, curriculum=True)
    with pytest.raises(ValueError, match="adapt_domain, train.top_k"):
        config.build(config.RunConfig, {"mixer": {"corpus_path": "x"}, "train": {"pool_size": 3}})
    with pytest.raises(ValueError, match="mixer.odd"):
        config.build(config.RunConfig, {"mixer": {"corpus_path": "x", "adapt_domain": "d", "odd": 1}, "train": {"pool_size": 3, "top_k": 1}}, strict=True)
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": "${HOME}"}})["a"]["c"] == 2


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    from millrace.streaming import loop

    def put(step):
        rows = [(step, i, f"h{i}", "o", i % 2, 1.0, float(i), 0.0) for i in range(8)]
        spark.createDataFrame(rows, loop.POOL_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "pools"))

    for step in (0, 1):
        put(step)
    args = (spark, str(tmp_path / "pools"), str(tmp_path / "out"), str(tmp_path / "check"), 3)
    loop.run(*args).awaitTermination()
    put(2)
    loop.run(*args).awaitTermination()
    trace = spark.read.parquet(str(tmp_path / "out" / "trace"))
    assert sorted((r["step"], r["rank"], r["content_hash"]) for r in trace.collect()) == [(s, k + 1, f"h{7 - k}") for s in range(3) for k in range(3)]
    assert [r["consumed_samples"] for r in loop.consumed(trace, 8).orderBy("step").collect()] == [8, 16, 24]


def test_scattered_steps_are_gathered_until_their_last_row(spark, tmp_path):
    """Rows of three steps over five files, some delivered twice, null and
    infinite losses among them; a step that lacks a row is not selected from."""
    from millrace.streaming import loop

    def put(*rows):
        full = [(s, i, f"h{s}-{i}", "o", i % 2, 1.0, None if i == 5 else float(i), float("inf") if i == 4 else 0.0, 6) for s, i in rows]
        spark.createDataFrame(full, f"{loop.POOL_SCHEMA}, step_rows int").coalesce(1).write.mode("append").parquet(str(tmp_path / "pools"))

    def trace():
        loop.run_scattered(spark, str(tmp_path / "pools"), str(tmp_path / "out"), str(tmp_path / "check"), 2).awaitTermination()
        return sorted((r["step"], r["rank"], r["content_hash"]) for r in spark.read.parquet(str(tmp_path / "out" / "trace")).collect())

    put((0, 0), (1, 0), (0, 1))
    put((1, 1), (1, 2), (2, 0))
    put((0, 2), (0, 3), (0, 3), (1, 3))
    assert trace() == []
    put((0, 4), (0, 5), (2, 1))
    assert trace() == [(0, 1, "h0-3"), (0, 2, "h0-2")]
    put((0, 3), (1, 5), (1, 4))
    assert trace() == [(0, 1, "h0-3"), (0, 2, "h0-2"), (1, 1, "h1-3"), (1, 2, "h1-2")]


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", range(7))
def test_a_kill_between_any_two_writes_leaves_no_half_step(spark, tmp_path, monkeypatch, at):
    """The run dies at its ``at``-th write (metrics, trace, model, commit); what
    is read then, and what a run that goes on leads to, are those of whole steps."""
    rows = spark.createDataFrame([([i % 5, i % 3, 1, i], f"h{i:02d}", "o", i % 2, "d", i, 0.5) for i in range(24)], "token_ids array<int>, content_hash string, origin string, origin_tag int, domain string, block long, ref_loss double")
    cfg = config.TrainConfig(pool_size=8, top_k=2, save_period=1, log_selected=True, shuffle_chunk=3)
    straight = str(tmp_path / "straight")
    train.train_loop(rows, None, UnigramScorer(50), cfg, out=straight)
    want = sorted(map(tuple, train.run_trace(spark, straight).collect()))
    writes, run = [], str(tmp_path / "run")

    def dying(f):
        def call(*args, **kw):
            writes.append(f.__name__)
            if len(writes) == at + 4:  # within the second step or the third
                raise Killed
            return f(*args, **kw)

        return call

    with monkeypatch.context() as m:
        for owner, name in ((train.RunLog, "metrics"), (train.RunLog, "trace"), (UnigramScorer, "save"), (commits.CommitLog, "commit")):
            m.setattr(owner, name, dying(getattr(owner, name)))
        with pytest.raises(Killed):
            train.train_loop(rows, None, UnigramScorer(50), cfg, out=run)
    scorer = UnigramScorer(50)
    state = train.resume(spark, run, scorer)
    done = state.total_steps if state else 0
    assert scorer.counts.sum() == done * 2 * 4
    assert sorted(map(tuple, train.run_trace(spark, run).collect())) == [r for r in want if r[0] <= done]
    assert {r["step"] for r in train.run_metrics(spark, run).select("step").collect()} == set(range(1, done + 1))
    train.train_loop(rows, None, scorer, cfg, state, run)
    assert sorted(map(tuple, train.run_trace(spark, run).collect())) == want and train.load_state(spark, run).total_steps == 3
    log = commits.CommitLog(spark, run)
    assert log.vacuum() == 0 and len(log.snapshot("trace", 1)) == 1


def test_commits_are_whole_and_never_overwritten(spark, tmp_path):
    a, b = (commits.CommitLog(spark, str(tmp_path / "log")) for _ in "ab")
    assert a.last() is None and a.snapshot("trace") == []
    assert a.commit({"trace": ["x"]}) == 1
    assert b.commit({"trace": ["y"]}, after=1) == 2
    with pytest.raises(commits.Conflict):
        a.commit({"trace": ["z"]}, after=1)
    (tmp_path / "log" / "commits" / f"{3:012d}").write_text("0123\n{")  # a writer died in the middle
    assert [n for n, _ in a.manifests()] == [1, 2] and a.last()[0] == 2
    assert a.commit({"trace": ["w"]}, after=2) == 4
    assert [p.rsplit("/", 1)[1] for p in a.snapshot("trace", 2)] == ["x", "y"] and len(a.snapshot("trace")) == 3
    spark.range(1).write.parquet(a.place("lost"))
    assert a.vacuum() == 1


def test_permutations():
    import numpy as np

    for n in (1, 2, 3, 5, 16, 17, 1000, 65537):
        every = np.arange(n)
        got = permutation.Permutation(n, "k").at(every)
        assert np.array_equal(np.sort(got), every)
        for chunk in (1, 4, n, n + 1):
            own = permutation.EpochOrder(n, "k", chunk).numbers(every)
            assert np.array_equal(np.sort(own), every)
            if 1 < chunk <= n:  # runs stay together
                assert ((np.diff(own.reshape(-1)[: n // chunk * chunk].reshape(-1, chunk), axis=1) % n) == 1).all()
    a, b = (permutation.Permutation(100_000, k).at(np.arange(100_000)) for k in "ab")
    assert (a == b).mean() < 0.001 and abs(np.corrcoef(a, np.arange(100_000))[0, 1]) < 0.02 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.02
    # a pool of 100 has rows of all parts, about as many of each
    assert np.bincount(a[:10_000] // 10_000, minlength=10).min() > 850
    assert permutation.EpochOrder(10, None).numbers(np.arange(10)).tolist() == list(range(10))
    with pytest.raises(IndexError):
        permutation.Permutation(5, "k").at(np.array([5]))


def test_a_step_reads_the_folders_of_its_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(train.Numbered, "PART_ROWS", 10)
    rows = spark.createDataFrame([([1, 2], f"h{i}", "o", 0, "d", i) for i in range(100)], "token_ids array<int>, content_hash string, origin string, origin_tag int, domain string, block long")
    table = train.Numbered(rows, config.TrainConfig(pool_size=10, top_k=10, shuffle_chunk=10))
    try:
        seen = []
        for step in range(table.steps):
            pool = table.pool(0, step)
            seen += [(r["block_id"], r["content_hash"]) for r in pool.select("block_id", "content_hash").collect()]
            leaf = pool._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [_part" in leaf or "_part" in leaf
            assert len(pool.inputFiles()) <= 100
        assert sorted(i for i, _ in seen) == list(range(100)) and len({h for _, h in seen}) == 100
    finally:
        table.drop()


@pytest.mark.parametrize("chunk", [1, 7])
def test_numbers_of_a_large_pool_are_not_listed(spark, monkeypatch, chunk):
    """Its rows tell their positions; they are those of a listed pool."""
    rows = spark.createDataFrame([([1, 2], f"h{i}", "o", 0, "d", i) for i in range(101)], "token_ids array<int>, content_hash string, origin string, origin_tag int, domain string, block long")
    table, found = train.Numbered(rows, config.TrainConfig(pool_size=25, top_k=10, shuffle_chunk=chunk)), []
    try:
        for listed in (25, 4):
            monkeypatch.setattr(train.Numbered, "LISTED", listed, raising=False)
            pools = [table.pool(epoch, step) for epoch in (0, 1) for step in range(table.steps)]
            found.append([sorted((r["block_id"], r["step"], r["content_hash"]) for r in pool.collect()) for pool in pools])
        assert found[0] == found[1] and [b for b, _, _ in sum(found[1][:4], [])] == list(range(100))
        plan = pools[0]._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "LocalTableScan" not in plan
    finally:
        table.drop()


def test_positions_are_the_inverse_of_numbers():
    import numpy as np

    for n in (1, 2, 3, 16, 17, 1000, 65537):
        for key, chunk in ((None, 1), ("k", 1), ("k", 4), ("k", n), ("k", n + 1)):
            order, every = permutation.EpochOrder(n, key, chunk), np.arange(n)
            assert np.array_equal(order.positions(order.numbers(every)), every) and np.array_equal(order.numbers(order.positions(every)), every)


def test_settings_files_and_overrides(tmp_path):
    (tmp_path / "a.yaml").write_text("train:\n  pool_size: 8\n  top_k: 2\nmixer:\n  corpus_path: x\n")
    (tmp_path / "b.json").write_text('{"train": {"top_k": 3}}')
    (tmp_path / "c.yml").write_text("")
    layers = [config.read_settings(str(tmp_path / n)) for n in ("a.yaml", "b.json", "c.yml")]
    told = config.merged(*layers, *map(config.override, ["train.top_k=4", "+mixer.adapt_domain=legal", "train.timeout_s=null", "mixer.seed=7"]))
    run = config.build(config.RunConfig, told, strict=True)
    assert (run.train.pool_size, run.train.top_k, run.train.timeout_s, run.mixer.adapt_domain, run.mixer.seed) == (8, 4, None, "legal", 7)
    for bad in ("train.top_k", "=3"):
        with pytest.raises(ValueError, match="name=value"):
            config.override(bad)
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.read_settings(str(tmp_path / "d.json"))


def test_traces_are_read_in_order_across_splits(spark, tmp_path):
    rows = [(i // 10, f"h{i}", "o", 0, 0.5, 1.0, i % 10) for i in range(3000)]
    lines = [json.dumps(dict(zip(("step", "content_hash", "origin", "origin_tag", "rho", "target_loss", "rank"), r))) for r in rows]
    for part in (0, 1):
        (tmp_path / f"p{part}.jsonl").write_text("\n".join([*lines[1500 * part : 1500 * part + 700], "", *lines[1500 * part + 700 : 1500 * part + 1500]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        found = corpus.read_trace(spark, [str(tmp_path)])
        assert found.rdd.getNumPartitions() > 4
        assert [r["content_hash"] for r in found.orderBy("phase", "file", "line").collect()] == [r[1] for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_collate_needs_tags_and_losses_on_all_rows_or_none(spark):
    from millrace.operators import collate

    schema = "step long, block_id long, origin string, origin_tag int, content_hash string, ref_loss double"
    good = spark.createDataFrame([(0, 1, None, 0, "a", 1.0), (0, 2, "o", 1, None, 2.0), (1, 3, "o", 1, "c", None), (None, 4, "o", 0, "d", None)], schema)
    got = {r["block_id"]: r for r in collate.collated(good).collect()}
    assert got[1]["origin"] == "unknown" and got[2]["content_hash"] == "" and got[3]["ref_loss"] is None and len(got) == 4
    assert collate.collated(good.limit(0)).count() == 0
    for row, what in (((0, 5, "o", 1, "e", None), "ref_loss"), ((0, 5, "o", None, "e", 1.0), "origin_tag")):
        with pytest.raises(Exception, match=f"{what} is missing"):
            collate.collated(good.union(spark.createDataFrame([row], schema))).collect()
    bare = collate.samples(spark.createDataFrame([(7, [1, 2, 3])], "block_id long, token_ids array<int>")).first()
    assert (bare["idx"], bare["length"], bare["origin"], bare["origin_tag"], bare["content_hash"], bare["ref_loss"], bare["token_mask"]) == (7, 3, "unknown", 0, "", None, [1.0] * 3)


def test_cluster_sessions_need_a_shared_folder():
    from millrace.sources import shared

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_globs_honour_their_whole_pattern(spark, tmp_path):
    """The same files as Python's recursive glob."""
    import glob

    for name in ("raw/a/train-1/x.parquet", "raw/a/val-1/x.parquet", "raw/a/notes/x.parquet", "raw/b/c/train-2/y.parquet", "raw/train-3/z.parquet", "raw/b1.parquet", "raw/b2.parquet", "raw/c[1].parquet", "raw/.hidden/x.parquet", "raw/a/.x.parquet", "raw/a/b{1}.parquet", "raw/a/deep/er/b9.parquet", "raw/a/data.txt", "raw/a+b/x.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    for pattern in (
        "**/*.parquet", "**/train-*/*.parquet", "*/train-*/*.parquet", "a/**/*.parquet", "a/**/b*.parquet", "*/x/**", "*/**/y.parquet", "b[12].parquet", "b?.parquet", "b[!1].parquet", "c[[]1].parquet", "[!b]*.parquet", "*", "**",
        "a/*/x.parquet", "**/.x.parquet", ".hidden/*", "**/b{1}.parquet", "a+b/*", "**/deep/**/*.parquet", "none/*.parquet", "**/er/*", "*/*/*/*.parquet", "[a-b]/c/**/*.parquet", "b1.parquet",
    ):
        want = sorted(f for f in glob.glob(f"{tmp_path}/raw/{pattern}", recursive=True) if f.endswith(".parquet") and (tmp_path / f).is_file())
        try:
            got = [f.split("file:")[1] for f in corpus.list_files(spark, f"{tmp_path}/raw/{pattern}")]
        except FileNotFoundError:
            got = []
        if pattern != "*":
            assert got == want, pattern
        else:
            assert set(want) <= set(got)  # folders that fit stand for the files in them


def test_a_bare_session_gets_a_folder(tmp_path):
    """Spark without spark.checkpoint.dir: entry() and the command line."""
    import os
    import subprocess
    import sys

    (tmp_path / "conf").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / 'w')!r}).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
from millrace.__main__ import main
from millrace.sources.shared import shared_dir
assert __spark_entry__.entry(spark).count() > 0
for domain in ("a", "b"):
    spark.createDataFrame([(" ".join(["w", domain] * 30),)], "text string").write.parquet({str(tmp_path)!r} + f"/raw/{{domain}}/o{{domain}}")
main(["ingest", "--adapt-glob", {str(tmp_path)!r} + "/raw/a/**/*.parquet", "--replay-glob", {str(tmp_path)!r} + "/raw/b/**/*.parquet", "--out", {str(tmp_path)!r} + "/blocks", "--block-size", "16"], spark)
assert shared_dir(spark) == shared_dir(spark)
print("blocks", spark.read.parquet({str(tmp_path)!r} + "/blocks").count())
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_SUBMIT")} | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "blocks 6" in done.stdout, done.stderr[-2000:]


def test_files_without_the_text_column_have_no_rows(spark, tmp_path):
    spark.createDataFrame([("a",), (None,), ("",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(1,)], "other int").coalesce(1).write.parquet(f"{tmp_path}/two")
    assert [tuple(r)[0::3] for r in corpus.read_documents(spark, f"{tmp_path}/**/*.parquet", "all").collect()] == [("one", "a")]


def test_conversations_mask_the_roles_that_count(spark):
    from millrace.operators import collate

    rows = [(1, 2, "assistant", [5, 6]), (1, 1, "user", [4]), (1, 3, None, [7]), (2, 1, "assistant", None), (3, 1, "tool", [8])]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, tokens array<int>")
    got = {r["conv_id"]: (r["token_ids"], r["token_mask"]) for r in collate.conversations(turns, ("assistant", "tool")).collect()}
    assert got == {1: ([4, 5, 6, 7], [0.0, 1.0, 1.0, 0.0]), 2: ([], []), 3: ([8], [1.0])}


def test_only_plans_that_do_more_than_scan_are_stored(spark, tmp_path):
    from millrace.sources import shared

    spark.range(50).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    few = rows.where("id > 3").select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    assert shared.kept(few, "t") is few
    for more in (rows.groupBy("id").count(), rows.join(few, "id"), rows.repartition(2), spark.range(3)):
        found = shared.kept(more, "t")
        assert found is not more and sorted(found.collect()) == sorted(more.collect())


def test_a_step_scores_and_ranks_its_pool_once(spark, monkeypatch, tmp_path):
    """What follows reads stored rows: neither a plan that is kept in memory nor
    the scorer's or the ranking's is part of it."""
    from millrace.operators.scoring import FixedScorer

    seen, real = [], train.step_metrics
    note = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString())

    class Noting(FixedScorer):
        def update(self, selected):
            note(selected)

    monkeypatch.setattr(train, "step_metrics", lambda pool, *rest: (note(pool), real(pool, *rest))[1])
    rows = spark.createDataFrame([([i, 2 * i, 3], "o", i % 2, f"{i:04x}", i, 0.5) for i in range(24)], "token_ids array<int>, origin string, origin_tag int, content_hash string, block long, ref_loss double")
    state = train.train_loop(rows, None, Noting(lambda t: -(t % 7).cast("double")), config.TrainConfig(pool_size=8, top_k=3, log_selected=True), out=str(tmp_path / "run"))
    assert len(seen) == 2 * state.total_steps == 6 and state.total_valid_tokens == 3 * 3 * 3
    assert not [plan for plan in seen if "InMemoryRelation" in plan or "Window" in plan or "transform" in plan]
    assert train.run_trace(spark, str(tmp_path / "run")).count() == 9


def test_the_driver_lets_go_of_a_step_when_it_ends(spark):
    """Not once its heap is full: what only a finished step referred to is gone
    two steps on, even what the driver's collector holds to be long-lived."""
    jvm, refs, gone = spark._jvm, [], []

    class Watched(UnigramScorer):
        def update(self, selected):
            gone.extend(r.refersTo(None) for r in refs)
            time.sleep(2)  # Python tells the JVM once a second what it has dropped
            if not refs:
                held = jvm.java.lang.Object()
                refs.append(jvm.java.lang.ref.WeakReference(held))
                jvm.System.gc()  # it is old now: collections of young objects leave it

    rows = spark.range(18).select(F.col("id").alias("block"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.array(F.lit(1), (F.col("id") % 5).cast("int")).alias("token_ids"), F.lit("o").alias("origin"), F.lit(1).alias("origin_tag"), F.lit(0.0).alias("ref_loss"))
    state = train.train_loop(rows, None, Watched(8), config.TrainConfig(pool_size=6, top_k=2))
    assert state.total_steps == 3 and state.total_valid_tokens == 12 and gone[-1]
