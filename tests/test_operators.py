"""Operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, names
from millrace.functions.hashing import content_hash, hash01
from millrace.operators import cache as caching
from millrace.operators import curriculum, merge, metrics, mixer, packing, sampling, scoring, selection, validation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs(spark, rows):
    return frame(spark, rows, "domain string, origin string, part string, doc long, tokens array<int>")


def packed(df):
    return [r["token_ids"] for r in df.orderBy("domain", "origin", "block").collect()]


def test_packing_ends_documents_and_drops_the_partial_block(spark):
    two = docs(spark, [("d", "o", "", 0, [5, 6, 7]), ("d", "o", "", 1, [8, 9])])
    assert packed(packing.pack(two, 3, 0)) == [[5, 6, 7], [0, 8, 9]]
    assert packed(packing.pack(two, 3, 0, keep_partial=True)) == [[5, 6, 7], [0, 8, 9], [0]]
    with pytest.raises(ValueError):
        packing.pack(two, 0, 0)


def test_packing_equals_a_plain_loop_in_any_row_order(spark):
    import random

    rng = random.Random(3)
    rows = [("d", f"o{rng.randint(0, 2)}", f"f{i % 3}", i * 40_000, [rng.randint(1, 99) for _ in range(rng.choice([0, 1, 3, 50]))]) for i in range(60)]
    want = []
    for origin in ("o0", "o1", "o2"):
        stream = [t for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[1] == origin for t in [*r[4], 0]]
        want += [stream[i : i + 7] for i in range(0, len(stream) - 6, 7)]
    assert packed(packing.pack(docs(spark, rows), 7, 0)) == want
    rng.shuffle(rows)
    assert packed(packing.pack(docs(spark, rows), 7, 0)) == want


def test_hashes(spark):
    import hashlib
    import json

    row = frame(spark, [("ö/\"x", [1, 2, 3])], "origin string, token_ids array<int>").select(content_hash(F.col("origin"), F.col("token_ids")).alias("h"), hash01("s:1", F.col("origin")).alias("u")).first()
    assert row["h"] == hashlib.sha256(json.dumps({"origin": "ö/\"x", "token_ids": [1, 2, 3]}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert row["u"] == int(hashlib.sha256("s:1:ö/\"x".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF


def test_names(spark):
    rows = frame(spark, [("Nemotron-CC-Math-v1",), ("CaseHOLD",), ("  nemotron-x ",), ("--",), ("",)], "n string")
    assert [r[0] for r in rows.select(names.clean_origin(F.col("n"))).collect()] == ["math_v1", "casehold", "x", "unknown", "unknown"]
    assert rows.limit(1).select(names.corpus_name(F.lit(7)), names.origin_key(F.lit(" a b/c ")), names.metric_safe(F.lit("a b/é-"))).first()[:] == ("tag7", "a_b_c", "a_b_é-")


def blocks(spark, sizes):
    rows = [("d", o, i, f"{o}{i:05d}", 0 if o.startswith("a") else 1) for o, n in sizes.items() for i in range(n)]
    return frame(spark, rows, "domain string, origin string, block long, content_hash string, origin_tag int")


def test_holdout_sizes_and_order(spark):
    rows = blocks(spark, {"big": 1000, "small": 10, "one": 1})
    split = sampling.split_holdout(rows, 0.01, floor=5)
    held = lambda df: {r["content_hash"] for r in df.where("split = 'holdout'").collect()}
    assert {r["origin"]: r["n"] for r in split.where("split = 'holdout'").groupBy("origin").agg(F.count("*").alias("n")).collect()} == {"big": 10, "small": 2}
    assert held(split) == held(sampling.split_holdout(rows.orderBy(F.desc("content_hash")), 0.01, floor=5))
    with pytest.raises(ValueError):
        sampling.split_holdout(rows, 1.0)


def test_balance_and_caps(spark):
    rows = blocks(spark, {"a": 2000, "r1": 4000, "r2": 4000})
    kept = {r["origin"]: r["n"] for r in sampling.balance_replay(rows).groupBy("origin").agg(F.count("*").alias("n")).collect()}
    assert kept["a"] == 2000 and abs(kept["r1"] + kept["r2"] - 2000) < 150 and abs(kept["r1"] - kept["r2"]) < 150
    assert sampling.balance_replay(blocks(spark, {"a": 5, "r": 3})).count() == 8
    capped = sampling.cap_per_origin(blocks(spark, {"big": 50, "small": 3}), 10)
    assert {r["origin"]: r["n"] for r in capped.groupBy("origin").agg(F.count("*").alias("n")).collect()} == {"big": 10, "small": 3}
    assert sampling.cap_per_origin(rows, None) is rows and sampling.cap_per_origin(rows, 0) is rows


def test_cache_join_drops_misses_or_fails(spark):
    rows = blocks(spark, {"a": 4})
    cache = frame(spark, [("a00000", 1.0, "f1", 0), ("a00000", 9.0, "f2", 0), ("a00001", 2.0, "f1", 1)], "content_hash string, ref_loss double, part string, row long")
    assert caching.conflicts(cache).collect()[0]["content_hash"] == "a00000"
    one = caching.dedup_cache(cache)
    assert {r[0]: r[1] for r in one.collect()} == {"a00000": 1.0, "a00001": 2.0}
    with pytest.raises(RuntimeError, match="2 of 4"):
        caching.join_ref_loss(rows, one)
    assert sorted(r["ref_loss"] for r in caching.join_ref_loss(rows, one, 0.5).collect()) == [1.0, 2.0]


def test_replay_share(spark):
    rows = blocks(spark, {"a": 10, "r": 40}).withColumn("domain", F.when(F.col("origin") == "a", "x").otherwise("y")).withColumn("split", F.lit("train"))
    for share, n in ((1.0, 50), (0.25, 20), (0.0, 10), (-1, 10), (0.001, 10)):
        assert mixer.choose_domains(rows, "x", share).count() == n


POOL = [(0, i, r, t, m) for i, (r, t, m) in enumerate([(0.9, 0, 1.0), (0.7, 0, 1.0), (0.2, 0, 1.0), (0.1, 0, 1.0), (0.8, 1, 1.0), (0.6, 1, 1.0), (0.05, 1, 1.0), (0.0, 1, 1.0)])]
POOL_SCHEMA = "step long, block_id long, rho double, origin_tag int, sample_mask double"


def picked(spark, rows, *args, **kw):
    return [r["block_id"] for r in selection.select(frame(spark, rows, POOL_SCHEMA), *args, **kw).orderBy("step", "sel_rank").collect()]


def test_selection_strategies(spark):
    assert picked(spark, POOL, 4) == [0, 4, 1, 5]
    got = picked(spark, POOL, 4, "fixed_ratio_rho", 0.25)
    assert got == [0, 1, 2, 4]
    got = picked(spark, POOL, 4, "replay_only_rho", 0.25)
    assert got[3] == 4 and set(got[:3]) < {0, 1, 2, 3}
    got = picked(spark, POOL, 4, "fixed_ratio", 0.25)
    assert sum(i > 3 for i in got) == 1 and got == picked(spark, POOL[::-1], 4, "fixed_ratio", 0.25)
    with pytest.raises(ValueError):
        picked(spark, POOL, 4, "best")
    with pytest.raises(ValueError):
        selection.select(frame(spark, POOL, POOL_SCHEMA).drop("origin_tag"), 4, "fixed_ratio")


def test_selection_leaves_padding_and_fills_up(spark):
    nan, inf = float("nan"), float("inf")
    assert picked(spark, [(0, 0, 5.0, 0, 0.0), (0, 1, 0.1, 0, 1.0), (0, 2, 0.2, 0, 1.0), (0, 3, 9.0, 0, 0.0)], 3) == [2, 1]
    assert picked(spark, [(0, 0, 5.0, 0, 0.0), (0, 1, nan, 0, 1.0), (0, 2, inf, 0, 1.0), (0, 3, None, 0, 1.0)], 3) == []
    short = [(0, 0, 0.0, 0, 1.0)] + [(0, i, 0.0, 1, 1.0) for i in range(1, 5)]
    got = picked(spark, short, 4, "fixed_ratio_rho", 0.25)
    assert got[0] == 0 and len(got) == 4


def test_losses(spark):
    rows = frame(spark, [(0, [-1.0, -2.0, -3.0], [1.0, 1.0, 1.0], 1.0), (1, [-1.0, -3.0, -100.0], [1.0, 1.0, 0.0], 1.0), (2, [-9.0, -9.0, -9.0], [1.0, 1.0, 1.0], 0.0), (3, [], [], 1.0)], "i int, lp array<double>, tm array<double>, sm double")
    got = [r[0] for r in rows.select(arrays.target_loss(F.col("lp"), F.col("tm"), F.col("sm"))).collect()]
    assert got == [2.0, 2.0, 0.0, 0.0] and str(got[2]) == "0.0"


def test_validation_means_do_not_depend_on_shards(spark):
    rows = frame(spark, [(i, i % 3, float(i), None if i % 4 == 0 else 1.0, i % 2, 0.0 if i == 5 else 1.0, f"o {i % 2}") for i in range(12)], "i int, shard int, target_loss double, ref_loss double, origin_tag int, sample_mask double, origin string")
    whole = validation.corpus_means(validation.corpus_sums(rows)).first()
    assert whole == validation.corpus_means(validation.corpus_sums(rows, ("shard",))).first()
    assert whole["target_loss_adapt"] == 5.0
    assert {r["origin"]: r["n"] for r in validation.loss_by_origin(rows).collect()} == {"o_0": 6, "o_1": 5}
    assert validation.validation_loss(rows.withColumn("batch", F.col("shard"))).first()["val_loss"] == pytest.approx(sum(i for i in range(12) if i != 5) / 11)
    assert validation.validation_loss(rows.limit(0).withColumn("batch", F.col("shard"))).first()["val_loss"] == 0.0


def test_metrics_of_a_step(spark):
    pool = frame(spark, POOL, POOL_SCHEMA).withColumn("target_loss", F.col("rho") + 1).withColumn("origin", F.lit("o"))
    marked = selection.flagged(pool, selection.select(pool, 4))
    row = metrics.selection_metrics(marked).first()
    assert (row["n_selected_adapt"], row["n_selected_replay"], row["k_effective"], row["frac_selected_adapt"]) == (2, 2, 4, 0.5)
    assert row["rho_mean_selected"] == pytest.approx(0.75) and row["frac_rho_replay_above_zero"] == 0.75
    adapt = metrics.selection_metrics(marked.where("origin_tag = 0")).first()
    assert adapt["rho_mean_replay"] != adapt["rho_mean_replay"] and adapt["frac_selected_replay"] == 0
    assert metrics.selection_metrics(marked.withColumn("sample_mask", F.lit(0.0))).count() == 0
    assert metrics.rho_percentiles(pool).where("corpus = 'adapt'").first()["p50"] == pytest.approx(0.45)
    assert {r["metric"] for r in metrics.long_table(metrics.selection_metrics(marked)).collect()} >= {"selection/k_effective", "rho/rho_mean_adapt", "loss/ref_loss_replay", "selection_sanity/rho_mean_dropped"}
    scores = metrics.score_metrics(pool)
    assert scores.columns == ["step", "candidate_loss", "num_valid_candidates"]


def test_curriculum(spark):
    rows = frame(spark, [("d", "o", i, h) for i, h in enumerate(["aa", "ab", "ca", "cd", "aa"])], "domain string, origin string, block long, content_hash string")
    seen = [(0, "f", 0, 1, "ab"), (0, "f", 1, 2, "cd"), (0, "f", 2, 2, "ca"), (1, "f", 0, 1, "aa")]
    trace = frame(spark, seen, "phase int, file string, line long, step long, content_hash string")
    got = curriculum.build_curriculum(rows, trace).collect()
    assert [r["content_hash"] for r in got] == ["ab", "cd", "ca", "aa"] and got[-1]["block"] == 4
    with pytest.raises(ValueError):
        curriculum.build_curriculum(rows, trace, 2)
    with pytest.raises(RuntimeError):
        curriculum.build_curriculum(rows.where("block < 2"), trace)
    again = frame(spark, [(0, "a", 0, 1, "x"), (0, "a", 1, 1, "y"), (0, "a", 2, 2, "z"), (0, "b", 0, 2, "w"), (0, "b", 1, 1, "v")], "phase int, file string, line long, step long, content_hash string")
    assert [(r["step"], r["content_hash"]) for r in curriculum.restarted(again).orderBy("step", "pos").collect()] == [(1, "v"), (2, "z"), (2, "w")]
    assert [(r["step"], r["content_hash"]) for r in curriculum.last_batch(again, 2).orderBy("step", "pos").collect()] == [(1, "y"), (1, "v"), (2, "z"), (2, "w")]


def test_merge(spark):
    schema = "name string, dtype string, shape array<int>, values array<float>"
    base = frame(spark, [("a", "float32", [2], [0.0, 4.0]), ("b", "int8", [1], [1.0]), ("c", "float32", [1], [1.0])], schema)
    other = frame(spark, [("a", "float32", [2], [8.0, 0.0]), ("b", "int8", [1], [9.0]), ("c", "float32", [2], [9.0, 9.0])], schema)
    got = {r["name"]: (r["values"], r["merged"]) for r in merge.merge_weights(base, other, 0.25).collect()}
    assert got == {"a": ([2.0, 3.0], True), "b": ([1.0], False), "c": ([1.0], False)}
    with pytest.raises(ValueError):
        merge.merge_weights(base, other, 1.5)


def test_unigram_scorer_learns(spark):
    rows = frame(spark, [([1, 1, 2],), ([3, 3, 3],)], "token_ids array<int>")
    scorer = scoring.UnigramScorer(5)
    before = [r["target_loss"] for r in scoring.with_target_loss(rows, scorer).collect()]
    scorer.update(rows.limit(1))
    after = [r["target_loss"] for r in scoring.with_target_loss(rows, scorer).collect()]
    assert before[0] == pytest.approx(1.6094379) and after[0] < before[0] and after[1] > before[1]
    with pytest.raises(ValueError):
        scoring.UnigramScorer(scoring.MAX_VOCABULARY + 1)


def test_spread(spark):
    files = frame(spark, [([f"{i:02d}" for i in range(10)],)], "f array<string>")
    for n, want in ((0, []), (3, ["00", "03", "06"]), (10, [f"{i:02d}" for i in range(10)]), (99, [f"{i:02d}" for i in range(10)]), (1, ["00"])):
        assert files.select(arrays.pick_spread(F.col("f"), F.lit(n))).first()[0] == want


def tiny_model(table):
    """An ONNX file, byte by byte: each token's row of the table is its logits."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(at, value):
        return number(at << 3) + number(value) if isinstance(value, int) else number(at << 3 | 2) + number(len(value)) + value

    rows, columns = table.shape
    shape = lambda *dims: b"".join(field(1, field(2, d) if isinstance(d, bytes) else field(1, d)) for d in dims)
    info = lambda name, kind, *dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, shape(*dims))))
    node = field(1, b"table") + field(1, b"ids") + field(2, b"logits") + field(4, b"Gather")
    values = struct.pack(f"<{rows * columns}f", *table.ravel().tolist())
    tensor = field(1, rows) + field(1, columns) + field(2, 1) + field(8, b"table") + field(9, values)
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, info(b"ids", 7, b"b", b"n")) + field(12, info(b"logits", 1, b"b", b"n", columns))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_an_onnx_model_scores_each_token_from_those_before(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    import numpy as np

    from millrace.operators.scoring import OnnxScorer, with_target_loss

    table = np.random.default_rng(3).normal(size=(20, 20)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(tiny_model(table))
    rng = np.random.default_rng(4)
    blocks = {i: rng.integers(0, 20, n).tolist() for i, n in enumerate([8, 8, 8, 5, 5, 1, 0, 12])}
    rows = spark.createDataFrame(list(blocks.items()), "block_id long, token_ids array<int>")
    scorer = OnnxScorer(str(tmp_path / "m.onnx"), batch=2)
    logprob = table - np.log(np.exp(table).sum(axis=1, keepdims=True))
    for r in with_target_loss(rows, scorer).collect():
        ids = blocks[r["block_id"]]
        want = -np.mean([logprob[a, b] for a, b in zip(ids, ids[1:])]) if len(ids) > 1 else 0.0
        assert r["target_loss"] == pytest.approx(want, abs=1e-5)
    assert scorer.update(rows) is None and "token_logprobs" in scorer.logprobs(rows).columns


def test_lowest_rows_order_only_the_range_at_the_bound(spark, tmp_path):
    """Against ranks of all rows; null groups, groups below and at their bound,
    none and all kept; no window over rows beside the range at the bound."""
    from millrace.operators.ranking import lowest_marked, ranked

    rows = spark.range(4000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.least(F.col("id") % 7, F.lit(3)).cast("string"))).alias("g"), F.sha2((F.col("id") % 3900).cast("string"), 256).alias("h"))
    rows.write.parquet(str(tmp_path / "t"))
    table, digits = spark.read.parquet(str(tmp_path / "t")), F.substring("h", 1, 8)
    for by in ((), ("g",)):
        for keep in (0, 1, 100, 571, 572, 4000, 9999):
            want = {r["id"] for r in ranked(table, digits, ("id",), by).where(F.col("_rank") <= keep).collect()}
            got = lowest_marked(table, lambda _: F.lit(keep).cast("long"), digits, ("id",), by).collect()
            assert len(got) == 4000 and {r["id"] for r in got if r["_low"]} == want, (by, keep)
    share = lowest_marked(table, lambda n: F.floor(n / 10), digits, ("id",), ("g",))
    assert {r["g"]: r["n"] for r in share.where("_low").groupBy("g").agg(F.count("*").alias("n")).collect()} == {r["g"]: r["n"] // 10 for r in table.groupBy("g").agg(F.count("*").alias("n")).collect()}
    # the rows that the window gets are filtered to the range first
    plan = share._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "_edge" in plan[plan.index("Window") :]
    assert lowest_marked(table.limit(0), lambda _: F.lit(3).cast("long"), digits, ("id",)).count() == 0
