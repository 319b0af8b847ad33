"""Every query against its SQL, at the smallest scale."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.queries import QUERIES
from millrace.plans.sql import ORACLE_SQL
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["loop_resume", "run_snapshot"])
def test_loop_with_pools_too_large_to_list(spark, monkeypatch, name):
    """The same rows where tasks compute positions, as they do for pools of more
    than 65,536 rows."""
    from millrace.plans import train

    monkeypatch.setattr(train.Numbered, "LISTED", 4)
    same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def test_training_loop_equals_brute_force(spark):
    """The same loop in Python: score with the trigrams so far, take the best
    rows of each pool, add their tokens to the counts."""
    import hashlib

    import numpy as np

    from millrace.functions.permutation import EpochOrder
    from millrace.plans.queries import K, blocks
    from tests.test_ngram import Plain

    rows = [r.asDict() for r in blocks(spark, SF).collect()]
    numbered = sorted(rows, key=lambda r: (hashlib.sha256(f"order:42:{r['content_hash']}".encode()).hexdigest()[:8], r["content_hash"], r["origin"], r["block"]))
    order = [numbered[i] for i in EpochOrder(len(rows), "epoch:42:0").numbers(np.arange(len(rows)))]
    every, learnt = Plain(3), Plain(3)
    every.learn(r["token_ids"] for r in rows)
    learnt.learn(r["token_ids"] for r in rows if r["origin_tag"] == 1)
    loss = lambda model, r: -sum(model.logprobs(r["token_ids"])[1:]) / (len(r["token_ids"]) - 1)
    size, want = len(rows) // 8, {}
    for step in range(len(rows) // size):
        pool = order[step * size : (step + 1) * size]
        rho = np.array([loss(learnt, r) - loss(every, r) for r in pool])
        best = np.argsort(-rho, kind="stable")[:K]
        want |= {(step + 1, rank + 1): (pool[i]["content_hash"], rho[i]) for rank, i in enumerate(best)}
        learnt.learn(pool[i]["token_ids"] for i in best)
    got = {(r["step"], r["rank"]): (r["content_hash"], r["rho"]) for r in QUERIES["training_loop"](spark, SF).collect()}
    assert set(got) == set(want) and len({s for s, _ in got}) == 8
    assert all(abs(got[x][1] - want[x][1]) < 1e-9 for x in want)
    assert {(s, h) for (s, _), (h, _) in got.items()} == {(s, h) for (s, _), (h, _) in want.items()}


def test_training_loop_learns_from_a_share_of_all_rows(spark, monkeypatch, tmp_path):
    """Four times the rows, four times as many are selected and learnt; before,
    16 of each pool whatever its size. Tables are removed as the loop goes."""
    from millrace.plans import queries
    from millrace.sources.shared import folders, shared_dir

    table, n, learnt, stored = queries.table, {}, [], lambda: set(folders(spark, f"{shared_dir(spark)}/millrace"))
    monkeypatch.setattr(queries, "train_loop", lambda rows, val, scorer, cfg, out: (n.update(rows=rows.count(), cfg=cfg), learnt.append(scorer.tokens), queries_loop(rows, val, scorer, cfg, out=out), learnt.append(scorer.tokens)))
    from millrace.plans.train import train_loop as queries_loop

    def grown(session, sf, name):
        found = table(session, sf, name)
        return found if name != "documents" else found.crossJoin(session.range(4).withColumnRenamed("id", "_k")).withColumn("doc_id", F.col("doc_id") * 4 + F.col("_k")).drop("_k")

    monkeypatch.setattr(queries, "table", grown)
    began = stored()
    rows = QUERIES["training_loop"](spark, SF).collect()
    k = n["rows"] // 8 // queries.ONE_IN
    assert k >= 60 and n["cfg"].pool_size == n["rows"] // 8 and len(rows) == 8 * k
    assert learnt[1] - learnt[0] == 8 * k * 64
    assert {name.split("-")[0] for name in stored() - began} == {"run"}


def test_library_blocks_equal_brute_force(spark):
    """Ingestion with a public tokenizer: tokens, cuts and decoded lengths."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    piece, streams = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").orderBy("doc_id").collect():
        streams.setdefault(f"{r['lang']}_{r['source']}", []).extend([*piece.encode(r["text"]), 2])
    want = {}
    for origin, ids in streams.items():
        for b in range(len(ids) // 64):
            own = ids[64 * b : 64 * b + 64]
            want[origin, b] = (",".join(map(str, own)), len(piece.decode(own).encode()))
    rows = QUERIES["ingest_tokenizer"](spark, SF).collect()
    assert {(r["origin"], r["block"]): (r["token_ids"], r["n_bytes"]) for r in rows} == want
    assert {r["split"] for r in rows} == {"train", "holdout"}


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_the_other_queries_survive_without_the_operators(monkeypatch):
    import sys

    import __spark_entry__

    for broken in ("corpus_pipeline", "xxhash"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, broken, None)
            for name in [n for n in sys.modules if n == "corpus_pipeline" and broken != n or n.startswith("millrace.llm")]:
                m.delitem(sys.modules, name)
            with pytest.warns(UserWarning, match="without the training-data operators"):
                assert set(__spark_entry__.queries()) == set(QUERIES)
