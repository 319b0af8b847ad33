"""The n-gram scorer against counts in Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.ngram import NgramScorer, gram_counts
from millrace.operators.scoring import with_target_loss

SCHEMA = "name string, token_ids array<int>"


class Plain:
    def __init__(self, order, mass=4.0, space=1 << 17):
        self.order, self.mass, self.space, self.grams, self.contexts = order, mass, space, Counter(), Counter()

    def learn(self, blocks):
        for ids in blocks:
            for at, token in enumerate(ids):
                for n in range(min(at, self.order - 1) + 1):
                    ctx = tuple(ids[at - n : at])
                    self.grams[ctx, token] += 1
                    self.contexts[ctx] += 1

    def logprobs(self, ids):
        out = []
        for at, token in enumerate(ids):
            p = 1 / self.space
            for n in range(self.order):
                if n <= at:
                    ctx = tuple(ids[at - n : at])
                    p = (self.grams[ctx, token] + self.mass * p) / (self.contexts[ctx] + self.mass)
            out.append(math.log(p))
        return out


def rows(seed, n=30):
    return [[(seed * 7 + i * i + j * (j % 3 + seed)) % 11 * 1000003 for j in range(i % 9)] for i in range(n)]


def close(got, want):
    return len(got) == len(want) and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, want))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_losses_equal_brute_force_through_updates(spark, order):
    """Several updates, so that levels are merged; blocks that are alike, empty
    or hold ids that nothing was learnt of."""
    scorer, plain = NgramScorer(spark, order), Plain(order)
    asked = rows(2, 12) + [[], [5], [2**31 - 1, -7, 2**31 - 1]] + rows(2, 3)
    table = spark.createDataFrame([(str(i), ids) for i, ids in enumerate(asked)], SCHEMA)
    for seed in (None, 1, 2, 3, 4):
        if seed is not None:
            scorer.update(spark.createDataFrame([("", ids) for ids in rows(seed)], SCHEMA))
            plain.learn(rows(seed))
        got = {r["name"]: r["token_logprobs"] for r in scorer.logprobs(table).collect()}
        assert all(close(got[str(i)], plain.logprobs(ids)) for i, ids in enumerate(asked))
    assert len(scorer.levels) < 4 and scorer.tokens == sum(len(ids) for s in (1, 2, 3, 4) for ids in rows(s))
    assert sum(r["c"] for r in scorer.grams().collect()) == sum(plain.grams.values()) and scorer.grams().count() == len(plain.grams)


def test_probabilities_sum_to_one(spark):
    plain, ids = Plain(3, space=50), [3, 7, 3, 9, 3, 7, 7]
    plain.learn([ids])
    scorer = NgramScorer(spark, 3, space=50, blocks=spark.createDataFrame([("", ids)], SCHEMA))
    table = spark.createDataFrame([(str(t), [3, 7, t]) for t in range(50)], SCHEMA)
    got = [r["token_logprobs"][2] for r in scorer.logprobs(table).collect()]
    assert math.isclose(sum(map(math.exp, got)), 1.0, rel_tol=1e-9)


def test_copies_learn_apart_and_models_are_saved(spark, tmp_path):
    a = NgramScorer(spark, 2, blocks=spark.createDataFrame([("", [1, 2, 3])], SCHEMA))
    b = a.copy()
    for _ in range(3):
        b.update(spark.createDataFrame([("", [1, 2, 2])], SCHEMA))
    assert (a.tokens, b.tokens) == (3, 12) and {r["c"] for r in a.grams().collect()} == {1}
    b.save(spark, str(tmp_path / "m"))
    c = NgramScorer(spark, 2)
    c.load(spark, str(tmp_path / "m"))
    assert sorted(c.grams().collect()) == sorted(b.grams().collect()) and c.tokens == 12
    b.close()
    assert a.grams().count() == 5  # 1, 2, 3, 1 2, 2 3
    with pytest.raises(ValueError, match="order"):
        NgramScorer(spark, 0)


def test_loss_is_that_of_tokens_with_one_before(spark):
    scorer = NgramScorer(spark, 3, blocks=spark.createDataFrame([("", [1, 2, 3, 1, 2, 3])], SCHEMA))
    plain = Plain(3)
    plain.learn([[1, 2, 3, 1, 2, 3]])
    got = with_target_loss(spark.createDataFrame([("x", [1, 2, 3, 4])], SCHEMA), scorer).first()["target_loss"]
    assert math.isclose(got, -sum(plain.logprobs([1, 2, 3, 4])[1:]) / 3, rel_tol=1e-12)


def test_a_hot_gram_is_one_row_of_each_task(spark):
    """One token makes up all of a third of the blocks; it is counted before
    anything is shuffled."""
    table = spark.range(300).select(F.lit("").alias("name"), F.when(F.col("id") % 3 == 0, F.array_repeat(F.lit(1), 50)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: (i * 31 + F.col("id") * 7).cast("int"))).alias("token_ids"))
    plan = gram_counts(table, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # below the first exchange
    assert {(r["n"], r["c"]) for r in gram_counts(table, 3).where("token = 1").collect()} >= {(0, 5000), (1, 4900), (2, 4800)}


def test_no_count_table_is_broadcast(spark):
    """Counts lie in files, whose size is far below that of their rows in the
    driver's memory; small as they are here, none of them goes through it."""
    table = spark.createDataFrame([("a", [1, 2, 3, 1, 2]), ("b", [])], SCHEMA)
    found = NgramScorer(spark, 3, blocks=table).logprobs(table)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    assert len(found.collect()) == 2 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_grams_go_packed(spark):
    """What is shuffled and kept for 400,000 tokens, most of whose grams are
    distinct: before, a row of some 30 bytes for each gram and each place."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.pmod(F.xxhash64(F.col("id"), i), F.lit(700)) + 10).cast("int"))
    table = spark.range(6250).select(F.col("id").cast("string").alias("name"), ids.alias("token_ids"))
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    began = written()
    scorer = NgramScorer(spark, 3, blocks=table)
    assert scorer.logprobs(table).select(F.sum(F.size("token_logprobs"))).first()[0] == scorer.tokens == 400_000
    assert 0 < written() - began < 40 * 400_000
    scorer.close()


def test_contexts_are_hashed_as_spark_does(spark):
    """Models that were saved before hold such hashes."""
    table = spark.createDataFrame([("", ids) for ids in rows(3)] + [("", [2**31 - 1, -7, -7, 0, -(2**31)]), ("", None)], SCHEMA)
    assert sorted(NgramScorer(spark, 3, blocks=table).grams().collect()) == sorted(gram_counts(table, 3).collect())


@pytest.mark.parametrize("small", [1, 7])
def test_many_ranges_of_contexts(spark, monkeypatch, small):
    """As many as grams, and fewer; updates of other sizes have others."""
    from millrace.operators import ngram

    monkeypatch.setattr(ngram, "RANGE", small)
    scorer, plain = NgramScorer(spark, 3), Plain(3)
    for seed in (1, 2):
        scorer.update(spark.createDataFrame([("", ids) for ids in rows(seed, 6)], SCHEMA))
        plain.learn(rows(seed, 6))
    asked = [*rows(2, 5), [5, 5, 5], []]
    got = {r["name"]: r["token_logprobs"] for r in scorer.logprobs(spark.createDataFrame([(str(i), ids) for i, ids in enumerate(asked)], SCHEMA)).collect()}
    assert len(got) == len(asked) and all(close(got[str(i)], plain.logprobs(ids)) for i, ids in enumerate(asked))
    assert {(r["token"], r["c"]) for r in scorer.grams().where("n = 0").collect()} == {(t, c) for (ctx, t), c in plain.grams.items() if ctx == ()}


def test_lots_hold_each_row_once(monkeypatch):
    import pyarrow as pa

    from millrace.operators import ngram

    monkeypatch.setattr(ngram, "LOT", 10)
    sizes = [3, 0, None, 25, 9, 1, 1, 10, 0, 4, 4, 4]
    batch = pa.record_batch({"i": pa.array(range(len(sizes))), "token_ids": pa.array([n if n is None else [7] * n for n in sizes], pa.list_(pa.int32()))})
    lots = list(ngram._lots(iter([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)])))
    assert [i for lot in lots for i in lot["i"].to_pylist()] == list(range(len(sizes)))
    assert all(lot.num_rows == 1 or ngram._tokens(lot["token_ids"])[2].sum() <= 10 for lot in lots) and len(lots) < 9


def test_levels_are_summed_packed(spark):
    """A model of several levels is saved without a shuffled row for each gram."""
    big, small = [[(i * i * 31 + j * 7) % 97 for j in range(20)] for i in range(20)], [[1, 2, 3], [31, 38, 45]]
    scorer, plain = NgramScorer(spark, 3), Plain(3)
    for some in (big, small):
        scorer.update(spark.createDataFrame([("", ids) for ids in some], SCHEMA))
        plain.learn(some)
    found = scorer.grams()
    assert len(scorer.levels) == 2 and "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == len(plain.grams) and sum(r["c"] for r in got) == sum(plain.grams.values())
    asked = spark.createDataFrame([("x", [1, 2, 3, 31, 38, 45, 52, 96, 3])], SCHEMA)
    assert close(scorer.logprobs(asked).first()["token_logprobs"], plain.logprobs([1, 2, 3, 31, 38, 45, 52, 96, 3]))
