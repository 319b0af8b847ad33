"""The toxicity network: its gradients, its windows, and what it finds."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import toxicity as tx
from millrace.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, _row string, _text string, score int"


def texts(n, seed=1):
    """Prose of made-up words; every third text holds an insult or a word that
    begins like one."""
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 8))) for _ in range(300)]
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        own = list(rng.choice(vocabulary, rng.integers(5, 120)))
        if i % 3 == 0:
            own[rng.integers(len(own))] = ("Scoundrel", "zxq" + rng.choice(vocabulary))[i % 2]
        out.append(" ".join(own))
    return out, [i % 3 == 0 for i in range(n)]


@pytest.fixture(scope="module")
def net():
    return tx.fit(*texts(900), 1 / 3)


def slow_score(net, text):
    """A step at a time, a window at a time, in double precision."""
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    own, best = tx.words(text), []
    for at in tx.starts(len(own)):
        some = own[at : at + tx.WINDOW]
        if not some:
            return net.share
        x = []
        for word in some:
            known = [net.grams[g] for g in tx.grams(word) if g in net.grams]
            x.append(np.concatenate([w["words"][net.words.get(word, 0)], w["chars"][known].mean(axis=0) if known else np.zeros(tx.CHAR_DIM)]))
        h = [None, None]
        for d in (0, 1):
            state, h[d] = np.zeros(tx.HIDDEN), []
            for v in x if d == 0 else x[::-1]:
                g, u = v @ w["in"][d] + w["gates"][d], state @ w["state"][d]
                z, r = (1 / (1 + np.exp(-(g + u)[k * tx.HIDDEN : (k + 1) * tx.HIDDEN])) for k in (0, 1))
                n = np.tanh(g[2 * tx.HIDDEN :] + r * u[2 * tx.HIDDEN :])
                state = (1 - z) * n + z * state
                h[d].append(state)
        both = np.array([np.concatenate(p) for p in zip(h[0], h[1][::-1])])
        a = np.exp(np.tanh(both @ w["attend"] + w["attend_bias"]) @ w["query"])
        best.append(1 / (1 + np.exp(-((a / a.sum()) @ both @ w["out"] + w["bias"][0]))))
    return max(best)


def test_scores_equal_brute_force(net):
    own, _ = texts(40, seed=5)
    own += ["", "...", "one", " ".join(own), "É" * 50]
    got = list(tx.Scorer(net).scores(own))
    assert np.allclose(got, [slow_score(net, t) for t in own], atol=1e-4)


@settings(deadline=None)
@given(st.lists(st.text("ab1é日𝒳", max_size=60)), st.sets(st.text("<ab1é日𝒳>", min_size=3, max_size=5)))
def test_ngrams_are_looked_up_for_many_words_at_once(own, known):
    """The same numbers in the same order as word by word, and no work in
    Python for each n-gram of a text."""
    net = tx.fresh(["a", "ab"], sorted(g for g in known | {"<ab", "ab>", "<ab1>", "日𝒳é"} if len(g) in tx.GRAMS), 0.5)
    want = [[g for g in map(net.grams.get, tx.grams(w)) if g is not None] for w in own]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tx, "grams", None)
        number, flat, n = net.inputs(own)
    assert number.tolist() == [net.words.get(w, 0) for w in own] and n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_unseen_texts_are_told_apart(net):
    own, toxic = texts(120, seed=9)
    got = np.array(list(tx.Scorer(net).scores(own))) >= 0.7
    assert (got == np.array(toxic)).mean() > 0.9


def test_gradients():
    own, _ = texts(6)
    known = sorted({w for t in own for w in tx.words(t)})[:50]
    net = tx.fresh(known, sorted({g for w in known for g in tx.grams(w)})[:80], 0.5)
    for k, v in net.weights.items():
        net.weights[k] = v.astype(np.float64)
    vocabulary = sorted({w for t in own for w in tx.words(t)})
    number = {w: i for i, w in enumerate(vocabulary)}
    cut = [tx._windows(np.array([number[w] for w in tx.words(t)])) for t in own]
    ids, mask = (np.concatenate([c[i] for c in cut]) for i in (0, 1))
    inputs, rng = net.inputs(vocabulary), np.random.default_rng(0)
    pull = rng.normal(size=len(ids))
    loss = lambda: float(pull @ net.forward(net.projected(*inputs)[1], ids, mask)[0])
    x, gates = net.projected(*inputs)
    _, kept = net.forward(gates, ids, mask, keep=True)
    found = net.backward(pull.astype(np.float32), kept, ids, mask, x, inputs)
    for name, w in net.weights.items():
        for at in rng.choice(w.size, min(4, w.size), replace=False):
            at = np.unravel_index(at, w.shape)
            was, step = w[at], 2e-2
            w[at] = was + step
            up = loss()
            w[at] = was - step
            down = loss()
            w[at] = was
            assert abs((up - down) / (2 * step) - found[name][at]) < 2e-2 * (1 + abs(found[name][at])), name


@settings(deadline=None)
@given(st.integers(0, 500))
def test_windows_overlap_by_half_and_miss_nothing(n):
    at = tx.starts(n)
    seen = np.zeros(max(n, 1), dtype=int)
    for a in at:
        seen[a : a + tx.WINDOW] += 1
    assert seen.all() and at[0] == 0 and (np.diff(at) <= tx.WINDOW // 2).all() and at[-1] + tx.WINDOW >= n


@settings(deadline=None)
@given(st.integers(0, 400), st.integers(20, 300))
def test_pieces_of_a_long_text_hold_its_windows(n, size):
    own = [f"w{i}" for i in range(n)]
    windows = lambda some: {tuple(some[a : a + tx.WINDOW]) for a in tx.starts(len(some))}
    found = [windows(p) for p in tx.pieces_of(" ".join(own), size)]
    assert windows(own) <= set().union(*found) or n == 0


def test_texts_over_several_batches_and_words_forgotten(net, monkeypatch):
    own, _ = texts(60, seed=4)
    whole = list(tx.Scorer(net).scores(own))
    monkeypatch.setattr(tx, "HELD_TEXT", 200)
    monkeypatch.setattr(tx, "HELD_WORDS", 50)
    assert np.allclose(list(tx.Scorer(net).scores(own)), whole, atol=1e-5)


def test_odd_rows(spark, net):
    own, _ = texts(6, seed=2)
    rows = [(1, own[0]), (1, own[0]), (2, None), (3, ""), (None, own[1]), (4, " \n\t"), (5, " ".join(own) * 400), (5, "other")]
    table = spark.createDataFrame([(i, t, "en", "r", "t", 3) for i, t in rows], DOCS)
    got = tx.score(table, net).collect()
    assert got[0].asDict().keys() == {*table.columns, "_toxicity"} and got[0]["score"] == 3 and len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r["_toxicity"] for r in got}
    assert by[2, None]["score"] == by[3, ""]["score"] == by[4, " \n\t"]["score"] == pytest.approx(1 / 3)
    assert all(0 <= t["score"] <= 1 and t["predicted"] == (t["score"] >= 0.7) for t in by.values())
    assert by[1, own[0]]["score"] == pytest.approx(slow_score(net, own[0]), abs=1e-4)
    assert by[5, " ".join(own) * 400]["score"] >= by[1, own[0]]["score"] - 1e-4
    assert tx.score(spark.createDataFrame([], DOCS), net).count() == 0


def test_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for some, share in ((labels, 0.0), (labels.where("toxic = 1"), 0.0), (labels.selectExpr("doc_id", "1 as toxic"), 1.0)):
        with pytest.warns(UserWarning, match="both classes"):
            net = tx.train(tx.training_sample(docs, some))
        assert {r["_toxicity"]["score"] for r in tx.score(docs, net).collect()} == {share}


def test_sample_is_bounded_and_leaves_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(tx, "TRAIN_TOXIC", 5)
    monkeypatch.setattr(tx, "TRAIN_CLEAN", 9)
    monkeypatch.setattr(tx, "TRAIN_CHARS", 10)
    docs = spark.createDataFrame([(i, f"{i} " * 30) for i in range(80)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(80)] * 2 + [(None, True), (7, None)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    own, toxic, share = tx.training_sample(docs, labels)
    assert sum(toxic) == 5 and len(own) == 14 and max(map(len, own)) <= 10 and share == 0.25


def test_query_on_held_out_documents(spark):
    """Held-out labels of sf0.01, and which rows are held out."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    told = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    toxic, clean = ([p for p, y in told if y == k] for k in (1, 0))
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.05
