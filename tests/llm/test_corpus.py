"""Decontamination, mixing and the pipeline."""

import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import decontaminate, line_dedup, mixing, quality_crf, shared, simhash_dedup, spans
from millrace.llm.queries import ORACLE_SQL, op5_decontaminate, op7_mixing
from tests.llm.test_dedup import line_brute, near_components
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def bags(text, items, least=0.8):
    """Brute force: every window of a text against every item, on hashed words."""
    words, out = decontaminate.word_hashes(text).tolist(), {}
    for key, item in items:
        want = decontaminate.word_hashes(item).tolist()
        if not want or not words:
            continue
        n, k = len(want), min(5, len(want))
        if len(words) < k:
            continue
        of = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        goal, size = of(want), min(n, len(words))
        if not set(of(words)) & set(goal):
            continue
        best = 0.0
        for at in range(len(words) - size + 1):
            got = of(words[at : at + size])
            both = sum((got & goal).values())
            best = max(best, both / (sum(got.values()) + sum(goal.values()) - both))
        if best >= least:
            out[key] = max(best, out.get(key, 0))
    return out


def tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return docs, items


def test_decontamination_equals_brute_force(spark):
    docs, items = tables(spark)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op5_decontaminate(spark, SF).collect()}
    want = {(i, k): s for i, t in docs for k, s in bags(t, items).items()}
    assert got == pytest.approx(want) and got


def test_changed_passages_are_found_and_others_left(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 60, 60, 45, 8, 3, 1])] + [(9, None), (None, "no id here"), (10, "  "), (0, "a second text of the same id " + " ".join(word() for _ in range(9)))]
    filler = lambda n: " ".join(word() for _ in range(n))
    swap = lambda t, k: " ".join(word() if i == k else w for i, w in enumerate(t.split()))
    texts = [
        filler(50) + " " + items[0][1].upper() + ", " + filler(20), filler(9) + " " + swap(items[1][1], 30) + " " + filler(9), swap(swap(swap(items[2][1], 10), 25), 40), items[3][1] + ".",
        " ".join(items[3][1].split()[:42]), filler(3) + " " + items[4][1], f"x {items[5][1]} y", items[6][1], filler(4000), None, "", " ", "one", items[10][1],
    ]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, texts[3], 5)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    known = [(k, t) for k, t in items if k is not None and t]
    want = sorted([(i, k) for i, t in [*enumerate(texts), (0, texts[0])] for k in bags(t, known)] + [(-1, k) for k in bags(texts[3], known)])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["item_id"]) for r in rows) == want
    assert {(0, 0), (1, 1), (3, 3), (4, 3), (5, 4), (6, 5), (7, 6), (13, 0)} <= set(want) and not any(i in (2, 8, 9, 10, 11, 12) for i, _ in want)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_large_benchmarks_are_applied_in_passes(spark, monkeypatch):
    docs, items = tables(spark)
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 15)
    found = op5_decontaminate(spark, SF)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(i, k) for i, t in docs for k in bags(t, items)}
    # what is left to run reads the passes' results
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_texts_meet_python_once_and_only_suspects_the_items(spark, monkeypatch):
    """Fifty passes: texts go through one node, once; a pass reads its suspects."""
    seen, stored = [], decontaminate.store
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 4)

    def watched(df, name):
        out = stored(df, name)
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((name, len(re.findall("MapInArrow", plan)), "documents.parquet" in plan, out.count()))
        return out

    monkeypatch.setattr(decontaminate, "store", watched)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = decontaminate.contaminated(docs, items).collect()
    passes = [x for x in seen if x[0] == "benchmark-leaks"]
    assert len(passes) == math.ceil(items.where("trim(text) <> ''").distinct().count() / 4) and all(n <= 2 and not texts for _, n, texts, _ in passes)
    (suspects,) = [x for x in seen if x[0] == "benchmark-suspects"]
    assert len({r["doc_id"] for r in rows}) <= suspects[3] < docs.count() / 2 and sum(x[2] for x in seen) == 1


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    docs, items = tables(spark)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 15)
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontaminate(spark, SF).collect()}
    assert got == {(i, k) for i, t in docs for k in bags(t, items)}


def test_rows_without_benchmark_items_stay(spark):
    docs, items = tables(spark)
    leaky = {t for _, t in docs if bags(t, items)}
    rows = [(i, t, f"r{i}") for i, t in docs] + [(docs[0][0], docs[0][1], "again"), (None, None, "null"), (None, "", "empty"), (7, next(iter(leaky)), "copy")]
    given = spark.createDataFrame(rows, "doc_id long, text string, _leaks string")
    got = sorted((r["doc_id"] or -1, r["_leaks"]) for r in decontaminate.clean(given, spark.read.parquet(f"{SF}/benchmark.parquet")).collect())
    assert got == sorted((i or -1, x) for i, t, x in rows if t not in leaky)
    assert decontaminate.clean(given, spark.read.parquet(f"{SF}/benchmark.parquet").limit(0)).count() == len(rows)


def test_blocks_find_all_within_the_radius_and_few_others():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2**32, size=(400, decontaminate.BLOCKS), dtype=np.uint32)
    other = np.unpackbits(marks.view(np.uint8), axis=1, bitorder="little")
    for row in other:
        row[rng.choice(256, size=int(rng.integers(0, decontaminate.RADIUS + 1)), replace=False)] ^= 1
    others = np.packbits(other, axis=1, bitorder="little").view(np.uint32)
    a, b, apart = decontaminate.candidates(marks, others)
    assert {(i, i) for i in range(400)} <= set(zip(a.tolist(), b.tolist()))
    assert (apart[a == b] <= decontaminate.RADIUS).all() and (apart[a != b] > decontaminate.RADIUS).all()
    assert (a != b).sum() / (400 * 399) < 0.01


def test_fingerprints_of_long_windows_equal_plain_counts():
    h = np.random.default_rng(4).integers(0, 2**64, size=40_000, dtype=np.uint64)
    for size, starts in ((1, [0, 1, 39_999]), (45, [3, 4, 900, 30_000]), (35_000, [0, 17, 5000])):
        got = decontaminate.simhashes(h, np.array(starts), size)
        for at, mark in zip(starts, got):
            plain = 2 * decontaminate._bits(h[at : at + size]).sum(axis=0, dtype=np.int64) > size
            assert (np.packbits(plain, bitorder="little").view(np.uint32) == mark).all()


def test_fingerprints_of_similar_bags_lie_within_the_radius():
    """Windows at the least similarity: how many the radius would lose."""
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(3000):
        n = int(rng.integers(40, 80))
        a = rng.integers(0, 2**63, size=n, dtype=np.uint64)
        b = a.copy()
        b[: n - math.ceil(2 * n * 0.8 / 1.8)] = rng.integers(0, 2**63, size=n - math.ceil(2 * n * 0.8 / 1.8), dtype=np.uint64)
        lost += (decontaminate.simhash(a) ^ decontaminate.simhash(b)).bit_count() > decontaminate.RADIUS
    assert lost <= 15


def test_mixing_query_equals_sql(spark):
    same(spark, SF, op7_mixing, ORACLE_SQL["op7_mixing"])


def filled(sizes, weights, total):
    """Targets by repeated sharing out, capping what lies above."""
    caps, capped = {i: 3 * n for i, n in sizes.items()}, set()
    while True:
        rest, w = total - sum(caps[i] for i in capped), sum(weights[i] for i in sizes if i not in capped)
        want = {i: caps[i] if i in capped else weights[i] * rest / w for i in sizes}
        above = {i for i in sizes if i not in capped and want[i] > caps[i]}
        if not above:
            return want
        capped |= above


def test_water_filling_is_the_fixed_point(spark):
    rng = random.Random(2)
    for _ in range(12):
        names = rng.sample(["a", "b", "B", "é", "z", "zz", "😀", None], rng.randint(1, 8))
        sizes = {i: rng.choice([0, 1, 5, 40, 1000]) for i in names}
        ordered = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        weights, total = {s: k % 3 + 1 for k, s in enumerate(ordered)}, sum(sizes.values())
        rows = mixing.water_fill(spark.createDataFrame(list(sizes.items()), "_s string, _source_size long"), total).collect()
        got = {r["_s"]: r["target"] or 0.0 for r in rows}
        assert got == pytest.approx(filled(sizes, weights, total), abs=1e-6) and sum(got.values()) == pytest.approx(total)


def best_cost(capacity, quotas, copies):
    """The same flow by unit steps of Bellman-Ford over all residual arcs."""
    arcs = [("t", ("p", p), n, k + 1) for p, n in capacity.items() for k in range(copies)] + [(("p", p), ("s", s), 10**9, 0) for p in capacity for s in p] + [(("s", s), "z", n, 0) for s, n in quotas.items()]
    left = [n for _, _, n, _ in arcs] + [0] * len(arcs)
    both = [(a, b, c) for a, b, _, c in arcs] + [(b, a, -c) for a, b, _, c in arcs]
    flow = cost = 0
    while True:
        far, via = {"t": 0}, {}
        for _ in range(len(capacity) + len(quotas) + 3):
            for i, (a, b, c) in enumerate(both):
                if left[i] and a in far and far[a] + c < far.get(b, 10**9):
                    far[b], via[b] = far[a] + c, i
        if "z" not in far:
            return flow, cost
        at = "z"
        while at != "t":
            i = via[at]
            left[i] -= 1
            left[i + len(arcs) if i < len(arcs) else i - len(arcs)] += 1
            at = both[i][0]
        flow, cost = flow + 1, cost + far["z"]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(7)
    for _ in range(25):
        sources = ["a", "b", "c"][: rng.randint(1, 3)]
        patterns = {tuple(sorted(rng.sample(sources, rng.randint(1, len(sources))))) for _ in range(4)}
        capacity = {p: rng.randint(0, 6) for p in patterns}
        quotas = {s: rng.randint(0, 12) for s in sources}
        flow = mixing.min_cost_flow(capacity, quotas, 3)
        by = flow.by_pattern()
        cost = sum(sum(max(0, min(capacity[p], n - k * capacity[p])) * (k + 1) for k in range(3)) for p, n in by.items())
        assert (sum(by.values()), cost) == best_cost(capacity, quotas, 3)
        assert all(sum(n for (_, s), n in flow.tokens.items() if s == q) <= quotas[q] for q in quotas)


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["b", "a", "a"] if i % 3 == 1 else ["c"], "w " * (1 + i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source array<string>, text string")
    got = mixing.mix(docs).collect()
    assert got == mixing.mix(docs.orderBy("text")).orderBy("doc_id").collect() or sorted(map(tuple, ((r["doc_id"], r["taken"]) for r in got))) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.orderBy("text")).collect())
    taken = Counter()
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[tuple(r["sources"])] += r["taken"]
    total = sum(r["size"] for r in got)
    assert sum(taken.values()) == pytest.approx(total, abs=30)


def test_odd_mixing(spark):
    schema = "doc_id long, source string, text string, size int, _id string"
    rows = [(1, "é", "a b", 1, "x"), (2, None, "a b c", 1, "x"), (3, "z", None, 1, "x"), (None, "A", "a", 1, "x"), (5, "A", "", 1, "x"), (6, "A", "w " * 30_000, 1, "x"), (1, "é", "a b", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {r["sources"][0]: r["target"] for r in got}
    assert by["é"] == 12.0 and by[None] == 9.0 and by["z"] == 0.0
    assert sum(r["taken"] for r in got if r["sources"][0] == "é") == 12
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs.where("doc_id in (3, 5)")).collect())


def test_overlaps_are_bounded_and_single_sources_are_not(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    docs = spark.createDataFrame([(i, f"s{i % 40}", "w " * (1 + i % 5)) for i in range(200)], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 200
    overlapping = spark.createDataFrame([(i, [f"s{i % 4}", f"s{i % 5}"], "w") for i in range(20)], "doc_id long, source array<string>, text string")
    with pytest.raises(ValueError, match="more than 2 patterns"):
        mixing.mix(overlapping)


def test_the_flow_of_many_patterns_is_fast():
    rng = random.Random(3)
    sources = [f"s{i}" for i in range(60)]
    patterns = {tuple(sorted(rng.sample(sources, rng.randint(1, 4)))): rng.randint(1, 10**6) for _ in range(20_000)}
    quotas = {s: rng.randint(0, 10**9) for s in sources}
    began = time.time()
    flow = mixing.min_cost_flow(patterns, quotas, 3)
    assert time.time() - began < 60 and sum(flow.by_pattern().values()) <= sum(quotas.values())
    assert all(n <= 3 * patterns[p] for p, n in flow.by_pattern().items())


def fill(sized, rest):
    """Which of (key, size) fit, one after the other."""
    out = set()
    for key, size in sorted(sized):
        if 0 < size <= rest:
            rest -= size
            out.add(key)
    # the smallest other one, if it brings the sum nearer
    least = min(((size, key) for key, size in sized if size > 0 and key not in out), default=None)
    if least and least[0] < 2 * rest:
        out.add(least[1])
    return out


def test_a_dominating_document_is_taken_if_that_is_nearer(spark):
    """A source with one very long document that doesn't fit its target whole."""
    docs = spark.createDataFrame([(1, "a", "w " * 400_000), (2, "a", ""), (3, "b", "w " * 399_998), (4, "c", "x " * 399_996)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in mixing.mix(docs, weights=(1, 1, 1)).collect()}
    assert [got[i]["target"] for i in (1, 3, 4)] == [399_998.0] * 3
    assert [got[i]["taken"] for i in (1, 2, 3, 4)] == [400_000, 0, 399_998, 399_996]
    # 1 of 3 and 2 of 3 words: too much by half is as far as nothing, and stays nothing
    some = spark.createDataFrame([(1, "a", "w " * 300), (2, "b", "w " * 150)], "doc_id long, source string, text string")
    told = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(some, weights=(1, 2)).collect()}
    assert told == {1: (150.0, 0), 2: (300.0, 300)}


@pytest.mark.parametrize("few", [0, 30, 50_000])
def test_documents_are_filled_until_none_fits(spark, monkeypatch, few):
    """Sizes with a heavy tail, in rounds and by the driver, against one
    document after the other."""
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(few)
    rows = [(i, f"p{i % 3}", max(0, int(rng.paretovariate(0.7)) - 1), rng.getrandbits(60), i) for i in range(900)]
    rest = {"p0": 400, "p1": 3, "p2": 10**9}
    need = spark.createDataFrame([(p, 1, n) for p, n in rest.items()], "_p string, _copies long, _rest long")
    got = mixing.select_documents(spark.createDataFrame(rows, "_id long, _pattern string, _size long, _h long, _u long"), need).collect()
    for p, n in rest.items():
        want = fill([((h, i), size) for i, q, size, h, _ in rows if q == p], n)
        assert {(r["_h"], r["_id"]) for r in got if r["_pattern"] == p and r["_taken"] > r["_size"]} == want
        assert all(r["_taken"] in (r["_size"], 2 * r["_size"]) for r in got)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs, items = tables(spark)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = quality_crf.train(quality_crf.training_sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    kept = []
    for i, t in docs:
        base = quality_crf.base_rules(t)
        x, sizes = quality_crf.line_features(t)
        if not base.failed and 2 * sizes[model.decode(x) == 1].sum() >= base.n_words:
            kept.append((i, t))
    before = dict(kept)
    left = {i: t for i, t in line_brute(kept).items() if t == before[i] or t.split()}
    roots = near_components(left, corpus_pipeline.NEAR)
    left = {i: t for i, t in left.items() if roots[i] == i}
    left = {i: t for i, t in left.items() if not bags(t, items)}
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t)) for i, t in left.items()}
    of = Counter()
    for i, n in size.items():
        of[source[i]] += n
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(of))}
    targets = filled(dict(of), weights, sum(of.values()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= set(left) and len({r["doc_id"] for r in got}) == len(got)
    taken = Counter()
    for r in got:
        assert (r["size"], r["source"], r["source_size"], r["target"]) == (size[r["doc_id"]], source[r["doc_id"]], of[source[r["doc_id"]]], pytest.approx(targets[source[r["doc_id"]]]))
        taken[r["source"]] += r["taken"]
    # a last document may lie above the target, by at most half of itself
    largest = {s: max(n for i, n in size.items() if source[i] == s) for s in of}
    assert all(taken[s] <= int(targets[s] + 0.5) + largest[s] / 2 for s in of)
    import hashlib

    for s in of:
        goal = int(targets[s] + 0.5)
        order = sorted((int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:15], 16), i) for i in left if source[i] == s)
        copies, rest = divmod(goal, of[s])
        extra = {i for _, i in fill([(x, size[x[1]]) for x in order], rest)}
        assert {r["doc_id"]: r["taken"] for r in got if r["source"] == s} == {i: size[i] * (copies + (i in extra)) for i in left if source[i] == s and copies + (i in extra)}


def internal_names():
    """Every name that the operators' code writes as a column of its own."""
    import corpus_pipeline

    modules = (corpus_pipeline, decontaminate, line_dedup, mixing, quality_crf, shared, simhash_dedup, spans)
    found = {n for m in modules for n in re.findall(r"""["'](_[a-z][a-z0-9_]*|[a-z][a-z0-9_]*)["']""", Path(m.__file__).read_text())}
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


def test_stages_carry_columns_of_any_name(spark):
    """Each stage given columns named like all its internal ones."""
    import corpus_pipeline

    names = internal_names()
    assert {"_row", "_lines", "_t", "_leaks", "_quality", "rep", "root", "_id", "_key", "_stays"} <= {*names}
    names = sorted({*names, "w0", "w5", "_kept", "_c", "_l", "_starts", "_cid", "_ct"})
    rows = [(i, " ".join(f"v{i // 2}x{k}" for k in range(80)) + ("\na line\nand more\nhere it is\n" if i < 4 else ""), "en", "src0", 200, *(f"{n}{i}" for n in names)) for i in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["taken"] for r in mixed) > 0
    for found, column in ((line_dedup.dedup_lines(docs), "_lines"), (quality_crf.judge(docs, None), "_quality")):
        assert found.columns.count(column) == 1 and set(found.columns) == {*docs.columns, column} and found.count() == len(rows)


def test_stages_keep_the_columns_and_survive_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, "w " * 100, "en", "src0", 200), (None, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0)] + [(i, " ".join(f"v{i}x{k}" for k in range(80)), "en", None, 5) for i in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= given.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
