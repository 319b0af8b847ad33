"""SimHash near-duplicates and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import line_dedup, simhash_dedup
from millrace.llm.queries import ORACLE_SQL, op2_simhash, op6_line_dedup
from millrace.llm.shared import components
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    parts = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    bits = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(marks, radius=3):
    ids = sorted(marks)
    values = np.array([marks[i] for i in ids], dtype=np.uint64)
    pairs = [(ids[k], ids[k + 1 + j]) for k in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius)]
    return union(pairs, ids)


def test_query_equals_brute_force(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    marks = {i: fingerprint(t) for i, t in texts.items()}
    want = brute(marks)
    got = op2_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{marks[i]:016x}", want[i]) for i in texts}


def link_components(spark, values, scheme=simhash_dedup.Scheme()):
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    rows = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "w0 long, rep long")
    found = {r["node"]: r["root"] for r in simhash_dedup.candidates(rows, scheme).collect()}
    return {i: found.get(i, i) for i in range(len(values))}


@pytest.mark.parametrize("block, all_pairs", [(4096, 128), (4096, 4), (40, 8)])
def test_links_lose_no_pair(spark, monkeypatch, block, all_pairs):
    """Clouds of fingerprints, also with large buckets and with blocks so small
    that buckets are dealt out; without seeds, so that the index finds all."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "ALL_PAIRS", all_pairs)
    if all_pairs < 128:
        none = spark.createDataFrame([], "node long, root long")
        monkeypatch.setattr(simhash_dedup, "seeds", lambda fps, scheme: none)
    rng, values = random.Random(2), set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 9)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values | {rng.getrandbits(64) for _ in range(100)} | {0, 1, 7, 15, 2**64 - 1})
    want = brute(dict(enumerate(values)))
    assert link_components(spark, values) == want
    assert len(set(want.values())) < len(values)


def test_odd_documents(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (4, "One Two three four"), (4, "One Two three four"), (2, "one two THREE four"), (None, "one two three four"), (None, "no id at all here"), (8, "w " * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, w0 int, rep int")
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 2), (2, 2), (3, 3), (4, 2), (4, 2), (5, 3), (8, 8), (9, 3)]
    kept = simhash_dedup.keep_one(docs, simhash_dedup.Scheme()).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, -1, 2, 3, 8] and "w0" in kept[0].asDict()
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(100)] + [(7, 7), (1, 2), (1, 2)]
    want = union(pairs, {x for p in pairs for x in p})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(n, n) == root for n, root in want.items())


def test_a_sieve_keeps_all_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.llm import shared

    rows = spark.range(-20_000, 20_000).select(F.col("id").alias("x"), F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(None, "t")], "x long, text string"))
    keys = spark.range(-20_000, 20_000, 50).select(F.col("id").alias("rep")).union(spark.createDataFrame([(None,)], "rep long"))
    for bits, most in ((1 << 27, 850), (1 << 16, 2500)):
        monkeypatch.setattr(shared, "SIEVE", bits)
        some, rest = ([r["x"] for r in part.collect()] for part in shared.sieved(rows, F.col("x"), keys))
        assert set(some) >= set(range(-20_000, 20_000, 50)) and len(some) < most and None not in some
        assert None in rest and len(some) + len(rest) == 40_001 and not set(some) & set(rest)
    assert shared.sieved(rows, F.col("x"), keys.limit(0))[0].count() == 0 and shared.sieved(rows, F.col("x"), keys.limit(0))[1].count() == 40_001


def test_one_of_each_group_stays_whatever_the_sieve_lets_through(spark, monkeypatch):
    from millrace.llm import shared

    rng, rows = random.Random(9), []
    for copies in (1, 2, 3, 9) * 12:
        rows += [(len(rows) + k, t) for k, t in enumerate(family_texts(rng, copies, 0, 1, 120))]
    rows += [(3, rows[3][1])] * 2 + [(None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, c in ((r["doc_id"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs, NEAR).collect() if r["doc_id"] is not None):
        first.setdefault(c, set()).add(i)
    for bits in (1 << 27, 1 << 15):
        monkeypatch.setattr(shared, "SIEVE", bits)
        kept = [r["doc_id"] for r in simhash_dedup.keep_one(docs, NEAR).collect()]
        assert sorted(i for i in kept if i is not None) == sorted(first) and kept.count(None) == 2 and len(first) == 48


def test_line_query_equals_sql(spark):
    same(spark, SF, op6_line_dedup, ORACLE_SQL["op6_line_dedup"])


def line_brute(rows):
    """(id, text) with distinct ids to the lines that are left."""
    seen, gone = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if re.search("[^\x20\x09-\x0d]", x)]
        gone[i] = set()
        for k in range(len(at) - 2):
            w = tuple(lines[p] for p in at[k : k + 3])
            if w in seen:
                gone[i] |= set(at[k : k + 3])
            seen.add(w)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) if gone[i] else t for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "a b", "long line " * 5]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, "a\na\na\na\na\na"), (502, "\n".join(map(str, range(3000)))), (503, "\n".join(map(str, range(3000))))]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, _t string, n_lines int")
    got = line_dedup.dedup_lines(docs).collect()
    assert all(r["_t"] == "x" for r in got)
    assert {r["doc_id"]: r["_lines"]["text"] for r in got} == line_brute(rows)
    assert all(r["_lines"]["n_lines"] == (r["text"] or "").count("\n") + 1 for r in got)


def test_hot_windows(spark, monkeypatch):
    """Passages that most documents share, beside others, with a low bound on
    what counts as hot."""
    monkeypatch.setattr(line_dedup, "HOT", 20)
    rng = random.Random(5)
    rows = [(i, "\n".join([f"own {i}", *(["top", "mid", "low"] if i % 3 else []), *(["rare a", "rare b", f"rare {i // 30}"] if i % 7 == 0 else []), f"end {rng.randint(0, 50)}"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["_lines"]["text"] for r in line_dedup.dedup_lines(docs).collect()} == line_brute(rows)


def test_repeated_rows_and_null_ids_of_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd"), (None, "q")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["_lines"]["text"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(-1, "d"), (-1, "q"), (1, "a\nb\nc"), (1, "a\nb\nc")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


NEAR = simhash_dedup.near_scheme(30_000_000)


def test_schemes_by_size():
    """What the numbers are for some corpora, and that sets at the similarity
    meet as often as they should."""
    assert simhash_dedup.Scheme(words=6, per_word=3, width=20, radius=33, shingle=5, compared=2, least=0.8) == NEAR
    assert [(s.width, s.segments) for s in map(simhash_dedup.near_scheme, (10**6, 10**9, 5 * 10**9))] == [(15, 8), (25, 32), (28, 50)]
    rng = np.random.default_rng(8)
    for documents in (10**4, 10**6, 3 * 10**7):
        scheme, met = simhash_dedup.near_scheme(documents), 0
        for _ in range(400):
            a = rng.integers(0, 2**63, 300, dtype=np.uint64)
            b = np.concatenate([a[:267], rng.integers(0, 2**63, 33, dtype=np.uint64)])  # 267 of 333
            x, y = (np.array(simhash_dedup.fingerprint(h, scheme.words)).view(np.uint64) for h in (a, b))
            met += any((int(v) >> (s * scheme.width) & (1 << scheme.width) - 1).bit_count() <= 1 for v in x ^ y for s in range(scheme.per_word))
        assert met >= 0.92 * 400


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / max(len(a) + len(b) - both, 1)


def near_components(texts, scheme=NEAR):
    """Brute force: families of all candidate pairs, and in each of them all
    pairs at the similarity."""
    bags = {i: simhash_dedup.hashes_of(t, scheme) for i, t in texts.items()}
    marks = {i: np.array(simhash_dedup.fingerprint(b, scheme.words)).view(np.uint64) for i, b in bags.items()}
    ids = sorted(texts)
    every = np.stack([marks[i] for i in ids])
    part = np.stack([every[:, k] >> np.uint64(s * scheme.width) & np.uint64((1 << scheme.width) - 1) for k in range(scheme.words) for s in range(scheme.per_word)], axis=1)
    pairs = []
    for k, i in enumerate(ids[:-1]):
        near = np.bitwise_count(every[k + 1 :, : scheme.compared] ^ every[k, : scheme.compared]).sum(axis=1) <= scheme.radius
        near &= (np.bitwise_count(part[k + 1 :] ^ part[k]) <= 1).any(axis=1)
        pairs += [(i, ids[k + 1 + j]) for j in np.flatnonzero(near)]
    family = union(pairs, ids)
    members = {}
    for i in ids:
        members.setdefault(family[i], []).append(i)
    return union([(i, j) for own in members.values() for k, i in enumerate(own) for j in own[k + 1 :] if jaccard(bags[i], bags[j]) >= scheme.least], ids)


def found_components(spark, texts, scheme=NEAR):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(docs, scheme).collect()}


def all_pairs_components(texts, least=0.8):
    """Of all pairs at the similarity, whether candidates or not."""
    bags = {i: np.unique(simhash_dedup.shingle_hashes(t or "", 5)) for i, t in texts.items()}
    holders = {}
    for i, b in bags.items():
        for h in b.tolist():
            holders.setdefault(h, []).append(i)
    pairs = {(i, j) for own in holders.values() for k, i in enumerate(own) for j in own[k + 1 :]}
    return union([p for p in pairs if jaccard(bags[p[0]], bags[p[1]]) >= least], texts)


def edited(rng, words, changes):
    own = list(words)
    for k in rng.sample(range(len(own)), changes):
        own[k] = f"x{rng.randint(0, 10**9)}"
    return own


def family_texts(rng, copies, low, high, words=300):
    """Copies of one text with some words changed each."""
    first = [f"w{rng.randint(0, 10**9)}" for _ in range(words)]
    return [" ".join(edited(rng, first, rng.randint(low, high))) for _ in range(copies)]


@pytest.mark.parametrize("block", [1024, 16])
def test_families_equal_all_pairs(spark, monkeypatch, block):
    """Groups of edited copies, most of whose pairs are near but below the
    similarity: the components are those of all pairs at the similarity, also
    with families of many blocks."""
    monkeypatch.setattr(simhash_dedup, "FAMILY_BLOCK", block)
    rng, texts = random.Random(12), []
    for copies, low, high in ((100, 3, 7), (100, 4, 9), (60, 0, 5), (8, 0, 4), (3, 1, 2), (2, 2, 3), (2, 40, 60), (1, 0, 0)):
        texts += family_texts(rng, copies, low, high)
    texts = dict(enumerate(texts))
    want = near_components(texts)
    assert want == all_pairs_components(texts) and 20 < len(set(want.values())) < 240
    assert found_components(spark, texts) == want


def test_documents_equal_all_pairs(spark):
    """The test table's documents of 50 words or more: no pair at the
    similarity is lost, and none below it is linked."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r[0]: r[1] for r in rows if len((r[1] or "").split()) >= 50}
    assert found_components(spark, texts) == near_components(texts) == all_pairs_components(texts)


def test_recall_by_similarity(spark):
    """Isolated pairs just above the similarity, by bands of it."""
    rng, texts, bands = random.Random(21), {}, {}
    for _ in range(1500):
        n = rng.choice([60, 120, 250, 600])
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
        copy = edited(rng, words, max(1, round(n * rng.uniform(0.012, 0.025))))
        pair = [np.unique(simhash_dedup.shingle_hashes(" ".join(t), 5)) for t in (words, copy)]
        at = jaccard(*pair)
        if at >= 0.8:
            bands.setdefault("0.80" if at < 0.82 else "0.82" if at < 0.85 else "0.85", []).append(len(texts))
            texts |= {len(texts): " ".join(words), len(texts) + 1: " ".join(copy)}
    found = found_components(spark, texts)
    recall = {k: np.mean([found[i + 1] == i for i in own]) for k, own in sorted(bands.items())}
    print({k: (len(own), round(float(recall[k]), 3)) for k, own in sorted(bands.items())})
    assert len(bands["0.80"]) > 100 and recall["0.80"] >= 0.93 and recall["0.82"] >= 0.96 and recall["0.85"] >= 0.98
    assert all(found[i] == i for i in texts if i % 2 == 0)


def test_a_forest_of_similar_sets_equals_all_pairs():
    rng = np.random.default_rng(4)
    for size in (3, 30, 150, 3000):
        pool = rng.integers(0, 2**63, size=3 * size, dtype=np.uint64)
        sets, base = [], [rng.choice(pool, size, replace=False) for _ in range(3)]
        for _ in range(60):
            x = base[rng.integers(3)].copy()
            n = rng.integers(0, max(2, size // 6))
            x[:n] = rng.choice(pool, n)
            sets.append(np.unique(x[: size - rng.integers(0, max(1, size // 5))]))
        for side in (np.zeros(60, dtype=int), rng.integers(0, 2, 60)):
            a, b = simhash_dedup.similar_pairs(sets, side, 0.8)
            two = len(set(side.tolist())) > 1
            links = [(i, j) for i in range(60) for j in range(i + 1, 60) if (not two or side[i] != side[j]) and jaccard(sets[i], sets[j]) >= 0.8]
            assert union(list(zip(a, b)), range(60)) == union(links, range(60)) and len(a) < 60
            assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in zip(a, b))


def test_repeated_passages_dont_hide_near_copies(spark):
    """Copies that differ in how often a passage repeats, against brute-force
    similarity."""
    rng, texts = random.Random(3), {}
    for _ in range(10):
        line = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
        phrase = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(5))
        for t in (line, f"{line}\n{' '.join([phrase] * 50)}"):
            texts[len(texts)] = t
    want = all_pairs_components(texts)
    assert want == {i: i - i % 2 for i in texts}
    assert found_components(spark, texts) == want


def test_odd_documents_of_a_similarity(spark):
    """Rows that share an id, null ids and texts without words."""
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(5, None), (3, ""), (9, " \n"), (4, base), (4, base), (4, "another text of that id"), (2, base + " more"), (None, base), (None, "no id at all here"), (8, "w " * 40_000), (7, base.upper())]
    docs = spark.createDataFrame([(i, t, "_row", 2) for i, t in rows], "doc_id long, text string, _row string, root int")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_dedup.near_duplicates(docs, NEAR).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (3, 3), (4, 2), (4, 2), (4, 2), (5, 3), (7, 2), (8, 8), (9, 3)]
    kept = simhash_dedup.keep_one(docs, NEAR).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, -1, 2, 3, 8] and kept[0]["_row"] == "_row"
    assert simhash_dedup.keep_one(docs.limit(0), NEAR).collect() == []
