"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are cut into fewer segments than the radius would need for an
equal one, so few that of two fingerprints within the radius one segment
differs by at most one bit. Each segment is indexed under its variants with
one bit left out; an equality join on these finds every pair within the
radius, and the full Hamming distance verifies it.

Schemes with a ``least`` similarity take wide fingerprints and a wide radius.
What their candidates connect is a family; within each family the exact
shingle sets are compared, and only pairs that similar are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.decontaminate import shingles
from millrace.llm.shared import components, rows_of, sieved, store

#: Fingerprints of one bucket that a task compares by itself; those of larger
#: ones are dealt out as pairs of blocks.
BLOCK = 4096
#: Fingerprints of a bucket that are compared pair by pair, many buckets at
#: once; larger ones give a spanning forest.
ALL_PAIRS = 128
#: Texts, and shingles of all of them, in a block of a family.
FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 2_000_000
#: Parts in which a family meets the number of its blocks.
SALTS = 32


@dataclass(frozen=True)
class Scheme:
    """``words`` 64-bit words, each with ``per_word`` segments of ``width``
    bits. Pairs that differ in at most ``radius`` bits of the first
    ``compared`` words, and by at most one bit in some segment, are candidates.
    With all words compared, segments that cover all bits and a radius of less
    than twice their number these are all pairs within the radius. With
    ``least``, texts in candidates' families are linked that have at least that
    Jaccard similarity of their shingle sets; without, candidates are links."""

    words: int = 1
    per_word: int = 2
    width: int = 32
    radius: int = 3
    shingle: int = 3
    compared: int = 1
    least: float | None = None

    @property
    def segments(self) -> int:
        return self.words * self.per_word

    @property
    def variants(self) -> int:
        return self.segments * self.width

    @property
    def marks(self) -> list[str]:
        """Columns of a fingerprint."""
        return [f"w{k}" for k in range(self.words)]

    @property
    def seen(self) -> list[str]:
        """Columns that the index carries."""
        return self.marks[: self.compared]


def near_scheme(documents: int, least: float = 0.8, shingle: int = 5, recall: float = 0.95, bucket: int = 64) -> Scheme:
    """The scheme for texts of at least that similarity in a corpus of up to
    ``documents`` distinct ones.

    Two sets of one size differ in each bit with a chance that their similarity
    gives. Segments are so wide that a bucket holds about ``bucket`` unrelated
    fingerprints at most, and so many that a pair at exactly ``least`` has one
    that differs by one bit at most with a chance of ``recall``; the radius on
    128 bits lies 3.4 standard deviations above what such a pair differs in,
    and as far from that 64 that unrelated ones differ in that one in some ten
    millions passes."""
    chance = math.acos(2 * least / (1 + least)) / math.pi
    width = max(8, math.ceil(math.log2(max(documents / bucket, 1))) + 1)
    met = (1 - chance) ** width + width * chance * (1 - chance) ** (width - 1)
    words = max(2, math.ceil(math.ceil(math.log(1 - recall) / math.log(1 - met)) / (64 // width)))
    radius = round(128 * chance + 3.4 * math.sqrt(128 * chance * (1 - chance)))
    return Scheme(words, 64 // width, width, radius, shingle, 2, least)


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 with seed 42 of each n-word shingle of the A-Z-lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from a hash (the finalizer of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int) -> list[int]:
    """Bits set in over half of the hashes, as signed longs; further words are
    of further hashes made from each."""
    every = np.empty((len(h), words), dtype=np.uint64)
    for k in range(words):
        every[:, k] = mix(every[:, k - 1]) if k else h
    total = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(h), 255):  # so many fit into a byte
        total += np.add.reduce(np.unpackbits(every[i : i + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.int64).tolist()


def hashes_of(text: str | None, scheme: Scheme) -> np.ndarray:
    """What a text's fingerprint is taken from: the hashes of all its shingles;
    with ``least``, which compares sets, each different one once, combined from
    hashes of the words, which is the same but for the hashes' values."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    if scheme.least is None:
        return shingle_hashes(text, scheme.shingle)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(mix(shingles(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), scheme.shingle)))


def fingerprints(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, w0, w1 ...`` per row: the words of the fingerprint."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            marks = [fingerprint(hashes_of(t, scheme), scheme.words) for t in part["_text"]]
            yield pd.DataFrame(marks, columns=scheme.marks, dtype="int64").assign(_id=part["_id"].to_numpy())

    out = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(batches, ", ".join(["_id string", *(f"{w} long" for w in scheme.marks)]))
    return out.select(F.col("_id").cast("long").alias("doc_id"), *scheme.marks)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, the words in the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(marks: np.ndarray, radius: int, part: np.ndarray) -> tuple[list, list]:
    """Index pairs within the radius that join the parts which such pairs
    connect, as a spanning forest. Each fingerprint that is reached is
    compared with those not reached yet; a part is reached as a whole."""
    a, b, left = [], [], np.arange(len(marks))
    while len(left):
        own = part[left] == part[left[0]]
        queue, left = left[own].tolist(), left[~own]
        while queue and len(left):
            at = queue.pop()
            hit = left[distance(marks[left], marks[at]) <= radius]
            if len(hit):
                parts, one = np.unique(part[hit], return_index=True)
                a += [at] * len(one)
                b += hit[one].tolist()
                own = np.isin(part[left], parts)
                queue += left[own].tolist()
                left = left[~own]
    return a, b


def _segments(fps: DataFrame, scheme: Scheme, deals: int, *columns: str) -> DataFrame:
    """``_t`` and ``columns``: a row per segment of a fingerprint and deal;
    ``_t`` is the number of both, and behind it the segment's bits."""
    segment = f"cast(floor(_d / {deals}) as int)"
    word = f"element_at(array({', '.join(scheme.marks)}), cast(floor({segment} / {scheme.per_word}) as int) + 1)"
    bits = f"shiftrightunsigned({word}, ({segment} % {scheme.per_word}) * {scheme.width}) & {(1 << scheme.width) - 1}L"
    dealt = fps.select(*scheme.marks, *(c for c in columns if c not in scheme.marks), F.explode(F.sequence(F.lit(0), F.lit(scheme.segments * deals - 1))).alias("_d"))
    return dealt.select(F.expr(f"shiftleft(cast(_d as bigint), {scheme.width}) | ({bits})").alias("_t"), *columns)


def _variants(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """``_key``, the compared words and ``root``: each fingerprint under its
    segments' variants, equal keys side by side.

    Two segments that differ in one bit agree in one of their halves. So a
    segment is dealt out twice, by either half, and only then left without
    each bit of the other half in turn: the shuffle moves two rows a segment
    and not one a variant."""
    low = scheme.width // 2
    half = f"shiftright(_t, {scheme.width})"
    bits = f"(_t & {(1 << scheme.width) - 1}L)"
    kept = f"case when {half} % 2 = 0 then {bits} & {(1 << low) - 1}L else shiftright({bits}, {low}) end"
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")) * -(-scheme.width // 16)
    dealt = _segments(fps, scheme, 2, *scheme.seen, "root").repartition(tasks, F.expr(f"shiftleft({half}, {scheme.width}) | ({kept})"))
    other = f"case when {half} % 2 = 0 then sequence({low}, {scheme.width - 1}) else sequence(0, {low - 1}) end"
    key = f"shiftleft(cast(floor({half} / 2) as bigint) * {scheme.width} + _b, {scheme.width}) | ({bits} & ~shiftleft(1L, _b))"
    each = dealt.select("_t", *scheme.seen, "root", F.explode(F.expr(other)).alias("_b"))
    return each.select(F.expr(key).alias("_key"), *scheme.seen, "root").sortWithinPartitions("_key", *scheme.seen)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)


def _arrays(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marks = np.stack([np.asarray(batch.column(n)).view(np.uint64) for n in names], axis=1)
    return np.array(batch.column("_key")), marks


def seeds(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Components ``node, root`` of some of the pairs within the radius: those
    of neighbours, and with the first fingerprint, among such as share a whole
    segment, in order. Two links a row at most and no more than that: what
    they join, the index need not link again bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            key, marks = _arrays(batch, scheme.seen)
            rep = np.array(batch.column("rep"))
            if last is not None:
                key, rep, marks = (np.concatenate(x) for x in zip(last, (key, rep, marks)))
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            first = np.repeat(first, np.diff(first, append=len(key)))
            for other in (np.maximum(np.arange(len(key)) - 1, first), first):
                good = np.flatnonzero((rep != rep[other]) & (distance(marks, marks[other]) <= scheme.radius))
                if len(good):
                    yield _pairs(rep[good], rep[other[good]])
            # the last bucket may go on: its first row and its last one stay
            stay = np.unique([first[-1], len(key) - 1])
            last = key[stay], rep[stay], marks[stay]

    near = _segments(fps, scheme, 1, *scheme.seen, "rep").withColumnRenamed("_t", "_key").repartition("_key").sortWithinPartitions("_key", *scheme.seen)
    return components(near.mapInArrow(run, "a long, b long"))


def _bucket_links(scheme: Scheme):
    """Rows sorted by key to links between different roots; the rows of a
    bucket of over BLOCK fingerprints come out as they are, with their key."""
    out_schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "key", *scheme.seen)])

    def links_of(a, b) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[none] * (1 + scheme.compared)], schema=out_schema)

    def rows(key, root, marks) -> pa.RecordBatch:
        signed = marks.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(root), pa.nulls(len(key), pa.int64()), pa.array(key), *(pa.array(np.ascontiguousarray(signed[:, k])) for k in range(scheme.compared))], schema=out_schema)

    def whole(key, root, marks) -> Iterator[pa.RecordBatch]:
        """Links within buckets that are all here."""
        start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        size = np.diff(start, append=len(key))
        apart = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        here = np.flatnonzero(np.repeat(apart & (size <= ALL_PAIRS), size))
        here, d = here[:-1] if len(here) and here[-1] == len(key) - 1 else here, 1
        here = here[key[here] == key[here + 1]]
        while len(here):
            good = here[(root[here] != root[here + d])]
            good = good[distance(marks[good], marks[good + d]) <= scheme.radius]
            if len(good):
                yield links_of(root[good], root[good + d])
            d += 1
            here = here[here + d < len(key)]
            here = here[key[here] == key[here + d]]
        for i in np.flatnonzero(apart & (size > ALL_PAIRS)):
            s = slice(start[i], start[i] + size[i])
            a, b = forest(marks[s], scheme.radius, root[s])
            if a:
                yield links_of(root[s][a], root[s][b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hot = None, None
        for batch in batches:
            key, marks = _arrays(batch, scheme.seen)
            cols = [key, np.array(batch.column("root")), marks]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            kept = None
            while len(cols[0]):
                first = int(np.searchsorted(cols[0], cols[0][0], side="right"))
                if cols[0][0] == hot or first > BLOCK:
                    hot = cols[0][0]
                    yield rows(*(c[:first] for c in cols))
                    cols = [c[first:] for c in cols]
                    continue
                # up to the next large bucket; the last one may go on in the next batch
                last = int(np.searchsorted(cols[0], cols[0][-1]))
                cut = np.flatnonzero(np.diff(cols[0][:last])) + 1
                ends = np.concatenate([cut, [last]]) if last else np.array([0])
                large = np.flatnonzero(np.diff(np.concatenate([[0], ends])) > BLOCK)
                stop = int(ends[large[0] - 1]) if len(large) else last
                if stop:
                    yield from whole(*(c[:stop] for c in cols))
                cols = [c[stop:] for c in cols]
                if not len(large):
                    break
            kept = cols if len(cols[0]) else None
        if kept is not None:
            yield from whole(*kept) if len(kept[0]) <= BLOCK else [rows(*kept)]

    return run


def candidates(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Components ``node, root`` of all candidate pairs of the distinct
    fingerprints ``w0 ..., rep``.

    :func:`seeds` joins the bulk of a group of near copies by a few rows each.
    The index of variants then only gives links between the roots of what
    these left apart: in small buckets all of them, in larger ones a spanning
    forest.
    """
    fps = fps.where("rep is not null")
    some = seeds(fps, scheme)
    fps = fps.join(some.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    schema = ", ".join(f"{n} long" for n in ("a", "b", "key", *scheme.seen))
    found = store(_variants(fps, scheme).mapInArrow(_bucket_links(scheme), schema), "simhash-links")
    links, hot = found.where("b is not null").select("a", "b"), found.where("b is null").select("key", *scheme.seen, F.col("a").alias("root"))
    if hot.limit(1).count():
        links = links.union(_hot_links(hot, scheme))
    return components(some.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _hot_links(hot: DataFrame, scheme: Scheme) -> DataFrame:
    """Links ``a, b`` of buckets of over BLOCK fingerprints, block against
    block; buckets that are of one root have none."""

    def block_pair(part: pd.DataFrame) -> pd.DataFrame:
        root = part["root"].to_numpy()
        marks = np.ascontiguousarray(part[scheme.seen].to_numpy(dtype=np.int64)).view(np.uint64)
        a, b = forest(marks, scheme.radius, root)
        return pd.DataFrame({"a": root[a], "b": root[b]})

    counts = hot.groupBy("key").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high")
    counts = counts.select(F.col("key").alias("_k"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_n"))
    rows = hot.join(counts, F.col("key") == F.col("_k"))
    return _dealt(rows, F.xxhash64(*scheme.seen)).groupBy("key", "_i", "_j").applyInPandas(block_pair, "a long, b long")


def _dealt(rows: DataFrame, place: Column) -> DataFrame:
    """Rows in ``_n`` blocks by ``place``, block against block: no group of
    ``_i, _j`` holds more than about two blocks (``_b``), and each two rows
    meet in one of them."""
    dealt = rows.withColumn("_b", F.pmod(place, F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o", "_n")


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, least: float) -> tuple[list, list]:
    """A spanning forest of the pairs with at least that Jaccard similarity,
    as indices; with two sides, of the pairs between them.

    A pair's shared shingles are at most those of one set less the bits that
    only its own bitmap has, since each such bit stands for at least one
    shingle that the other lacks. Pairs that this, or their sizes, rule out
    are not intersected, nor those that are connected already."""
    n = np.array([len(x) for x in sets])
    bits = 1024
    while bits < 4 * np.median(n) and bits < 1 << 14:
        bits *= 2
    maps = np.zeros((len(sets), bits), dtype=bool)
    for row, x in zip(maps, sets):
        row[(x >> np.uint64(40)) % np.uint64(bits)] = True
    maps = np.packbits(maps, axis=1).view(np.uint64)
    root, two = np.arange(len(sets)), len(np.unique(side)) > 1
    a, b = [], []
    for i in range(len(sets) - 1):
        some = np.arange(i + 1, len(sets))
        some = some[root[some] != root[i]]
        if two:
            some = some[side[some] != side[i]]
        need = least / (1 + least) * (n[some] + n[i]) - 1e-9
        ok = np.minimum(n[some], n[i]) >= need
        some, need = some[ok], need[ok]
        for k in range(0, len(some), 4096):
            these, goal = some[k : k + 4096], need[k : k + 4096]
            most = np.minimum(n[i] - np.bitwise_count(maps[i] & ~maps[these]).sum(axis=1, dtype=np.int64), n[these] - np.bitwise_count(maps[these] & ~maps[i]).sum(axis=1, dtype=np.int64))
            order = np.argsort(goal - most, kind="stable")
            order = order[most[order] >= goal[order]]
            these, goal = these[order], goal[order]
            while len(these):
                j = these[0]
                if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= goal[0]:
                    a.append(i)
                    b.append(int(j))
                    root[root == root[j]] = root[i]
                    rest = root[these] != root[i]
                    these, goal = these[rest], goal[rest]
                else:
                    these, goal = these[1:], goal[1:]
    return a, b


def verified(families: DataFrame, fps: DataFrame, docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components ``node, root`` of the texts in one family (``node, root``)
    that have the least similarity.

    Texts are read again for the members of families alone, and become sets of
    shingles. A family is compared as a whole by one task, or in blocks pair
    by pair if it is large; only a spanning forest of links comes out, never
    all pairs.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, len(part), 256):
                some = part.slice(i, 256)
                sets = [hashes_of(t.as_py(), scheme) for t in some.column("_text")]
                marks = np.array([fingerprint(h, scheme.words) for h in sets], dtype=np.int64)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column("_id"), *(pa.array(np.ascontiguousarray(m)) for m in marks.T), listed], names=["_id", *scheme.marks, "_set"])

    def block_pair(part: pa.Table) -> pa.Table:
        rep, column = part.column("rep").to_numpy(), part.column("_set").combine_chunks()
        ends, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        a, b = similar_pairs([values[x:y] for x, y in zip(ends, ends[1:])], part.column("_b").to_numpy(), scheme.least)
        return pa.Table.from_batches([_pairs(rep[a], rep[b])])

    families = families.union(families.select(F.col("root").alias("node"), "root").distinct())
    members = store(fps.join(families, F.col("rep") == F.col("node")).select(*scheme.marks, "rep", "root"), "simhash-members")
    texts, _ = sieved(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), F.col("_id"), members.select("rep"))
    texts = texts.join(members.select("rep"), F.col("_id") == F.col("rep"), "left_semi")
    sets = texts.mapInArrow(batches, ", ".join(["_id long", *(f"{w} long" for w in scheme.marks), "_set array<bigint>"])).dropDuplicates(["_id", *scheme.marks])
    rows = sets.withColumnRenamed("_id", "rep").join(members, ["rep", *scheme.marks]).select("root", "rep", "_set")
    rows = store(rows, "simhash-sets")
    sizes = rows.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum(F.size("_set")) / FAMILY_SHINGLES)).cast("int").alias("_n"))
    # a family's number of blocks is dealt to each of its salts, its rows to one
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(sizes, ["root", "_salt"]).drop("_salt")
    dealt = _dealt(rows, F.xxhash64(F.lit(1), "rep"))
    return components(dealt.groupBy("root", "_i", "_j").applyInArrow(block_pair, "a long, b long"))


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, w0 ..., component_id`` per row of ``docs``; ``component_id``
    is the smallest id reachable over links.

    A null text has no words and, like an empty one, the fingerprint zero.
    Rows of one fingerprint, repeated rows too, share a component; a row with
    a null id gets its fingerprint's component (null if only null ids have
    it). Other columns are ignored; an empty table gives an empty one.

    Exact copies of a fingerprint are combined map-side before the index is
    built, so a hot group is one row there.
    """
    marked = store(fingerprints(docs, scheme, id_col, text_col), "simhash-fingerprints")
    distinct = store(marked.groupBy(*scheme.marks).agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = candidates(distinct, scheme)
    if scheme.least is not None:
        roots = verified(roots, distinct, docs, scheme, id_col, text_col)
    named = distinct.join(roots, F.col("rep") == F.col("node"), "left").select(*scheme.marks, F.coalesce("root", "rep").alias("component_id"))
    return marked.join(named, scheme.marks).select("doc_id", *scheme.marks, "component_id")


def keep_one(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates:
    of each component the document with the smallest id stays, once; rows
    without an id stay.

    Only rows whose id goes or comes more than once need others to be judged;
    what the sieve tells apart from these isn't shuffled."""
    told = near_duplicates(docs, scheme).where("doc_id is not null").groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("_n"), F.max(F.col("doc_id") == F.col("component_id")).alias("_stays"))
    told = store(told.where("_n > 1 or not _stays").select("_key", "_stays"), "simhash-judged")
    rows = rows_of(docs).withColumn("_id", F.col("_row.doc_id").cast("long"))
    some, rest = sieved(rows, F.col("_id"), told.select("_key"))
    some = some.join(told, F.col("_id") == F.col("_key"), "left").where("_key is null or _stays").dropDuplicates(["_id"])
    return some.select("_row").unionByName(rest.select("_row")).select("_row.*")
