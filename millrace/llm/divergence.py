"""Source divergence audit: by which terms a source differs from its language,
and how far the sources of a language lie apart.

A first pass makes a count-min sketch of document frequencies: every task fills
its own, sketches are merged block by block. Counters never underestimate, so a
term whose counters stay below the least frequency can't be kept; the second
pass drops it before anything is shuffled. What survives is counted exactly, and
pairs of sources are joined on the terms that both hold; terms that one or both
lack follow from counts alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.shared import store


class Sketch(NamedTuple):
    """Counters a row, rows, and counters of a block, the unit in which sketches
    are merged. A counter is a byte that stops at the least frequency, so only
    the number of terms matters, not that of their occurrences. A sketch that
    kept terms fill lets more of the others through; results don't change."""

    width: int = 1 << 20
    depth: int = 4
    block: int = 1 << 16


#: Terms, with repeats, of the texts that a task counts at a time.
HELD = 1 << 22
#: Characters of a text that are split into words at a time.
PIECE = 1 << 20
#: Bytes that are part of no term become blanks; A-Z are lower-cased.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
COUNTED = "lang string, source string, term string, occurrences long, docs long"


def terms(text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, by pieces that end behind a term: runs of
    letters a-z and characters beyond ASCII, A-Z lower-cased."""
    at, rest = 0, b""
    while at < len(text):
        body = rest + text[at : at + piece].encode("utf-8", "replace").translate(_LETTERS)
        at += piece
        cut = len(body) if at >= len(text) else body.rfind(b" ") + 1
        rest = body[cut:]
        # bytes split at ASCII blanks alone: those from 128 on belong to characters of a term
        yield body[:cut].split()


def cells(lang: str, found: list[bytes], shape: Sketch = Sketch()) -> np.ndarray:
    """A column of counter numbers for each term: one of every row."""
    salt = lang.encode("utf-8", "replace") + b"\0"
    low = np.fromiter((xxhash.xxh3_64_intdigest(salt + t) for t in found), np.uint64, len(found))
    step = (low >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(d) * step) % np.uint64(shape.width) + np.uint64(d * shape.width) for d in range(shape.depth)]).astype(np.int64)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))


class _Lot:
    """Texts of one language that are counted at a time. Each distinct term is
    looked up once for the whole lot; what is counted are numbers."""

    def __init__(self) -> None:
        self.sources: list[str] = []
        self.bodies: list[bytes] = []

    def counts(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct terms, and for each term of each document its row, the
        term's number and how often it is there; in that order."""
        lists = pc.split_pattern(pa.array(self.bodies, pa.binary()), b" ")
        found = lists.flatten().dictionary_encode()
        codes, n = found.indices.to_numpy(zero_copy_only=False), max(1, len(found.dictionary))
        keys = np.repeat(np.arange(len(self.bodies)) * n, np.diff(lists.offsets.to_numpy())) + codes
        blank = pc.index(found.dictionary, pa.scalar(b"", pa.binary())).as_py()
        keys = keys[codes != blank]
        keys.sort()
        own, times = _runs(keys)
        return found.dictionary, *np.divmod(own, n), times


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted ``keys`` once, and how often it is there."""
    at = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, _Lot] | tuple[str, str, Counter]]:
    """Lots by language of HELD terms in all, or little more. A text that is
    longer than a piece is one by itself: language, source and its terms, as it
    is never split into all of them at once. Texts become Python strings one at
    a time."""
    lots: dict[str, _Lot] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            text = text.as_py()
            if len(text) > PIECE:
                own: Counter = Counter()
                for piece in terms(text):
                    own.update(piece)
                yield lang, source, own
                continue
            lot = lots.setdefault(lang, _Lot())
            body = text.encode("utf-8", "replace").translate(_LETTERS)
            lot.sources.append(source)
            lot.bodies.append(body)
            # long terms, too, take their bytes
            size += max(body.count(b" ") + 1, len(body) >> 3)
            if size > HELD:
                yield lots
                lots, size = {}, 0
    if lots:
        yield lots


def sketch(docs: DataFrame, least: int, shape: Sketch = Sketch()) -> DataFrame:
    """``block, counters`` of the merged sketch of (lang, term) document
    frequencies, counters stopping at ``least`` (255 at most)."""
    if not 0 < least <= 255:
        raise ValueError(f"the least frequency must be in 1..255, got {least}")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # wide enough for all documents of a task; rows end up as bytes
        counters = np.zeros(shape.width * shape.depth, dtype=np.int32)

        def add(lang: str, found: list[bytes], number: np.ndarray) -> None:
            for row in cells(lang, found, shape):
                np.add.at(counters, row, number)

        for lot in _lots(batches):
            if isinstance(lot, tuple):
                lang, _, own = lot
                add(lang, list(own), np.ones(len(own), np.int32))
                continue
            for lang, texts in lot.items():
                words, _, code, _ = texts.counts()
                number = np.bincount(code, minlength=len(words)).astype(np.int32)
                there = np.flatnonzero(number)
                add(lang, words.take(pa.array(there)).to_pylist(), number[there])
        counters = np.minimum(counters, least).astype(np.uint8)
        yield _blocks({b: counters[b * shape.block : (b + 1) * shape.block] for b in range(len(counters) // shape.block)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, body in zip(batch.column("block").to_pylist(), batch.column("counters")):
                own = np.frombuffer(body.as_buffer(), dtype=np.uint8)
                # two bytes, as two full counters need more than one
                sums[b] = np.minimum(sums[b].astype(np.uint16) + own, least).astype(np.uint8) if b in sums else own.copy()
        yield _blocks(sums)

    parts = _documents(docs).mapInArrow(fill, "block int, counters binary")
    return parts.repartition("block").mapInArrow(merge, "block int, counters binary")


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    some = {b: c for b, c in sums.items() if c.any()}
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([c.tobytes() for c in some.values()], pa.binary())], names=["block", "counters"])


def counted(docs: DataFrame, least: int, shape: Sketch = Sketch()) -> DataFrame:
    """``lang, source, term, occurrences, docs`` of all terms that may be in
    ``least`` documents of their language: exact sums, one row each, dealt out
    by language and term.

    The merged sketch has as many bytes as ``shape`` has counters, whatever the
    input; tasks get it as a broadcast."""
    spark = docs.sparkSession
    merged = np.zeros(shape.width * shape.depth, dtype=np.uint8)
    for row in sketch(docs, least, shape).toLocalIterator():
        merged[row["block"] * shape.block : (row["block"] + 1) * shape.block] = np.frombuffer(row["counters"], dtype=np.uint8)
    shared = spark.sparkContext.broadcast(merged)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value

        def stay(lang: str, found: list[bytes]) -> np.ndarray:
            return (counters[cells(lang, found, shape)] >= least).all(axis=0)

        def rows(lang: str, source: pa.Array, term: pa.Array, occurrences: np.ndarray, in_docs: np.ndarray) -> pa.RecordBatch:
            columns = [pa.repeat(pa.scalar(lang), len(term)), source, term.cast(pa.string()), pa.array(occurrences, pa.int64()), pa.array(in_docs, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "occurrences", "docs"])

        for lot in _lots(batches):
            if isinstance(lot, tuple):
                lang, source, own = lot
                found = list(own)
                some = [found[i] for i in np.flatnonzero(stay(lang, found))]
                if some:
                    yield rows(lang, pa.repeat(pa.scalar(source), len(some)), pa.array(some, pa.binary()), np.array([own[t] for t in some]), np.ones(len(some), np.int64))
                continue
            for lang, texts in lot.items():
                words, row, code, times = texts.counts()
                kept = stay(lang, words.to_pylist())[code]
                names, of = np.unique(np.array(texts.sources, dtype=object), return_inverse=True)
                keys, times = of[row[kept]] * len(words) + code[kept], times[kept]
                order = np.argsort(keys, kind="stable")
                own, in_docs = _runs(keys[order])
                if len(own):
                    source, code = np.divmod(own, len(words))
                    occurrences = np.add.reduceat(times[order], np.cumsum(in_docs) - in_docs)
                    yield rows(lang, pa.array(names, pa.string()).take(pa.array(source)), words.take(pa.array(code)), occurrences, in_docs)

    found = _documents(docs).mapInArrow(count, COUNTED)
    # a task's rows of a term differ already: nothing to sum before they are dealt out
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def share(occurrences: str, of: str) -> Column:
    """1 + floor(SCALE * (occurrences + 2) / of), a long; products in decimals."""
    return (F.expr(f"(cast({occurrences} as decimal(18,0)) + 2) * cast({SCALE} as decimal(10,0)) div cast({of} as decimal(19,0))") + 1).cast("long")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are 10^9 + 1 at most, so a long holds it."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def divergence(docs: DataFrame, least: int = 10, top: int = 10, shape: Sketch = Sketch()) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Terms are runs of ``a-z`` (A-Z lower-cased) and of characters beyond ASCII.
    A language keeps the V terms that ``least`` of its documents hold. With N
    occurrences of kept terms, a group gives each of them the share
    1 + floor(10^9 (count + 2) / (N + 2 V)). Part ``pair``: for each source and
    each other of its language the summed distance of their shares, all ranks.
    Part ``term``: a source's terms above the language's share, the ``top`` most
    distant. Ranks go by value, then by item in UTF-8 order.

    Null lang, source and text are ''. Every (lang, source) that occurs is a
    group, also without any term; a language that keeps none has pairs of value
    0 and no terms. Repeated rows count as often as they are there. Very long
    texts are split by pieces. An empty table gives no rows; columns other than
    lang, source and text are left alone.

    A frequent term is one row of each task that holds it, then one row of each
    source. Pairs are joined by term among a language's sources alone.
    """
    seen, whole = counted(docs, least, shape), Window.partitionBy("lang", "term")
    groups = _documents(docs).select("lang", "source").distinct()
    groups = store(groups, "groups")
    # the window finds a term's rows where the counting left them
    seen = seen.select("lang", "source", "term", F.col("occurrences").alias("n"), F.sum("occurrences").over(whole).alias("all"), F.sum("docs").over(whole).alias("_docs"))
    kept = store(seen.where(F.col("_docs") >= least).drop("_docs"), "kept-terms")
    # once per language and group: V terms, N occurrences
    words = kept.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.count("*").alias("V"), F.sum("all").alias("N_all"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("N"), F.count("*").alias("there"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sums = groups.join(sums, ["lang", "source"], "left").join(words, "lang", "left").select("lang", "source", zero("N"), zero("there"), zero("V"), zero("N_all"))
    sums = store(sums.select("*", (F.col("N") + 2 * F.col("V")).alias("of"), (F.col("N_all") + 2 * F.col("V")).alias("of_all")).withColumn("p0", F.when(F.col("V") > 0, share("0", "nullif(of, 0)"))), "sums")
    rows = kept.join(sums.select("lang", "source", "of", "of_all", "p0"), ["lang", "source"])
    rows = store(rows.select("lang", "source", "term", "p0", share("n", "of").alias("p"), share("`all`", "of_all").alias("q")), "shares")
    return _ranked(_terms(rows), "term").where(F.col("rank") <= top).unionByName(_ranked(_pairs(rows, sums), "pair"))


def _terms(rows: DataFrame) -> DataFrame:
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))


def _ranked(found: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))


def _pairs(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Distances of all pairs. Terms that both lack differ by their p0 alone;
    for those that one holds only its share matters, so they are counted by
    share; what the join finds corrects these for terms that both hold."""
    a = sums.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "V")
    b = sums.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    couples = store(a.join(b, "lang").where("a < b"), "couples")
    histogram = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    base = distance("a0", "b0")

    def alone(side: str, other: str) -> DataFrame:
        told = couples.join(histogram.withColumnRenamed("source", side), ["lang", side])
        more = (_big(distance("p", f"{other}0")) - _big(base)) * _big("m")
        return told.groupBy("lang", "a", "b").agg(F.sum(more).alias("more"))

    left, right = (rows.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p{s}"), F.col("p0").alias(f"{s}0")) for s in "ab")
    both = left.join(right, ["lang", "term"]).where("a < b")
    more = _big(distance("pa", "pb")) - _big(distance("pa", "b0")) - _big(distance("a0", "pb")) + _big(base)
    parts = alone("a", "b").unionByName(alone("b", "a")).unionByName(both.groupBy("lang", "a", "b").agg(F.sum(more).alias("more")))
    told = couples.join(parts.groupBy("lang", "a", "b").agg(F.sum("more").alias("more")), ["lang", "a", "b"], "left")
    value = F.coalesce(_big(base) * _big("V") + F.coalesce("more", _big(F.lit(0))), _big(F.lit(0)))
    told = told.select("lang", "a", "b", value.alias("value"))
    both_ways = F.explode(F.array(*(F.struct(F.col(s).alias("source"), F.col(o).alias("item")) for s, o in ("ab", "ba"))))
    return told.select("lang", both_ways.alias("_x"), "value").select("lang", "_x.*", "value")


def oracle(least: int = 10, top: int = 10) -> str:
    """The same in DuckDB SQL, over every kept term of every group."""
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
        x AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM x GROUP BY ALL HAVING count(DISTINCT id) >= {least}),
        v AS (SELECT lang, count(*) AS V, sum(n) AS N FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
        s AS (SELECT lang, source, sum(n) AS N FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.N, 0) + 2 * v.V))::HUGEINT AS p, (1 + {SCALE}::HUGEINT * (k.n + 2) // (v.N + 2 * v.V))::HUGEINT AS q
            FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""
