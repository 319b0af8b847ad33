"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that is as long as a benchmark item gets a SimHash
of its word shingles. Hamming blocks over the items' fingerprints make all
within the radius candidates, and the exact weighted-shingle similarity (sum of
smaller over sum of larger multiplicities) decides.

A window can only reach the similarity if so many of its shingles occur in the
benchmark at all. So the texts are read once, against a bitmap of all the
benchmark's shingles; what may hold an item is written as word hashes, and only
these rows meet the items, a bounded number of items at a time.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.llm.shared import drop, rows_of, sieved, store
from millrace.sources.shared import kept

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 256. At similarity 0.8 the expected distance is under 39 (standard
#: deviation under 6); eight blocks leave one with at most seven differing bits.
RADIUS, BLOCKS = 63, 8
#: Benchmark items, and words of them, that tasks hold at once; a larger
#: benchmark is applied to the rows that may hold an item in as many passes as
#: it takes. Items go to passes by hash, so a pass holds about so many.
PASS_ITEMS, PASS_WORDS = 20_000, 2_000_000
#: Bits of the bitmap, as a power of two: at least, at most (32 MB).
LEAST_BITS, MOST_BITS = 20, 28
#: Hashes whose bits are spread out at once, and pairs of fingerprints compared at once.
SLICE, TILE = 1 << 14, 1 << 18

_PUNCTUATION = string.punctuation.encode()
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, without case and ASCII punctuation."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles; of fewer words, of the whole sequence."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _bits(h: np.ndarray) -> np.ndarray:
    """256 bits of each hash."""
    wide = (h[:, None] ^ _SALTS) * _SALTS[::-1]
    wide = (wide ^ wide >> np.uint64(32)) * _SALTS
    wide ^= wide >> np.uint64(29)
    return np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")


def simhashes(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` hashes at ``starts`` (ascending),
    eight blocks each: bits that over half of a window's hashes have."""
    first, last = int(starts[0]), int(starts[-1]) + size
    # bits are counted between neighbouring beginnings and ends of windows
    cuts = np.unique(np.concatenate([starts, starts + size, np.arange(first, last, SLICE)]))
    sums = [np.zeros((1, 256), dtype=np.int32)]
    for at in range(first, last, SLICE):
        end = min(at + SLICE, last)
        own = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end)] - at
        sums.append(np.add.reduceat(_bits(h[at:end]), own, axis=0, dtype=np.int32))
    sums = np.cumsum(np.concatenate(sums), axis=0, dtype=np.int32)
    inside = sums[np.searchsorted(cuts, starts + size)] - sums[np.searchsorted(cuts, starts)]
    return np.packbits(2 * inside > size, axis=1, bitorder="little").view(np.uint32)


def simhash(h: np.ndarray) -> int:
    return int.from_bytes(simhashes(h, np.array([0]), len(h)).tobytes(), "little")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags of shingles."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def candidates(marks: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of which some block differs by at most its share of the radius:
    places in ``marks``, in ``others``, and the whole distance. All pairs
    within the radius are among them; of random ones about 0.8 %."""
    found = []
    step = max(1, TILE // max(1, len(marks)))
    for at in range(0, len(others), step):
        apart = np.bitwise_count(marks[:, None, :] ^ others[None, at : at + step, :])
        a, b = np.nonzero((apart <= RADIUS // BLOCKS).any(axis=2))
        found.append((a, b + at, apart[a, b].sum(axis=1, dtype=np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def windows(hits: np.ndarray, total: int, lengths: list[int], k: int, least: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(item length, shingles of a window, starts)`` of the windows that hold
    enough of the shingles at ``hits`` to reach the similarity with an item of
    that length; ``total`` is the number of the text's shingles."""
    if not len(hits):
        return
    # nothing further than the longest window from a hit matters
    low, high = max(0, int(hits[0]) - lengths[-1]), min(total, int(hits[-1]) + lengths[-1])
    sums = None
    for n in lengths:
        size = min(n - k + 1, total)
        # shared of a window's and an item's shingles for the similarity
        need = math.ceil(least / (1 + least) * (size + n - k + 1) - 1e-9)
        if len(hits) < need:
            continue
        if sums is None:
            marked = np.zeros(high - low, dtype=np.int32)
            marked[hits - low] = 1
            sums = np.concatenate([[0], np.cumsum(marked)])
        starts = np.flatnonzero(sums[size:] - sums[:-size] >= need) + low
        if len(starts):
            yield n, size, starts


def by_shingle(lengths: list[int]) -> dict[int, list[int]]:
    """Item lengths, ascending, by the number of words in their shingles."""
    out = defaultdict(list)
    for n in sorted(lengths):
        out[min(SHINGLE, n)].append(n)
    return dict(out)


class Sieve:
    """Tells texts that hold no item of the whole benchmark from others: its
    shingles as a bitmap, and the lengths of its items."""

    def __init__(self, bits: np.ndarray, lengths: list[int], least: float):
        self.bits, self.lengths, self.least = bits, by_shingle(lengths), least
        self.shift = np.uint64(64 - (len(bits).bit_length() - 1) - 3)

    def passes(self, words: np.ndarray) -> bool:
        for k, lengths in self.lengths.items():
            # a text shorter than the shingle has none of this length
            if len(words) >= k:
                h = shingles(words, k)
                at = h >> self.shift
                hits = np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                if any(True for _ in windows(hits, len(h), lengths, k, self.least)):
                    return True
        return False


class Finder:
    """Finds one pass's items, ``(item_id, word hashes)``, in texts."""

    def __init__(self, items: list[tuple[int, bytes]], least: float = SIMILARITY):
        self.least, self.items, self.bags = least, [], {}
        of, known = defaultdict(list), defaultdict(list)
        for key, packed in items:
            words = np.frombuffer(packed, dtype=np.uint64)
            h = shingles(words, SHINGLE)
            of[len(words)].append(len(self.items))
            known[min(SHINGLE, len(words))].append(h)
            self.items.append((key, h))
        self.lengths = by_shingle(list(of))
        self.known = {k: np.unique(np.concatenate(h)) for k, h in known.items()}
        #: by the items' words: their places, and their fingerprints
        self.blocks = {n: (at, np.concatenate([simhashes(h, np.array([0]), len(h)) for _, h in (self.items[i] for i in at)])) for n, at in of.items()}

    def find(self, words: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """``(item, similarity, first word, words, distance)`` of the best
        window for each item that some window matches; the first of equals."""
        best = {}
        for k, lengths in self.lengths.items():
            if len(words) < k:
                continue
            h, known = shingles(words, k), self.known[k]
            hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            for n, size, starts in windows(hits, len(h), lengths, k, self.least):
                self._verify(h, starts, n, size, size + k - 1, best)
        return [(key, *found) for key, found in sorted(best.items())]

    def _verify(self, h: np.ndarray, starts: np.ndarray, n: int, size: int, words: int, best: dict) -> None:
        at, others = self.blocks[n]
        for part in (starts[i : i + 256] for i in range(0, len(starts), 256)):
            bag, last = None, -1
            for w, i, apart in zip(*(x.tolist() for x in candidates(simhashes(h, part, size), others))):
                if apart > RADIUS:
                    continue
                if w != last:
                    last, bag = w, Counter(h[part[w] : part[w] + size].tolist())
                key, item = self.items[at[i]]
                if at[i] not in self.bags:
                    self.bags[at[i]] = Counter(item.tolist())
                s = similarity(bag, self.bags[at[i]])
                found = s, int(part[w]), words, apart
                # candidates come by tiles of items, so windows may not ascend
                if s >= self.least and (key not in best or (-s, found[1]) < (-best[key][0], best[key][1])):
                    best[key] = found


_LEAK = "item_id long, similarity double, first_word int, n_words int, distance int"


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, n_words, words`` of the distinct items. Those without an id
    or without words can't be found and are passed over; of texts that share an
    id each is an item of its own."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t) for t in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int32()), pa.array([w.tobytes() for w in words], pa.binary())], ["item_id", "n_words", "words"])
            yield out.filter(pa.array([len(w) > 0 for w in words]))

    texts = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return texts.mapInArrow(hashed, "item_id long, n_words int, words binary").distinct()


def _sieve(items: DataFrame, n_words: int, least: float) -> Sieve:
    """The driver gets a bitmap of bounded size and the distinct lengths, which
    are at most about the square root of twice the benchmark's words."""
    power = min(max((16 * n_words).bit_length(), LEAST_BITS), MOST_BITS)
    shift = np.uint64(64 - power)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                at = np.unique(shingles(np.frombuffer(packed, dtype=np.uint64), SHINGLE) >> shift).astype(np.int64)
                for bucket in np.unique(at >> 15).tolist():
                    bits = held.setdefault(bucket, np.zeros(4096, dtype=np.uint8))
                    own = at[at >> 15 == bucket] & 32767
                    np.bitwise_or.at(bits, own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["bucket", "bits"])

    bits = np.zeros(1 << power - 3, dtype=np.uint8)
    for row in items.select("words").mapInArrow(marked, "bucket int, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        bits[row["bucket"] << 12 : row["bucket"] + 1 << 12] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Sieve(bits, [r["n_words"] for r in items.select("n_words").distinct().collect()], least)


def _suspects(texts: DataFrame, sieve: Sieve) -> DataFrame:
    """``_key, _words`` of the texts that may hold an item."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                hashes = word_hashes(text)
                if sieve.passes(hashes):
                    at.append(i)
                    words.append(hashes.tobytes())
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(words, pa.binary())], ["_key", "_words"])

    return texts.mapInArrow(held, StructType([StructField("_key", texts.schema[0].dataType), StructField("_words", BinaryType())]))


def _search(suspects: DataFrame, items: list[Row], least: float) -> DataFrame:
    packed = sorted((r["item_id"], bytes(r["words"])) for r in items)
    kind = StructType([StructField("_key", suspects.schema["_key"].dataType), *StructType.fromDDL(_LEAK).fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(packed, least)
        types = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            at, leaks = [], []
            for i, words in enumerate(batch.column(1).to_pylist()):
                some = finder.find(np.frombuffer(words, dtype=np.uint64))
                at += [i] * len(some)
                leaks += some
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, zip(*leaks), types)], kind.names)

    return suspects.mapInArrow(found, kind)


def leaks(texts: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``_key, item_id, similarity, first_word, n_words, distance`` of the
    benchmark items found in ``texts``, whose first column is the key and whose
    last is the text (one column may be both). No key is joined or grouped.

    Texts are read once and whole. Null and empty texts hold nothing; a text
    shorter than an item is one window for it; items of fewer words than a
    shingle are one shingle; an empty benchmark finds nothing. No shuffle of
    texts: a bitmap of at most 32 MB finds the rows that may hold an item,
    which are stored as word hashes, and each pass holds about PASS_ITEMS items
    or PASS_WORDS words (one longer item: that item). With more than some ten
    million items the bitmap fills up and keeps more rows than need be, but
    loses none.
    """
    items = store(_items(benchmark), "benchmark-items")
    n, words = items.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    suspects = store(_suspects(texts, _sieve(items, words, least)), "benchmark-suspects")
    total = max(math.ceil(n / PASS_ITEMS), math.ceil(words / PASS_WORDS))
    if total < 2:
        return _search(suspects, items.collect(), least)
    paths = []
    for i in range(total):
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(total)) == i).collect()
        out = store(_search(suspects, part, least), "benchmark-leaks")
        paths.append(out._millrace_path)
    for done in (items, suspects):
        drop(done)
    return out.sparkSession.read.schema(out.schema).parquet(*paths)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words, distance`` per
    document and item found in it. Repeated rows each give theirs, null ids
    stay null, other columns are ignored, empty tables give an empty one. Very
    long texts are searched whole, their windows 256 at a time."""
    return leaks(docs.select("doc_id", "text"), benchmark, least).withColumnRenamed("_key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their
    columns, whatever these are called. Rows with null or empty texts stay, and
    repeated rows stay or go together.

    Whether a row goes depends on its text alone, so the texts that hold an
    item are joined back; a bitmap of fixed size spares the others that join."""
    held = rows_of(kept(docs, "benchmark-docs"))
    found = leaks(held.select(F.col("_row.text").alias("_text")), benchmark, least)
    leaky = store(found.select(F.col("_key").alias("_leaks")).distinct(), "benchmark-leaky")
    may, others = sieved(held, F.xxhash64("_row.text"), leaky.select(F.xxhash64("_leaks").alias("_hash")))
    return may.join(leaky, F.col("_row.text") == F.col("_leaks"), "left_anti").union(others).select("_row.*")
