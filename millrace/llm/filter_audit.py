"""Filter interaction audit: what each filter removes after each set of others.

Rows are turned into packed bitmaps, one bit a row: one for each filter (set
where the row fails it), one for each label and one for each part. For every
set of filters that may have come before, AND-NOT leaves the rows that still
stand, and their bits are counted. Counts of batches are summed within a
partition, and partitions by one small aggregate; no row is shuffled for them.
From the counts of the 2^n sets all orders follow without the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import store

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Filters of one audit: 2^n sets and n! orders are made of them.
MAX_FILTERS = 6
#: Sums held by a task before it hands them on: parts times sets.
HELD = 1 << 16
COUNTS = "part string, subset int, n long, good long, toxic long"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def document_failures(text: Column) -> dict[str, Column]:
    """What a text fails by itself: A under 50 words, B few distinct words,
    C many capitals, D holds a symbol. An empty text fails A alone."""
    own = words(text)
    n = F.size(own)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 50, "B": F.size(F.array_distinct(own)) * F.lit(100) < n * F.lit(65), "C": capitals * F.lit(100) > F.length(text) * F.lit(5), "D": text.rlike(r"[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, booleans ``A``-``E`` and labels ``good``, ``toxic`` per document.

    ``docs`` has doc_id, text and source; ``labels`` doc_id, quality and toxic;
    other columns are left alone. A null text is empty, a null source the part
    ''. ``E``: a smaller doc_id has the same text, found by SHA-256 over the
    whole table. Rows without a doc_id never fail E, make no other row fail it,
    and have no label; a row that is there twice doesn't fail E by its twin.
    Of several labels of one document each counts that says 1.

    Texts are read once. E joins by id and digest, so a text that a third of
    all rows share is nowhere gathered; its digest is only aggregated.
    """
    text = F.coalesce("text", F.lit(""))
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), *(c.alias(k) for k, c in document_failures(text).items()), F.unhex(F.sha2(text, 256)).alias("_digest"))
    told = store(told, "failures")
    first = told.where("doc_id is not null").groupBy("_digest").agg(F.min("doc_id").alias("_id")).select("_id", F.col("_digest").alias("_of"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_label")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    rows = told.join(first, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("_of")), "left").join(marks, F.col("doc_id") == F.col("_label"), "left")
    label = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("part", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("_id").isNull()).alias("E"), label("good"), label("toxic"))


def batch_counts(part: np.ndarray, fails: Sequence[np.ndarray], labels: Sequence[np.ndarray]) -> np.ndarray:
    """Rows that stand after each set of filters, in all and by label: an array
    (parts, sets, 1 + labels) for rows whose ``part`` is a code from 0.

    Rows are laid out by part and each part begins at a byte, so that its bitmap
    is one run of bytes and zero elsewhere: only the run is kept and counted."""
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part)
    width = -(-sizes // 8)
    start = np.concatenate([[0], np.cumsum(width)[:-1]])
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(part)) - np.repeat(before, sizes) + np.repeat(start * 8, sizes)

    def packed(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(width.sum()) * 8, dtype=bool)
        bits[place] = flags[order]
        return np.packbits(bits)

    failing = [packed(f) for f in fails]
    marked = [packed(f) for f in labels]
    stand = [packed(np.ones(len(part), dtype=bool))]
    out = np.zeros((len(sizes), 1 << len(fails), 1 + len(labels)), dtype=np.int64)
    for subset in range(1 << len(fails)):
        if subset:
            last = subset.bit_length() - 1
            stand.append(stand[subset ^ (1 << last)] & ~failing[last])
        for k, bits in enumerate([stand[subset], *(stand[subset] & m for m in marked)]):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), start)
    return out


def prefix_counts(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """``part, subset, n, good, toxic``: how many rows fail no filter of the set
    whose bits ``subset`` has; every part has all sets. ``rows`` holds ``part``
    (a string, not null), booleans named by ``filters``, ``good`` and ``toxic``."""
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters, got {len(filters)}")
    sets = 1 << len(filters)

    def table(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = np.stack(list(sums.values()))
        columns = [pa.array(np.repeat(np.array(list(sums), dtype=object), sets), pa.string()), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(sums)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, :, k].reshape(-1)) for k in range(3))], names=["part", "subset", "n", "good", "toxic"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("part").dictionary_encode()
            flags = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in (*filters, "good", "toxic")}
            found = batch_counts(coded.indices.to_numpy(), [flags[c] for c in filters], [flags["good"], flags["toxic"]])
            for name, own in zip(coded.dictionary.to_pylist(), found):
                sums[name] = sums[name] + own if name in sums else own
            if len(sums) * sets > HELD:
                yield table(sums)
                sums = {}
        if sums:
            yield table(sums)

    held = rows.select("part", *filters, "good", "toxic").mapInArrow(count, COUNTS)
    return held.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``kept`` rows stand after the step and ``removed`` go there; ``redundant``
    ones fail its filter but went before; ``unique_fails`` fail it alone;
    ``good_lost`` and ``toxic_lost`` are the labelled among the removed;
    ``shapley`` is what the filter removes, summed over all orders. A table
    without rows has no part and gives none.
    """
    counts = prefix_counts(rows, filters)
    by_set = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("_s"))
    steps, whole = [], (1 << len(filters)) - 1
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, before, i))
            before |= 1 << i
    gone = lambda i, s: F.get("_s.n", F.lit(s)) - F.get("_s.n", F.lit(s | 1 << i))
    often = Counter((i, before) for _, _, before, i in steps)
    totals = [sum((gone(i, s) * F.lit(n) for (own, s), n in sorted(often.items()) if own == i), F.lit(0).cast("long")) for i in range(len(filters))]
    told = by_set.select("part", "_s", F.array(*totals).alias("_shapley"))
    plan = F.explode(F.from_json(F.lit(str([list(map(str, s)) for s in steps]).replace("'", '"')), "array<array<string>>")).alias("_step")
    told = told.select("part", "_s", "_shapley", plan)
    at = lambda k: F.get("_step", F.lit(k)).cast("int")
    told = told.select("part", "_s", "_shapley", F.get("_step", F.lit(0)).alias("filter_order"), at(1).alias("step"), at(2).alias("_before"), at(3).alias("_filter"))
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(len(filters)))), F.col("_filter") + 1)
    after = F.col("_before").bitwiseOR(bit)
    n = lambda c, s: F.get(f"_s.{c}", s)
    lost = lambda c: n(c, F.col("_before")) - n(c, after)
    failing = n("n", F.lit(0)) - n("n", bit)
    return told.select(
        "part", "filter_order", "step", n("n", after).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        (n("n", F.lit(whole).bitwiseXOR(bit)) - n("n", F.lit(whole))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("_shapley", F.col("_filter")).alias("shapley"),
    )


def oracle() -> str:
    """The same report of filters A-E in DuckDB SQL."""
    return r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS (SELECT part, doc_id, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails FROM w),
        m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        s AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY ALL),
        l AS (SELECT unnest(range(5)) AS i),
        o AS (SELECT a.i AS i1, b.i AS i2, c.i AS i3, d.i AS i4, e.i AS i5 FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        k AS (SELECT list_aggregate(list_transform([i1, i2, i3, i4, i5], lambda i: substr('ABCDE', 1 + i::INT, 1)), 'string_agg', '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step,
            unnest([0, 1 << i1, (1 << i1) | (1 << i2), 31 - (1 << i4) - (1 << i5), 31 - (1 << i5)]) AS before, unnest([1 << i1, 1 << i2, 1 << i3, 1 << i4, 1 << i5]) AS own FROM o),
        r AS (SELECT part, filter_order, step, own,
            sum(n) FILTER (fails & (before | own) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & own > 0) AS removed, sum(n) FILTER (fails & before > 0 AND fails & own > 0) AS redundant,
            sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (fails & before = 0 AND fails & own > 0) AS good_lost, sum(toxic) FILTER (fails & before = 0 AND fails & own > 0) AS toxic_lost
            FROM s, k GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
            coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
        FROM r"""
