"""An n-gram model whose counts are tables: a scorer that learns and that no
machine holds.

A gram is a token behind a context of up to ``order - 1`` tokens; contexts are
kept as hashes of their tokens. Learning adds a level of counts, levels of like
size are merged, so that a row is rewritten a logarithmic number of times;
counts are additive.

What tasks send each other are not rows of single grams but sorted runs of them,
packed (:func:`_packed`): each context once, its tokens behind it. A lot of
blocks asks for its distinct grams once, the asks are dealt out by ranges of the
contexts' hashes, meet the counts of that range, and counts alone go back, in
the order of the asks.

The probability of a token behind a context c of n tokens is

    P_n = (count(c, token) + mass * P_(n-1)) / (count(c) + mass)

with P_(n-1) that of the context without its first token, P_(-1) the same for
every id: an unseen context or token leaves the shorter one's probability. It
sums to one over all ids, and any id has a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from millrace.sources.shared import drop, release, store

GRAMS = "n int, ctx long, token int, c long"
#: A model's rows: runs of grams of all lengths, and how many grams.
RUNS = "runs binary, grams long"
#: Tokens that a lot of blocks has, if no single block has more.
LOT = 1 << 21
#: Grams, asked and counted, that a range of contexts has about.
RANGE = 1 << 20


def context(tokens: Column, at: Column, n: int) -> Column:
    """Hash of the ``n`` tokens before the place ``at`` (from 0); null where
    there are fewer, 0 for none."""
    if n == 0:
        return F.lit(0).cast("long")
    return F.when(at >= n, F.xxhash64(F.slice(tokens, F.greatest(at - n, F.lit(0)) + 1, n)))


def places(blocks: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row per token: ``keep``, ``at``, ``token`` and its contexts ``c0``,
    ``c1``, ... by length."""
    at = F.posexplode("token_ids").alias("at", "token")
    rows = blocks.select(*keep, "token_ids", at)
    return rows.select(*keep, "at", "token", *(context(F.col("token_ids"), F.col("at"), n).alias(f"c{n}") for n in range(order)))


def gram_counts(blocks: DataFrame, order: int) -> DataFrame:
    """``n, ctx, token, c``: how often each token follows each context, by
    DataFrame operations alone. :meth:`NgramScorer.update` counts the same with
    far less to shuffle; tests hold it against this.

    Whole grams are counted first and shorter ones from these counts, so that
    tokens are shuffled once and only distinct grams again."""
    names = [f"c{n}" for n in range(order)]
    whole = places(blocks, order).groupBy("token", *names).agg(F.count("*").alias("c"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"c{n}").alias("ctx")) for n in range(order)))).alias("_g")
    return whole.select(each, "token", "c").where("_g.ctx is not null").groupBy("_g.n", "_g.ctx", "token").agg(F.sum("c").alias("c"))


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


def _hashed(tokens: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's ``xxhash64`` of ints (as uint32), each with its own seed."""
    u = np.uint64
    h = (seed + _P5 + u(4)) ^ (tokens.astype(np.uint64) * _P1)
    h = ((h << u(23)) | (h >> u(41))) * _P2 + _P3
    h = (h ^ (h >> u(33))) * _P2
    h = (h ^ (h >> u(29))) * _P3
    return h ^ (h >> u(32))


class Run(NamedTuple):
    """Distinct grams of one length: contexts in order, how many tokens each has,
    and these. A token behind no context has its own hash for one."""

    ctx: np.ndarray
    size: np.ndarray
    token: np.ndarray

    def keys(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each context its place in ``among``, -1 if it isn't there, and
        for each gram a number by that place and the token."""
        at = np.searchsorted(among, self.ctx)
        at[at == len(among)] = 0
        at = np.where(among[at] == self.ctx, at, -1) if len(among) else np.full(len(self.ctx), -1)
        return at, np.repeat(at, self.size) << 32 | self.token.astype(np.int64)

    def cuts(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ``parts`` ranges begins and ends: contexts, grams."""
        part = (self.ctx >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        at = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        return at, np.concatenate(([0], np.cumsum(self.size, dtype=np.int64)))[at]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: all first bytes, all second ones and so on,
    as the higher ones are mostly alike, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype=np.int64)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return head.tobytes() + pa.Codec("zstd").compress(body, asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    body = pa.Codec("zstd").decompress(data[8 + 16 * n :], int(head.prod(axis=1).sum()), asbytes=True)
    out, at = [], 0
    for size, width in head.tolist():
        planes = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}"))
        at += size * width
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, if these do."""
    return values.astype(np.uint32 if not len(values) or values.max() < 1 << 32 else np.uint64)


def _run_bytes(runs: list[Run], counts: list[np.ndarray] | None = None) -> bytes:
    """Runs of all lengths, with counts or without. Contexts and tokens go by
    their steps, which are small where many follow each other."""
    out = []
    for n, run in enumerate(runs):
        step = np.diff(run.token.astype(np.int64), prepend=0)
        out += [np.diff(run.ctx, prepend=np.uint64(0)), run.size.astype(np.uint32), (step << 1 ^ step >> 63).astype(np.uint64 if len(step) and abs(step).max() >= 1 << 31 else np.uint32)]
        out += [_narrow(counts[n])] if counts else []
    return _packed(*out)


def _runs_of(data: bytes, counted: bool) -> tuple[list[Run], list[np.ndarray]]:
    arrays, runs, counts = _unpacked(data), [], []
    for k in range(0, len(arrays), 4 if counted else 3):
        ctx, size, step = arrays[k : k + 3]
        step = step.astype(np.uint64)
        step = (step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64)
        runs.append(Run(np.cumsum(ctx, dtype=np.uint64), size, np.cumsum(step).astype(np.uint32)))
        counts += [arrays[k + 3].astype(np.int64)] if counted else []
    return runs, counts


def _run(ctx: np.ndarray, token: np.ndarray) -> tuple[Run, np.ndarray, np.ndarray]:
    """The distinct grams, and of each row its context's and its gram's place."""
    contexts, of = np.unique(ctx, return_inverse=True)
    grams, own = np.unique(of << 32 | token.astype(np.int64), return_inverse=True)
    return Run(contexts, np.bincount(grams >> 32, minlength=len(contexts)), (grams & 0xFFFFFFFF).astype(np.uint32)), of, own


def _lot(tokens: np.ndarray, at: np.ndarray, order: int) -> Iterator[tuple[Run, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of contexts: the distinct grams, the places that have such
    a context, and these places' contexts and grams."""
    for n in range(order):
        there = np.flatnonzero(at >= n)
        ctx = _hashed(tokens, _SEED) if n == 0 else np.full(len(there), _SEED)
        for back in range(n, 0, -1):
            ctx = _hashed(tokens[there - back], ctx)
        run, of, own = _run(ctx, tokens[there])
        yield run, there, of, own


def _summed(runs: list[Run], counts: list[np.ndarray]) -> tuple[Run, np.ndarray]:
    """Runs as one, the counts of equal grams summed."""
    run, _, own = _run(np.concatenate([np.repeat(r.ctx, r.size) for r in runs]), np.concatenate([r.token for r in runs]))
    total = np.zeros(len(run.token), dtype=np.int64)
    np.add.at(total, own, np.concatenate(counts))
    return run, total


def _ranges(runs: list[Run], counts: list[np.ndarray] | None, parts: int) -> Iterator[tuple[int, bytes]]:
    """The runs by ranges of contexts; ranges without a gram are left out."""
    cuts = [run.cuts(parts) for run in runs]
    for p in range(parts):
        if any(c[p] < c[p + 1] for c, _ in cuts):
            cut = [Run(r.ctx[c[p] : c[p + 1]], r.size[c[p] : c[p + 1]], r.token[g[p] : g[p + 1]]) for r, (c, g) in zip(runs, cuts)]
            yield p, _run_bytes(cut, [x[g[p] : g[p + 1]] for x, (_, g) in zip(counts, cuts)] if counts else None)


def _tokens(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks' tokens as uint32, each one's place in its block, and the
    blocks' lengths; a null is an empty block."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32)
    return tokens, np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size), size


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows as they come, about LOT tokens at a time."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column("token_ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + LOT - n, "right")))
            held.append(batch.slice(at, end - at))
            n, at = n + int(ends[end - 1]) - before, end
            if n >= LOT or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _rows(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of a few hundred rows with bytes."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_DEALT = pa.schema([("part", pa.int32()), ("runs", pa.binary())])
_ASKED = pa.schema([("part", pa.int32()), ("lot", pa.int64()), ("runs", pa.binary())])
_TOLD = pa.schema([("lot", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
_RUNS = pa.schema([("runs", pa.binary()), ("grams", pa.int64())])


class NgramScorer:
    """A scorer of any number of token ids; ``order`` 3 looks at two tokens
    before. ``space`` is the number of ids that an unseen token may be one of."""

    def __init__(self, spark: SparkSession, order: int = 3, mass: float = 4.0, space: int = 1 << 17, blocks: DataFrame | None = None):
        if order < 1 or mass <= 0 or space < 1:
            raise ValueError(f"order and space must be at least 1 and mass above 0, got {order}, {space}, {mass}")
        self.spark, self.order, self.mass, self.space = spark, order, float(mass), space
        self.levels: list[tuple[int, DataFrame, bool]] = []  # grams, their runs, whether they are its own
        self.tokens, self.scratch = 0, []
        if blocks is not None:
            self.update(blocks)

    def copy(self) -> NgramScorer:
        """One that learns apart; levels are never changed and so shared."""
        out = NgramScorer(self.spark, self.order, self.mass, self.space)
        self.levels = [(n, runs, False) for n, runs, _ in self.levels]
        out.levels, out.tokens = list(self.levels), self.tokens
        return out

    def update(self, selected: DataFrame) -> None:
        tokens = selected.agg(F.coalesce(F.sum(F.greatest(F.size("token_ids"), F.lit(0))), F.lit(0))).first()[0]
        parts, order = self._parts(tokens * self.order), self.order

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for lot in _lots(batches):
                    found = [(run, np.bincount(own, minlength=len(run.token))) for run, _, _, own in _lot(*_tokens(lot["token_ids"])[:2], order)]
                    yield from _ranges([r for r, _ in found], [c for _, c in found], parts)

            return _rows(_DEALT, rows())

        self._add(self._merged(selected.select("token_ids").mapInArrow(counted, "part int, runs binary")), tokens)
        while len(self.levels) > 1 and self.levels[-2][0] <= 2 * self.levels[-1][0]:
            last = [self.levels.pop(), self.levels.pop()]
            self._add(self._merged(self._dealt(last, self._parts(sum(n for n, _, _ in last)))), 0)
            self._drop(last)

    @staticmethod
    def _parts(grams: int) -> int:
        return max(1, -(-grams // RANGE))

    def _add(self, runs: DataFrame, tokens: int) -> None:
        runs = store(runs, "ngrams")
        self.levels.append((runs.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0], runs, True))
        self.tokens += tokens
        release(self.spark)

    @staticmethod
    def _drop(levels: list) -> None:
        for _, runs, own in levels:
            if own:
                drop(runs)

    def close(self) -> None:
        """Removes its tables."""
        self.forget()
        self._drop(self.levels)
        self.levels, self.tokens = [], 0

    @staticmethod
    def _dealt(levels: list, parts: int) -> DataFrame:
        """The levels' runs by ``parts`` ranges of contexts."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _rows(_DEALT, (x for b in batches for data in b.column("runs").to_pylist() for x in _ranges(*_runs_of(data, True), parts)))

        return reduce(DataFrame.unionByName, (runs.select("runs") for _, runs, _ in levels)).mapInArrow(cut, "part int, runs binary")

    @staticmethod
    def _merged(dealt: DataFrame) -> DataFrame:
        """A row for each range, each of its grams once."""

        def merge(rows: pa.Table) -> pa.Table:
            found = [_runs_of(data, True) for data in rows["runs"].to_pylist()]
            runs, counts = zip(*(_summed([r[n] for r, _ in found], [c[n] for _, c in found]) for n in range(len(found[0][0]))))
            return pa.Table.from_arrays([pa.array([_run_bytes(runs, counts)], pa.binary()), pa.array([sum(map(len, counts))], pa.int64())], schema=_RUNS)

        return dealt.groupBy("part").applyInArrow(merge, RUNS)

    def grams(self) -> DataFrame:
        """All counts, each gram once."""
        if not self.levels:
            return self.spark.createDataFrame([], GRAMS)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("runs").to_pylist():
                    for n, (run, c) in enumerate(zip(*_runs_of(data, True))):
                        ctx = np.repeat(run.ctx if n else np.zeros_like(run.ctx), run.size).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), pa.array(ctx), pa.array(run.token.view(np.int32)), pa.array(c)], ["n", "ctx", "token", "c"])

        one = self.levels[0][1] if len(self.levels) == 1 else self._merged(self._dealt(self.levels, self._parts(sum(n for n, _, _ in self.levels))))
        return one.select("runs").mapInArrow(rows, GRAMS)

    def logprobs(self, blocks: DataFrame) -> DataFrame:
        """``blocks`` with ``token_logprobs``; an empty block has an empty list.

        Rows are stored in lots, a row each. A lot asks for its distinct grams
        once; what it is told is stored, so that the shuffles of asks and counts
        are gone before its rows are shuffled and read."""
        if not self.levels:
            return blocks.withColumn("token_logprobs", F.coalesce(F.transform("token_ids", lambda _: F.log(F.lit(1.0 / self.space))), F.array().cast("array<double>")))
        order, mass, tokens, uniform = self.order, self.mass, self.tokens, 1.0 / self.space

        def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, rows in enumerate(_lots(batches)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows)
                n = int(_tokens(rows["token_ids"])[2].sum())
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([n], pa.int64())], ["lot", "rows", "n"])

        kept = store(blocks.mapInArrow(lots, "lot long, rows binary, n long"), "ngram-blocks")
        self.scratch.append(kept)
        release(self.spark)
        n = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = self._parts(n * order + sum(n for n, _, _ in self.levels))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for lot, data in zip(batch.column("lot").to_pylist(), batch.column("rows")):
                        ids = pa.ipc.open_stream(data.as_buffer()).read_all()["token_ids"]
                        for part, asked in _ranges([run for run, _, _, _ in _lot(*_tokens(ids)[:2], order)], None, parts):
                            yield part, lot, asked

            return _rows(_ASKED, rows())

        def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
            # counts are additive: every run that is known answers by itself, none is sorted again
            model: list[list[tuple]] = [[] for _ in range(order)]
            for data in known["runs"].to_pylist() if asked.num_rows else ():
                for n, (run, counts) in enumerate(zip(*_runs_of(data, True))):
                    if len(counts):
                        starts = np.cumsum(run.size, dtype=np.int64) - run.size
                        model[n].append((run.ctx, np.add.reduceat(counts, starts), run.keys(run.ctx)[1], counts))
            out = []
            for data in asked["runs"].to_pylist():
                told = []
                for n, run in enumerate(_runs_of(data, False)[0]):
                    own, every = np.zeros(len(run.token), dtype=np.int64), np.zeros(len(run.ctx), dtype=np.int64)
                    for ctx, total, grams, counts in model[n]:
                        of, keys = run.keys(ctx)
                        at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
                        own += np.where(grams[at] == keys, counts[at], 0)
                        every += np.where(of < 0, 0, total[of])
                    told += [_narrow(own), _narrow(every)]
                out.append(_packed(*told))
            return pa.Table.from_arrays([asked["lot"], asked["part"], pa.chunked_array([out], pa.binary())], schema=_TOLD)

        asks = kept.select("lot", "rows").mapInArrow(ask, "part int, lot long, runs binary")
        told = store(asks.groupBy("part").cogroup(self._dealt(self.levels, parts).groupBy("part")).applyInArrow(tell, "lot long, part int, counts binary"), "ngram-told")
        self.scratch.append(told)
        release(self.spark)
        schema = StructType([*blocks.schema.fields, StructField("_p", ArrayType(DoubleType()))])

        def score(lot: pa.Table, told: pa.Table) -> pa.Table:
            rows = pa.ipc.open_stream(lot["rows"][0].as_buffer()).read_all()
            answers = [_unpacked(data) for data in told.sort_by("part")["counts"].to_pylist()]
            ids, at, size = _tokens(rows["token_ids"])
            p = np.full(len(ids), uniform)
            for n, (_, there, of, own) in enumerate(_lot(ids, at, order)):
                if len(there):
                    counts, total = (np.concatenate([a[2 * n + k] for a in answers]).astype(np.int64) for k in (0, 1))
                    p[there] = (counts[own] + mass * p[there]) / ((total[of] if n else tokens) + mass)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(p))
            return rows.append_column("_p", lists)

        scored = kept.select("lot", "rows").groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(score, schema)
        return scored.withColumn("token_logprobs", F.transform("_p", lambda x: F.log(x))).drop("_p")

    def forget(self) -> None:
        """Removes the copies that scored rows are read from, once these are."""
        for kept in self.scratch:
            drop(kept)
        self.scratch = []

    def save(self, spark: SparkSession, path: str) -> None:
        self.grams().write.option("compression", "zstd").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.close()
        saved, order = spark.read.schema(GRAMS).parquet(path), self.order
        grams, tokens = saved.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("c"))), F.lit(0))).first()
        parts = self._parts(grams)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    length, ctx, token, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("n", "ctx", "token", "c"))
                    token, found = token.view(np.uint32), []
                    for n in range(order):
                        own = length == n
                        keys = ctx[own].view(np.uint64) if n else _hashed(token[own], _SEED)
                        run, _, at = _run(keys, token[own])
                        total = np.zeros(len(run.token), dtype=np.int64)
                        np.add.at(total, at, c[own])
                        found.append((run, total))
                    yield from _ranges([r for r, _ in found], [x for _, x in found], parts)

            return _rows(_DEALT, rows())

        self._add(self._merged(saved.mapInArrow(dealt, "part int, runs binary")), tokens)
