"""Quality rules with line labelling: a linear-chain conditional random field
marks each line content or boilerplate, Viterbi decoding finds the best
labels, and the share of words in content lines decides retention."""

from __future__ import annotations

import logging
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import rows_of

log = logging.getLogger(__name__)

#: Bounds of the training sample: documents of each class; pieces of each, and
#: lines of a piece. Of a longer document the pieces at even distances count.
TRAIN_DOCS, TRAIN_PIECES, PIECE = 400, 32, 64
#: Least share of a document's words in content lines.
MIN_SHARE = 0.5

N_FEATURES = 14
SYMBOLS = "#*$%&|<>"
_SYMBOLS, _UPPER, _LETTERS, _DIGITS = SYMBOLS.encode(), string.ascii_uppercase.encode(), string.ascii_letters.encode(), string.digits.encode()
_OTHER = re.compile(r"[^\x00-\x7F]+")
_SPACES = " \t\n\x0b\x0c\r"
#: What notices say, in lower case.
_NOTICES = ("license", "licence", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service", "click here", "subscribe")


def words_of(text: str) -> list[bytes]:
    """Maximal runs without ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words covered by n-word windows that occur twice or more in the text."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    key = seq[: len(seq) - n + 1]
    for k in range(1, n):
        # dense codes of the windows so far keep the product in 64 bits
        key = np.unique(key * len(ids) + seq[k : len(seq) - n + 1 + k], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    cover = np.zeros(len(seq), dtype=bool)
    for k in range(n):
        cover[k : len(seq) - n + 1 + k] |= again
    return int(cover.sum())


def _without(raw: bytes, some: bytes) -> int:
    """How many of the bytes are among ``some``."""
    return len(raw) - len(raw.translate(None, some))


def base_rules(text: str) -> Base:
    raw, seen, dup = text.encode("utf-8", "surrogatepass"), set(), 0
    words = raw.split()
    for line in text.split("\n"):
        if line.strip(_SPACES):
            dup += line in seen
            seen.add(line)
    return Base(len(words), len(text) - _without(raw, _SPACES.encode()), _without(raw, _SYMBOLS), dup, repeat_words(words))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of 0/1 features per line, and the lines' word counts."""
    lines, seen = text.split("\n"), set()
    out, sizes = [], []
    lower = text.lower()
    notices = [w for w in _NOTICES if w in lower]
    for line in lines:
        raw = line.encode("utf-8", "surrogatepass")
        words = raw.split()
        n, chars = len(words), max(len(line), 1)
        sizes.append(n)
        letters, upper, digits = _without(raw, _LETTERS), _without(raw, _UPPER), _without(raw, _DIGITS)
        if len(raw) > len(line):
            other = "".join(_OTHER.findall(line))
            letters += sum(map(str.isalpha, other))
            upper += sum(map(str.isupper, other))
            digits += sum(map(str.isdigit, other))
        twice = sum(map(bytes.__eq__, words, words[1:])) if n > 3 else 0
        out.append((
            1, n == 0, 0 < n < 4, 4 <= n < 12, n >= 12,
            n > 1 and upper > 0.5 * (letters or 1), line.count("!!") > 1, _without(raw, _SYMBOLS) > 0.04 * chars, line.count("|") > 2,
            digits > 0.2 * chars, n > 0 and line in seen, n > 3 and 4 * twice > n,
            n > 11 and 2 * len(set(words)) < n, bool(notices) and n < 40 and any(w in line.lower() for w in notices),
        ))
        seen.add(line)
    return np.array(out, dtype=float), np.array(sizes, dtype=np.int64)


@dataclass(frozen=True)
class Crf:
    """Scores: lines' features by label, label pairs, first label. Label 1 is content."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label sequence (Viterbi); of equal scores, content."""
        score = x @ self.emit
        best0, best1 = self.start[0] + score[0, 0], self.start[1] + score[0, 1]
        (s00, s01), (s10, s11) = self.step.tolist()
        back = np.empty((len(x), 2), dtype=np.int8)
        for t, (e0, e1) in enumerate(score[1:].tolist(), 1):
            from0, from1 = best0 + s00, best1 + s10
            to0, to1 = best0 + s01, best1 + s11
            back[t] = from1 >= from0, to1 >= to0
            best0, best1 = max(from0, from1) + e0, max(to0, to1) + e1
        labels = np.empty(len(x), dtype=np.int8)
        labels[-1] = best1 >= best0
        for t in range(len(x) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels


@dataclass(frozen=True)
class Sample:
    """A labelled document: features and word counts of its lines with words,
    as pieces of consecutive lines."""

    good: int
    lines: tuple[np.ndarray, ...]
    sizes: tuple[np.ndarray, ...]


def sample_of(text: str, good: int) -> Sample:
    x, sizes = line_features(text)
    x, sizes = x[sizes > 0], sizes[sizes > 0]
    n = -(-len(x) // PIECE)
    some = sorted({i * n // TRAIN_PIECES for i in range(TRAIN_PIECES)} if n > TRAIN_PIECES else range(n))
    cut = [slice(PIECE * i, PIECE * (i + 1)) for i in some]
    return Sample(good, tuple(x[c] for c in cut), tuple(sizes[c] for c in cut))


def guessed(sample: Sample, odds: np.ndarray, share: float = MIN_SHARE) -> np.ndarray:
    """Labels of a document's lines from their odds of being content, held to
    what its own label says: in a good document content has at least ``share``
    of the words, in a bad one boilerplate has more than the rest. Lines that
    must change side for that are those nearest to it."""
    sizes = np.concatenate(sample.sizes)
    label, total = (odds >= 0).astype(int), sizes.sum()
    order = np.argsort(-odds if sample.good else odds, kind="stable")
    reached = np.cumsum(sizes[order])
    needed = share * total if sample.good else (1 - share) * total + 1
    n = int(np.searchsorted(reached, needed)) + 1
    label[order[:n]] = sample.good
    return label


def train(samples: list[Sample], turns: int = 2) -> Crf | None:
    """A model from documents' labels alone; which of their lines are
    boilerplate isn't told but found in turns.

    First each line has its document's label, and lines are told apart one by
    one. Then the labels of lines are guessed from the model (:func:`guessed`)
    and the chain is fitted to these. No model without documents of both
    classes.
    """
    samples = [s for s in samples if s.lines]
    if {s.good for s in samples} != {0, 1}:
        return None
    seqs = [x for s in samples for x in s.lines]
    ends = np.cumsum([sum(map(len, s.lines)) for s in samples])
    every, of = np.concatenate(seqs), np.repeat([s.good for s in samples], np.diff(ends, prepend=0))
    # both classes weigh the same, however many lines they have
    weight = np.where(of == 1, 0.5 / max((of == 1).sum(), 1), 0.5 / max((of == 0).sum(), 1))
    lean = np.zeros(N_FEATURES)
    for _ in range(300):
        lean += 2.0 * (every.T @ (weight * (of - 1 / (1 + np.exp(-every @ lean)))) - 1e-4 * lean)
    model = Crf(np.stack([-lean / 2, lean / 2], axis=1), np.zeros((2, 2)), np.zeros(2))
    cuts = np.cumsum([len(x) for x in seqs])[:-1]
    for _ in range(turns):
        scores = every @ model.emit
        odds = np.split(scores[:, 1] - scores[:, 0], ends[:-1])
        labels = np.concatenate([guessed(s, o) for s, o in zip(samples, odds)])
        model = fit(seqs, np.split(labels, cuts))
    return model


def fit(seqs: list[np.ndarray], tags: list[np.ndarray], rounds: int = 100, rate: float = 1.0, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood of the labels ``tags`` by gradient ascent from zero;
    all sequences at once."""
    order = np.argsort([-len(x) for x in seqs], kind="stable")
    seqs, tags = [seqs[i] for i in order], [tags[i] for i in order]
    long, total = len(seqs[0]), sum(map(len, seqs))
    alive = np.array([sum(len(x) > t for x in seqs) for t in range(long)])
    xs = [np.stack([x[t] for x in seqs[: alive[t]]]) for t in range(long)]
    ys = [np.array([y[t] for y in tags[: alive[t]]]) for t in range(long)]
    emit, step, start, eye = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2), np.eye(2)
    for _ in range(rounds):
        scores = [x @ emit for x in xs]
        fwd = [start + scores[0]]
        for t in range(1, long):
            fwd.append(scores[t] + np.logaddexp(fwd[-1][: alive[t], :1] + step[0], fwd[-1][: alive[t], 1:] + step[1]))
        g_emit, g_step = np.zeros_like(emit), np.zeros_like(step)
        bwd = np.zeros((alive[-1], 2))
        for t in range(long - 1, -1, -1):
            if t < long - 1:
                ahead = scores[t + 1] + bwd
                pair = fwd[t][: alive[t + 1], :, None] + step + ahead[:, None, :]
                pair = np.exp(pair - np.logaddexp.reduce(pair.reshape(-1, 4), axis=1)[:, None, None])
                real = eye[ys[t][: alive[t + 1]]][:, :, None] * eye[ys[t + 1]][:, None, :]
                g_step += (real - pair).sum(axis=0)
                back = np.logaddexp.reduce(step[None] + ahead[:, None, :], axis=2)
                bwd = np.concatenate([back, np.zeros((alive[t] - alive[t + 1], 2))])
            p = fwd[t] + bwd
            p = np.exp(p - np.logaddexp(p[:, :1], p[:, 1:]))
            off = eye[ys[t]] - p
            g_emit += xs[t].T @ off
            if t == 0:
                g_start = off.sum(axis=0)
        emit += rate * (g_emit / total - ridge * emit)
        step += rate * (g_step / total - ridge * step)
        start += rate * (g_start / total - ridge * start)
    return Crf(emit, step, start)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> list[Sample]:
    """At most ``per_class`` labelled documents of each class, those with the
    smallest hash of their id; of texts that share an id that with the
    smallest hash. Documents without a word can't be labelled by line and are
    passed over. Conflicting labels of one id: bad wins.

    Features are computed on the executors, so that no text goes to the driver.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_key")).agg(F.min("quality").alias("_good"))
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    there = labels.join(worded.groupBy("_id").agg(F.min("_t").alias("_t")), F.col("_key") == F.col("_id"))
    parts = [there.where(F.col("_good") == good).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for good in (0, 1)]
    picked = parts[0].unionByName(parts[1]).select("_id", "_t", "_good")

    @F.pandas_udf("array<struct<lines:array<int>,sizes:array<long>>>")
    def pieces(texts: pd.Series) -> pd.Series:
        told = (sample_of(t, 0) for t in texts)
        return pd.Series([[{"lines": packed(x), "sizes": n} for x, n in zip(s.lines, s.sizes)] for s in told])

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_t"))).dropDuplicates(["_id"])
    rows = texts.select("_id", "_good", pieces("text").alias("_pieces")).collect()
    rows.sort(key=lambda r: r["_id"])
    found = [Sample(r["_good"], tuple(unpacked(p["lines"]) for p in r["_pieces"]), tuple(np.array(p["sizes"]) for p in r["_pieces"])) for r in rows]
    if {s.good for s in found} != {0, 1}:
        log.warning("labels of both classes are needed to train on; the base rules alone decide")
    return found


def packed(x: np.ndarray) -> np.ndarray:
    """A line's 0/1 features as the bits of one number."""
    return (x.astype(np.int32) << np.arange(N_FEATURES, dtype=np.int32)).sum(axis=1, dtype=np.int32)


def unpacked(codes) -> np.ndarray:
    return (np.asarray(codes, dtype=np.int32)[:, None] >> np.arange(N_FEATURES) & 1).astype(float)


def judged_rows(docs: DataFrame, model: Crf | None, min_share: float = MIN_SHARE) -> DataFrame:
    """``_row`` (struct of all columns of ``docs``, whatever their names) and
    ``_quality``: struct of ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_content_words, kept``.

    No shuffle. A null text has no words and so fails; very long texts are
    labelled whole, in memory linear in their lines; repeated rows each give a
    row; an empty table gives an empty one. Without a model (no labels to
    train one) every line is content and the base rules alone decide.
    """
    judged = _judge(model, min_share)
    return rows_of(docs).withColumn("_quality", judged(F.coalesce(F.col("_row.text"), F.lit(""))))


def judge(docs: DataFrame, model: Crf | None, min_share: float = MIN_SHARE) -> DataFrame:
    """All columns of ``docs`` and ``_quality``, see :func:`judged_rows`. A
    column of ``docs`` that has that name already gives way to the result."""
    found = judged_rows(docs, model, min_share)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "_quality"), "_quality")


def _judge(model: Crf | None, min_share: float):
    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_content_words long, kept boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part:
                base, content = base_rules(text), 0
                if model is None:
                    content = base.n_words
                elif base.n_words:
                    x, sizes = line_features(text)
                    content = int(sizes[model.decode(x) == 1].sum())
                out.append((base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, base.failed, content, not base.failed and content >= min_share * base.n_words))
            yield pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_content_words", "kept"])

    return judged
