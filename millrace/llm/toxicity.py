"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text's words go through it in windows that overlap by half; each word enters
as its own embedding beside the mean of its character n-grams' embeddings. A
document scores as its worst window. Labels are those of whole documents, so the
network learns with a noisy-or over a document's windows: one window is enough
to make a document toxic, and a clean document has none.

It is trained here, in NumPy, on a bounded sample of labelled documents, and
broadcast; every text is scored whole, in Arrow batches.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import rows_of

#: Words of a window; windows start every half of it.
WINDOW = 32
#: Sizes: of a word's own embedding, of its characters', of a hidden state.
WORD_DIM, CHAR_DIM, HIDDEN = 6, 12, 10
#: Character n-grams, with the word's ends marked.
GRAMS = (3, 5)
#: Labelled documents of each class that are learnt from, the most characters
#: taken of each (from a place that its id tells), documents that an input must
#: occur in to have an embedding, and the most embeddings of each kind. Small
#: samples are gone through more often, until so many steps are done.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, LEAST, INPUTS = 600, 1_200, 4_000, 5, 20_000
EPOCHS, STEPS, BATCH, RATE = 6, 400, 24, 0.01
#: Spread of embeddings before training, near zero so that words which tell
#: nothing stay there, and the share of words left out at each step.
SMALL, DROP = 0.02, 0.05
#: Distinct words and words of text that a task holds at a time.
HELD_WORDS, HELD_TEXT = 1 << 18, 1 << 19
#: Windows that go through the network together.
CHUNK = 4096
_WORD = re.compile(r"[^\W_]+")
#: Characters of a text that are split into words at a time.
PIECE = 1 << 20


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


def grams(word: str) -> list[str]:
    marked = f"<{word[:40]}>"
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def starts(n: int) -> np.ndarray:
    """Where the windows of a text of ``n`` words begin: all overlap by half,
    the last ends with the text; a text without words has one, empty."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW)


def _summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by their number ``at``."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        out[own] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Pieces:
    """Known n-grams, looked up for many words at once by their code points.

    A code point takes 21 bits, so three of them are a number: the first three
    of an n-gram are looked up, then the place where they stood with the next
    two, and so on. Numbers are equal where the n-grams are."""

    def __init__(self, known: dict[str, int]):
        self.levels: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        for n in GRAMS:
            own = [g for g in known if len(g) == n]
            if own:
                points = _points("".join(own)).reshape(len(own), n).T
                tables, at = [], points[0]
                for k in range(1, n, 2):
                    tables.append(np.unique(key := self._key(at, points[k : k + 2])))
                    at = np.searchsorted(tables[-1], key)
                number = np.empty(len(own), dtype=np.int64)
                number[at] = [known[g] for g in own]
                self.levels[n] = tables, number

    @staticmethod
    def _key(at: np.ndarray, more: list[np.ndarray] | np.ndarray) -> np.ndarray:
        key = at << 42 | more[0] << 21
        return key | more[1] if len(more) > 1 else key

    def found(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words and the numbers of their known n-grams, by word, then
        by length and place in the word."""
        points = _points("".join([f"<{w[:40]}>" for w in vocabulary]))
        word = np.repeat(np.arange(len(vocabulary)), [min(len(w), 40) + 2 for w in vocabulary])
        words, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, (tables, number) in self.levels.items():
            first = np.flatnonzero(word[: max(0, len(word) - n + 1)] == word[n - 1 :])
            at = points[first]
            for k, table in zip(range(1, n, 2), tables):
                key = self._key(at, [points[first + j] for j in range(k, min(k + 2, n))])
                at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                there = table[at] == key
                first, at = first[there], at[there]
            words.append(word[first])
            numbers.append(number[at])
        at = np.concatenate(words)
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate(numbers)[order]


@dataclass
class Network:
    """Weights by name, and the numbers of known words and n-grams."""

    weights: dict[str, np.ndarray]
    words: dict[str, int]
    grams: dict[str, int]
    share: float
    _pieces: Pieces | None = field(default=None, init=False, repr=False, compare=False)

    # Both directions run as one batch: arrays of states are (2, windows, HIDDEN).

    def inputs(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its number (0: unknown), all its known n-grams one
        after another, and how many it has."""
        own = np.fromiter(map(self.words.get, vocabulary, repeat(0)), np.int64, len(vocabulary))
        if self._pieces is None:
            self._pieces = Pieces(self.grams)
        at, flat = self._pieces.found(vocabulary)
        return own, flat, np.bincount(at, minlength=len(vocabulary))

    def projected(self, own: np.ndarray, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of words, and what both directions' gates take of them."""
        w = self.weights
        chars = np.zeros((len(own), CHAR_DIM), dtype=np.float32)
        if len(flat):
            some = np.flatnonzero(n)
            at = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            chars[some] = np.add.reduceat(w["chars"][flat], at, axis=0) / n[some, None]
        x = np.concatenate([w["words"][own], chars], axis=1)
        return x, np.stack([x @ w["in"][d] + w["gates"][d] for d in (0, 1)])

    def forward(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """A logit per window of word numbers ``ids``; with ``keep`` also what
        the way back needs."""
        w, h = self.weights, np.zeros((2, len(ids), HIDDEN), dtype=np.float32)
        length = ids.shape[1]
        states, steps = np.empty((length, 2, len(ids), HIDDEN), dtype=np.float32), []
        whole = bool(mask.all())
        for t in range(length):
            at = (t, length - 1 - t)
            x = np.stack([gates[d][ids[:, at[d]]] for d in (0, 1)])
            u = h @ w["state"]
            zr = _sigmoid(x[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(x[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = n + z * (h - n)
            if not whole:
                m = np.stack([mask[:, at[d]] for d in (0, 1)])[..., None]
                new = np.where(m, new, h)
            if keep:
                steps.append((h, z, r, n, u[..., 2 * HIDDEN :]))
            h = new
            states[t, 0], states[length - 1 - t, 1] = h[0], h[1]
        both = np.concatenate([states[:, 0], states[:, 1]], axis=2)  # (length, windows, 2 HIDDEN)
        tanh = np.tanh(both @ w["attend"] + w["attend_bias"])
        score = np.where(mask.T, tanh @ w["query"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = (weight[..., None] * both).sum(axis=0)
        logit = pooled @ w["out"] + w["bias"][0]
        return logit, [steps, both, tanh, weight, pooled]

    def backward(self, grad: np.ndarray, kept: list, ids: np.ndarray, mask: np.ndarray, x: np.ndarray, inputs: tuple) -> dict[str, np.ndarray]:
        """Gradients of all weights from those of the logits."""
        w, (steps, both, tanh, weight, pooled) = self.weights, kept
        length = ids.shape[1]
        out = {k: np.zeros_like(v) for k, v in w.items()}
        out["out"], out["bias"] = pooled.T @ grad, grad.sum(keepdims=True)
        d_pooled = grad[:, None] * w["out"]
        d_both = weight[..., None] * d_pooled
        d_weight = (both * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        out["query"] = (tanh * d_score[..., None]).sum(axis=(0, 1))
        d_tanh = d_score[..., None] * w["query"] * (1 - tanh**2)
        out["attend"], out["attend_bias"] = np.einsum("tni,tnj->ij", both, d_tanh, optimize=True), d_tanh.sum(axis=(0, 1))
        d_both = d_both + d_tanh @ w["attend"].T
        told = np.empty((2, length, len(ids), 3 * HIDDEN), dtype=np.float32)
        dh = np.zeros((2, len(ids), HIDDEN), dtype=np.float32)
        for t in reversed(range(length)):
            at = (t, length - 1 - t)
            h, z, r, n, un = steps[t]
            dh = dh + np.stack([d_both[at[0], :, :HIDDEN], d_both[at[1], :, HIDDEN:]])
            m = np.stack([mask[:, at[d]] for d in (0, 1)])[..., None]
            live = dh * m
            dn = live * (1 - z) * (1 - n**2)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=2)
            told[0, at[0]], told[1, at[1]] = np.concatenate([dz, dr, dn], axis=2)
            out["state"] += h.transpose(0, 2, 1) @ du
            dh = dh * ~m + live * z + du @ w["state"].transpose(0, 2, 1)
        own, flat, n = inputs
        d_x = np.zeros_like(x)
        for d in (0, 1):
            d_gates = _summed(told[d].reshape(-1, 3 * HIDDEN), ids.T.reshape(-1), len(x))
            out["in"][d], out["gates"][d] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ w["in"][d].T
        out["words"] = _summed(d_x[:, :WORD_DIM], own, len(w["words"]))
        out["chars"] = _summed(np.repeat(d_x[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, axis=0), flat, len(w["chars"]))
        return out


def fresh(known: list[str], pieces: list[str], share: float, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    init = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
    size = WORD_DIM + CHAR_DIM
    weights = {
        "words": init(len(known) + 1, WORD_DIM, scale=SMALL), "chars": init(max(len(pieces), 1), CHAR_DIM, scale=SMALL), "in": init(2, size, 3 * HIDDEN), "gates": np.zeros((2, 3 * HIDDEN), np.float32), "state": init(2, HIDDEN, 3 * HIDDEN),
        "attend": init(2 * HIDDEN, 2 * HIDDEN), "attend_bias": np.zeros(2 * HIDDEN, np.float32), "query": init(2 * HIDDEN), "out": init(2 * HIDDEN), "bias": np.full(1, -3.0, np.float32),
    }
    weights["words"][0] = 0
    return Network(weights, {w: i for i, w in enumerate(known, 1)}, {g: i for i, g in enumerate(pieces)}, share)


def _windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's word numbers by windows, and where a window has a word."""
    at = starts(len(ids))[:, None] + np.arange(WINDOW)
    mask = at < len(ids)
    return np.where(mask, ids[np.minimum(at, len(ids) - 1)] if len(ids) else 0, 0), mask


def fit(texts: list[str], toxic: list[bool], share: float, seed: int = 7) -> Network:
    """Trains on documents' labels alone: Adam on the noisy-or of each
    document's windows. The same rows in the same order give the same network."""
    split = [words(t) for t in texts]
    often = Counter(w for own in split for w in set(own))
    pieces: Counter = Counter()
    for own in split:
        pieces.update({g for w in set(own) for g in grams(w)})
    most = lambda c: sorted((w for w, n in c.items() if n >= LEAST), key=lambda w: (-c[w], w))[:INPUTS]
    net = fresh(most(often), most(pieces), share, seed)
    vocabulary = sorted(often)
    number = {w: i for i, w in enumerate(vocabulary)}
    own, flat, n = net.inputs(vocabulary)
    offset = np.concatenate([[0], np.cumsum(n)])
    cut = [_windows(np.array([number[w] for w in s], dtype=np.int64)) for s in split]
    label, rng = np.array(toxic, dtype=np.float32), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, STEPS * BATCH // max(1, len(cut)))
    for epoch in range(epochs):
        order = rng.permutation(len(cut))
        rate = RATE * (1 - epoch / epochs) ** 0.5
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            ids, mask = (np.concatenate([cut[d][i] for d in docs]) for i in (0, 1))
            doc = np.repeat(np.arange(len(docs)), [len(cut[d][0]) for d in docs])
            mask = mask & (rng.random(mask.shape) >= DROP)
            used, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(mask.shape)
            some = (own[used], np.concatenate([flat[offset[u] : offset[u + 1]] for u in used]) if len(used) else flat[:0], n[used])
            x, gates = net.projected(*some)
            logit, kept = net.forward(gates, ids, mask, keep=True)
            p = np.clip(_sigmoid(logit), 1e-6, 1 - 1e-6)
            clean = np.exp(np.bincount(doc, weights=np.log1p(-p), minlength=len(docs)))
            any_ = np.maximum(1 - clean, 1e-6)
            y = label[docs]
            grad = np.where(y[doc] == 1, -p * (clean / any_)[doc], p).astype(np.float32) / len(docs)
            found = net.backward(grad, kept, ids, mask, x, some)
            size = np.sqrt(sum(float((g**2).sum()) for g in found.values()))
            step += 1
            for name, g in found.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.99 * square[name] + 0.01 * g**2
                net.weights[name] -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        net.weights["words"][0] = 0
    return net


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Scorer:
    """Scores texts with a network; word projections are kept between texts, up
    to a number of distinct words."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.gates = np.zeros((2, 0, 3 * HIDDEN), dtype=np.float32)

    def ids(self, text: list[str]) -> np.ndarray:
        """Numbers of a text's words; new ones get theirs, their gates follow
        when they are needed."""
        return np.fromiter(map(self.number.__getitem__, text), np.int32, len(text))

    def know(self) -> None:
        new = list(islice(self.number, self.gates.shape[1], None))
        if new:
            self.gates = np.concatenate([self.gates, self.net.projected(*self.net.inputs(new))[1]], axis=1)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text's word numbers the largest logit of its windows."""
        self.know()
        cut = [_windows(t) for t in texts]
        doc = np.repeat(np.arange(len(cut)), [len(c[0]) for c in cut])
        ids, mask = (np.concatenate([c[i] for c in cut]) for i in (0, 1))
        short = np.argsort(~mask.all(axis=1), kind="stable")  # whole windows need no mask
        found = np.empty(len(ids), dtype=np.float32)
        for k in range(0, len(ids), CHUNK):
            own = short[k : k + CHUNK]
            found[own] = self.net.forward(self.gates, ids[own], mask[own])[0]
        out = np.full(len(texts), -np.inf, dtype=np.float32)
        np.maximum.at(out, doc, found)
        return out

    def scores(self, texts: Iterator[str]) -> Iterator[float]:
        """A score from 0 to 1 each; texts without words score as the share of
        toxic documents. Long texts go through in pieces that share a window, so
        that no window of any word is missed."""
        held: list[np.ndarray] = []
        owner: list[int] = []
        n_docs, size = 0, 0

        def done() -> list[float]:
            best = np.full(n_docs, -np.inf, dtype=np.float32)
            if held:
                np.maximum.at(best, np.array(owner), self.logits(held))
            held.clear(), owner.clear()
            if len(self.number) > HELD_WORDS:
                self.clear()
            return [self.net.share if x == -np.inf else float(_sigmoid(np.float64(x))) for x in best]

        for text in texts:
            number = n_docs
            n_docs += 1
            for own in pieces_of(text):
                if own:
                    held.append(self.ids(own))
                    owner.append(number)
                    size += len(own)
            if size > HELD_TEXT:
                yield from done()
                n_docs = size = 0
        yield from done()


def pieces_of(text: str, size: int = PIECE) -> Iterator[list[str]]:
    """The words of a text, in pieces for a very long one. A piece begins with
    the last window of the one before, cut so that windows stay in step."""
    if len(text) <= size:
        yield words(text)
        return
    at, rest = 0, []
    while at < len(text):
        end = at + size
        while end < len(text) and _WORD.match(text[end - 1]) and _WORD.match(text[end]) and end < at + 2 * size:
            end += 1
        rest = rest + words(text[at:end])
        at = end
        if at >= len(text):
            yield rest
        else:
            whole = max(0, len(rest) - WINDOW) // (WINDOW // 2) * (WINDOW // 2)
            if whole:
                yield rest[: whole + WINDOW // 2]
                rest = rest[whole:]


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[bool], float]:
    """Texts and labels to learn from, and the share of toxic labels: of each
    class at most so many labelled documents, those of the lowest hash, and of
    each at most TRAIN_CHARS characters. Both tables are read where ids fit."""
    told = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(told.groupBy("toxic").count().collect())
    chosen = None
    for toxic, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        own = told.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    texts = docs.where("doc_id is not null and text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", F.substring("text", start, F.lit(TRAIN_CHARS)).alias("text"), "toxic")
    rows = sorted(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect())
    n = sum(counts.values())
    return [r["text"] for r in rows], [r["toxic"] == 1 for r in rows], counts.get(1, 0) / n if n else 0.0


def train(sample: tuple[list[str], list[bool], float]) -> Network:
    """A network from :func:`training_sample`. Without documents of both
    classes nothing can be told apart: every text scores the share of toxic
    labels, and a warning says so."""
    texts, toxic, share = sample
    if not any(toxic) or all(toxic):
        warnings.warn("toxicity: no labelled documents of both classes, every text gets their share as its score", stacklevel=2)
        return fresh([], [], share)
    return fit(texts, toxic, share)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def score(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """``docs`` with the struct ``_toxicity`` of ``score`` and ``predicted``.

    Null and empty texts and those without a word get the share of toxic
    labels. Equal texts score alike up to rounding, repeated rows stay, very
    long texts go through whole. Columns of any name stay as they are; an empty
    table gives an empty one. Only ``text`` reaches the network."""
    trained = bool(net.grams or net.words)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for part in parts:
            texts = (t.as_py() or "" for t in part.column("_text"))
            found = list(scorer.scores(texts)) if trained else [net.share] * part.num_rows
            own = pa.StructArray.from_arrays([pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=["score", "predicted"])
            yield pa.RecordBatch.from_arrays([part.column("_row"), own], names=["_row", "_toxicity"])

    rows = rows_of(docs)
    schema = rows.select("_row", F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).alias("_toxicity")).schema
    return rows.select("_row", F.col("_row.text").alias("_text")).mapInArrow(run, schema).select("_row.*", "_toxicity")
