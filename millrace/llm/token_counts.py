"""Token counts with a whole-token shortcut.

A byte-level BPE model with end-of-word marks splits a text into pre-tokens
and merges each one alone, so a text's count is the sum over its pre-tokens.
:func:`prove` runs the model's merges once over every vocabulary string and
keeps those that encode, alone, as one token. Pre-tokens in that table count
one without any merging; only the rest is merged, and remembered.

The pre-token pattern is applied here with Python's ``regex``. Its classes and
the library's agree on every code point of ``FAST`` (tested exhaustively); a
text with any other character goes to the library whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern in the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which both regex engines and both Unicode tables agree.
FAST = regex.compile(r"[\x00-\x1B\x20-՗ -⁤₠-₿←-⋿぀-ゖァ-ヺ一-鿯가-힣]*+")
#: Entries a worker remembers before it starts afresh.
REMEMBERED = 200_000


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character, by the byte-level rule: printable Latin-1
    bytes stand for themselves, the others take code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def supported(spec: dict) -> bool:
    """Whether the shortcut's reasoning holds for this tokenizer file."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return model["type"] == "BPE" and steps[0].get("pattern") == {"Regex": PRE_TOKEN} and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]


def prove(path: str) -> frozenset[str]:
    """The vocabulary strings that encode alone as exactly one token, as they
    stand in a normalised text."""
    spec = json.load(open(path, encoding="utf-8"))
    if not supported(spec):
        return frozenset()
    model = Tokenizer.from_file(path).model
    end, back = spec["model"]["end_of_word_suffix"] or "", {c: b for b, c in byte_alphabet().items()}
    pattern, proven = regex.compile(PRE_TOKEN), set()
    for entry in spec["model"]["vocab"]:
        body = entry.removesuffix(end)
        if not entry.endswith(end) or not body or any(c not in back for c in body):
            continue
        try:
            text = bytes(back[c] for c in body).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if pattern.findall(text) == [text] and len(model.tokenize(body)) == 1:
            proven.add(text)
    return frozenset(proven)


class Counter:
    """Counts the tokens of whole texts; one per Python worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.shortcut = supported(spec)
        marks = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.whole, self.pattern, self.model = whole, regex.compile(PRE_TOKEN), self.library.model
        self.alphabet = {b: c for b, c in byte_alphabet().items()}
        self.words = Remembered(self._word)
        self.rest = Remembered(self._merge)

    def _merge(self, piece: str) -> int:
        return len(self.model.tokenize("".join(map(self.alphabet.__getitem__, piece.encode()))))

    def _word(self, word: str) -> int:
        return sum(1 if p in self.whole else self.rest[p] for p in self.pattern.findall(word))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.shortcut or not FAST.fullmatch(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts = [text] if self.special is None or "<|" not in text else self.special.split(text)
        total = len(parts) - 1
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            total += sum(map(self.words.__getitem__, part.lower().split()))
        return total


class Remembered(dict):
    """A bounded memo: forgets everything when full."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = n = self.compute(key)
        return n


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    ``path`` is the tokenizer file, readable at the same place on every
    machine. No shuffle; repeated rows each give a row; a null text counts as
    empty; null ids stay null; other columns of ``docs`` are ignored; an empty
    table gives an empty table. Tokenizers whose file does not match the
    shortcut's assumptions are counted by the library alone.
    """
    whole = prove(path)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path, whole)
        for part in parts:
            tokens = [counter.count(t) for t in part["_text"]]
            yield pd.DataFrame({"_id": part["_id"], "n_bytes": part["n_bytes"], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"))
    out = source.mapInPandas(batches, "_id string, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_bytes", "n_tokens", "over_limit")
