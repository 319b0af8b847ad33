"""Tokenizers of public libraries as columns, in Arrow batches.

A tokenizer is a file: ``.json`` for the ``tokenizers`` library, ``.model`` for
``sentencepiece``. It must be readable at the same path on every machine; each
worker loads it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def load(path: str) -> tuple[Callable[[list[str]], list[list[int]]], Callable[[list[list[int]]], list[str]]]:
    """Encoder and decoder of batches. No special tokens are added, and special
    strings inside a text are treated as the library does by default; nothing is
    truncated or padded."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=False)], lambda ids: found.decode_batch(ids, skip_special_tokens=False)
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        piece = SentencePieceProcessor(model_file=path)
        return lambda texts: piece.encode(texts, num_threads=1), lambda ids: piece.decode(ids, num_threads=1)
    raise ValueError(f"no tokenizer library is known for {path}")


def tokenizer(path: str) -> Callable[[Column], Column]:
    """Text column to a column of token ids."""
    load(path)  # a file that can't be read ends the run here

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, _ = load(path)
        for part in parts:
            yield pd.Series(encoder(part.fillna("").tolist()), index=part.index)

    return lambda text: encode(text)


def byte_lengths(path: str) -> Callable[[Column], Column]:
    """Token ids column to the UTF-8 length of the decoded text; null where
    the ids can't be decoded."""

    def length(decoder, ids) -> int | None:
        try:
            return len(decoder([[int(i) for i in ids]])[0].encode("utf-8"))
        except Exception:  # a block that can't be decoded has no length
            return None

    @F.pandas_udf("long")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, decoder = load(path)
        for part in parts:
            yield pd.Series([length(decoder, ids) for ids in part], index=part.index, dtype="Int64")

    return lambda ids: lengths(ids)
