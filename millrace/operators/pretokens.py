"""Tokens by a dictionary: each distinct pre-token is merged once.

A byte-pair tokenizer of the ``tokenizers`` library normalizes a text, cuts it
into pre-tokens and merges each by itself. Texts repeat their pre-tokens, so
merging is done for the distinct ones of the corpus and joined back:

1. tasks cut texts; a row tells a document's distinct pre-token and its places;
2. the distinct pre-tokens are merged, each once, and stored;
3. frequent ones are joined by broadcast, all others by a shuffle;
4. a document's entries are gathered again and put in order.

A text that holds one of the tokenizer's added tokens is one entry by itself,
which the library encodes whole, as such strings are found before a text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.shared import drop, store

#: Entries that are joined by broadcast are fewer than this, each of at most
#: so many characters: 40 MB of text and as much of ids at the very most.
HEAD, HEAD_CHARS = 1 << 15, 256
_ENTRY = "entry string, whole boolean, at array<int>"
#: Characters of texts whose entries a worker holds at a time, or one text.
PENDING = 1 << 18


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    if found.pre_tokenizer is None:
        raise ValueError(f"{path} doesn't cut texts into pre-tokens")
    return found


def cut(path: str, text: str) -> list[tuple[str, bool]]:
    """A text's entries in order, and whether one is to be encoded whole."""
    found = _load(path)
    plain = found.normalizer.normalize_str(text) if found.normalizer else text
    if any(t.content in text or t.content in plain for t in found.get_added_tokens_decoder().values()):
        return [(text, True)]
    return [(part, False) for part, _ in found.pre_tokenizer.pre_tokenize_str(plain)]


def merged(path: str, entry: str, whole: bool) -> list[int]:
    """Ids of an entry."""
    found = _load(path)
    return found.encode(entry, add_special_tokens=False).ids if whole else [t.id for t in found.model.tokenize(entry)]


def _entries(path: str, keys: list[str]):
    """Rows of a batch (``keys``, text) as those of their entries, let go
    whenever PENDING characters of texts are cut: what a worker holds doesn't
    grow with the batch."""

    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            key, texts = part.select(keys), part.column("text")
            rows, columns, size = [], ([], [], []), 0
            for row in range(part.num_rows):
                text = texts[row].as_py() or ""
                places: dict[tuple[str, bool], list[int]] = {}
                for i, one in enumerate(cut(path, text)):
                    places.setdefault(one, []).append(i)
                for (entry, whole), at in places.items() or [((None, None), None)]:
                    rows.append(row)
                    for column, value in zip(columns, (entry, whole, at)):
                        column.append(value)
                size += len(text)
                if rows and (size >= PENDING or row == part.num_rows - 1):
                    made = [pa.array(values, kind) for values, kind in zip(columns, (pa.string(), pa.bool_(), pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays([*key.take(pa.array(rows)).columns, *made], names=[*keys, "entry", "whole", "at"])
                    rows, columns, size = [], ([], [], []), 0

    return entries


def _ids(path: str):
    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for entry, whole in parts:
            yield pd.Series([np.asarray(merged(path, e, w), dtype=np.int32) for e, w in zip(entry, whole)], index=entry.index, dtype=object)

    return ids


def dictionary(uses: DataFrame, path: str) -> DataFrame:
    """``entry, whole, n, ids``: the distinct entries, how many rows use one,
    and its ids, each merged once. Counting combines before it shuffles."""
    counted = uses.where("entry is not null").groupBy("entry", "whole").agg(F.count("*").alias("n"))
    return counted.withColumn("ids", _ids(path)(F.col("entry"), F.col("whole")))


def tokens_by_dictionary(docs: DataFrame, path: str, keys: tuple[str, ...] = ("domain", "origin", "part", "doc")) -> DataFrame:
    """``keys, tokens`` of ``docs`` (keys, text), the same tokens as the
    library's own. Keys tell documents apart and may be null; a null or empty
    text has no tokens. Of a tokenizer's file every machine needs a copy.

    An entry is joined by broadcast if it makes up more than a 32,768th of all
    rows, of which there are fewer than 32,768, and is at most 256 characters
    long; so no key of the shuffled join holds more, but for longer entries that
    very many documents share, which adaptive execution splits."""
    _load(path)  # a file that can't be read ends the run here
    asked = docs.select(*keys, "text")
    schema = StructType([*asked.drop("text").schema.fields, *StructType.fromDDL(_ENTRY).fields])
    uses = store(asked.mapInArrow(_entries(path, list(keys)), schema), "entries")
    known = store(dictionary(uses, path), "pretokens")
    total = known.agg(F.sum("n")).first()[0] or 0
    frequent = (F.col("n") * HEAD > total) & (F.length("entry") <= HEAD_CHARS)
    head, tail = known.where(frequent).select("entry", "whole", "ids"), known.where(~frequent).select("entry", "whole", "ids")
    # an entry is in one of the two, so the rows that the broadcast leaves go on to the shuffle
    near = uses.join(F.broadcast(head.withColumnRenamed("ids", "_near")), ["entry", "whole"], "left")
    done = near.where("_near is not null or entry is null").select(*keys, "at", F.col("_near").alias("ids"))
    rest = near.where("_near is null and entry is not null").select(*keys, "at", "entry", "whole").join(tail.hint("merge"), ["entry", "whole"]).select(*keys, "at", "ids")
    gathered = done.unionByName(rest).groupBy(*keys).agg(F.collect_list(F.struct("at", "ids")).alias("_all"))
    placed = F.flatten(F.transform("_all", lambda e: F.transform(F.coalesce(e["at"], F.array().cast("array<int>")), lambda at: F.struct(at.alias("at"), e["ids"].alias("ids")))))
    out = store(gathered.select(*keys, F.flatten(F.transform(F.array_sort(placed), lambda e: e["ids"])).alias("tokens")), "tokens")
    for table in (uses, known):
        drop(table)
    return out
