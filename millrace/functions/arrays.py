"""Per-sample arrays: tokens, masks, log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """The built-in tokenizer, for tests and demonstrations: white-space words,
    each hashed to an id from 10 to 909."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 900 + 10))


def with_bos(tokens: Column, bos: int | None) -> Column:
    return tokens if bos is None else F.concat(F.array(F.lit(bos)), tokens)


def shifted(values: Column) -> Column:
    """Next-token alignment: without the first position."""
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def target_loss(logprobs: Column, token_mask: Column, sample_mask: Column) -> Column:
    """Mean negative log-probability over unmasked tokens; 0 for padding."""
    mask = F.transform(token_mask, lambda m: m * sample_mask)
    got = total(F.zip_with(logprobs, mask, lambda p, m: F.when(m == 0, 0.0).otherwise(p * m)))
    return F.when(sample_mask == 0, 0.0).otherwise(F.lit(0.0) - got / F.greatest(total(mask), F.lit(1.0)) * sample_mask)


def response_tokens(token_mask: Column, sample_mask: Column) -> Column:
    return total(token_mask) * sample_mask


def pick_spread(files: Column, n: Column) -> Column:
    """``n`` files at even distances from the sorted list."""
    ordered, size = F.array_sort(files), F.size(files)
    some = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(ordered, F.least(size - 1, F.floor(i * (size / n)).cast("int"))))
    return F.when((n <= 0) | (size == 0), F.slice(ordered, 1, 0)).when(n >= size, ordered).otherwise(some)
