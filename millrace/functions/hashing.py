"""Stable hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_digits(salt: str, key: Column) -> Column:
    """Eight hex digits of SHA-256 over ``salt:key``; they sort like their number."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, 8)


def hash01(salt: str, key: Column) -> Column:
    """The digits as a number from 0 to 1, both included."""
    return F.conv(hash_digits(salt, key), 16, 10).cast("double") / F.lit(4294967295.0)


def content_hash(origin: Column, token_ids: Column) -> Column:
    """Key of a block: SHA-256 of the compact JSON of origin and token ids, keys sorted."""
    return F.sha2(F.to_json(F.struct(origin.alias("origin"), token_ids.alias("token_ids"))), 256)
