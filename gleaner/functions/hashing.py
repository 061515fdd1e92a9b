"""Hash columns for sampling and splitting: the same row gets the same value in every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPAN = 1 << HASH_BITS  # values of hash_rank lie in [0, HASH_SPAN)


def hash_hex(key: Column | str, seed: int) -> Column:
    """md5 of ``key:seed`` as 32 hex digits; a null key is hashed as one value of its own."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(f":{seed}")))


def hash_rank(key: Column | str, seed: int) -> Column:
    """First 15 hex digits of the hash as a bigint; orders rows as the hex text does."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 15), 16, 10).cast("bigint")


def hash_unit(key: Column | str, seed: int) -> Column:
    """First 8 hex digits of the hash as a double in [0, 1)."""
    digits = F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("double")
    return digits / F.lit(4294967296.0)
