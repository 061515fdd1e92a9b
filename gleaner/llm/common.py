"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most this many rows, and of so many bytes in its texts and lists, may be sent to every executor.
LIGHT_ROWS, LIGHT_BYTES = 1_000_000, 64 << 20
#: A key is hot when it holds more than this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def unit_hash(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the md5 of ``key`` and ``seed``; 48 bits."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(2**48)


def maybe_broadcast(stored: DataFrame) -> DataFrame:
    """``stored`` with a broadcast hint if it is measured to be within ``LIGHT_ROWS`` and ``LIGHT_BYTES``; else it is left to the planner.

    The planner then shuffles, so both ways give the same rows.
    """
    if stored.count() > LIGHT_ROWS:
        return stored
    if wide := [c for c, kind in stored.dtypes if kind in ("string", "binary") or "<" in kind]:
        size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0
        if size > LIGHT_BYTES:
            return stored
    return F.broadcast(stored)


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of pairs of columns."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that are started within; long texts then need less memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_lookup(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of stored ``rows`` with one row per ``key`` of stored ``groups``.

    Groups of more than ``HOT_SHARE`` of ``total`` rows (at most 1000 of them) are looked up by broadcast, so that their
    rows never meet in one task; the others, none of them large, by an ordinary join.
    """
    hot = F.broadcast(groups.where(F.col(count) > total * HOT_SHARE))
    cold = groups.where(F.col(count) <= total * HOT_SHARE)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))
