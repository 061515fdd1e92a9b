"""Positions in a global order without a window over the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import Workspace, checkpoint

_RANGE_BYTES = 16 << 20
_OUT_ROWS = 50_000
_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def _row_mark() -> Column:
    return F.monotonically_increasing_id()


def _offsets(fixed: DataFrame, condition: Column, partition: Column | None = None) -> DataFrame:
    """First position of every partition of ``fixed`` among its rows that meet ``condition``. One row per partition."""
    counts = (
        fixed.groupBy((F.spark_partition_id() if partition is None else partition).alias("_pid"))
        .agg(F.count_if(condition).alias("n"))
        .orderBy("_pid")
        .collect()
    )
    rows, start = [], 0
    for row in counts:
        rows.append((row["_pid"], start))
        start += row["n"]
    return F.broadcast(fixed.sparkSession.createDataFrame(rows, "_pid int, _start long"))


def with_dense_index(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the given order, which must be total.

    A range-partitioned sort is stored with each row's partition and place, so partitions hold consecutive stretches of the
    order; the index is the place inside the partition plus the rows of the partitions before it. Only one number per
    partition reaches the driver.
    """
    return _numbered(df.orderBy(*order), out)


def _numbered(ordered: DataFrame, out: str, **options: str) -> DataFrame:
    """Adds 0, 1, 2, ... to rows that come in order, partition after partition."""
    marked = ordered.select("*", F.spark_partition_id().alias("_pid"), _row_mark().alias("_mark"))
    fixed = Workspace(ordered.sparkSession, "order").write(marked, "sorted", **options)
    position = F.col("_mark").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        fixed.join(_offsets(fixed, F.lit(True), F.col("_pid")), "_pid")
        .withColumn(out, F.col("_start") + position)
        .drop("_pid", "_start", "_mark")
    )


def _distinct_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that aren't marked as known in any row, each once and in order of their bytes."""
    found = [(b.column(0).cast(pa.large_string()), b.column(1)) for b in batches]
    if not found:
        return
    texts = pc.unique(pa.chunked_array([t.filter(pc.invert(k)) for t, k in found]))
    known = pa.chunked_array([t.filter(k) for t, k in found])
    if len(known):
        texts = texts.filter(pc.invert(pc.is_in(texts, value_set=known)))
    texts = texts.take(pc.sort_indices(texts))
    for at in range(0, len(texts), _OUT_ROWS):
        yield pa.record_batch([texts.slice(at, _OUT_ROWS).cast(pa.string())], ["text"])


def distinct_with_dense_index(df: DataFrame, column: str, out: str, total_bytes: int, known: DataFrame | None = None) -> DataFrame:
    """The distinct texts of ``column``, without those of ``known``, numbered 0, 1, 2, ... in their order.

    One shuffle, by range, brings copies and known texts together; each range, of some _RANGE_BYTES, is sorted by itself. For texts
    without nulls, of which no single one has so many copies that they outgrow a range. ``total_bytes`` of both tables,
    about, gives the number of ranges and nothing else.
    """
    rows = df.select(F.col(column).alias("text"), F.lit(False).alias("known"))
    if known is not None:
        rows = rows.unionByName(known.select(F.col(column).alias("text"), F.lit(True).alias("known")))
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-total_bytes // _RANGE_BYTES))
    texts = rows.repartitionByRange(ranges, "text").mapInArrow(_distinct_sorted, "text string").withColumnRenamed("text", column)
    # Texts that differ throughout gain nothing from a dictionary within the file.
    return _numbered(texts, out, **{"parquet.enable.dictionary": "false"})


def count_before(df: DataFrame, order: list[Column | str], counted: Column, out: str) -> DataFrame:
    """For each row that is not ``counted``: how many ``counted`` rows come before it. Counted rows are left out.

    The position among all rows minus the position among the rows kept; both come from the same sorted checkpoint.
    """
    fixed = checkpoint(df.orderBy(*order))
    all_starts = _offsets(fixed, F.lit(True)).withColumnRenamed("_start", "_all_start")
    kept_starts = _offsets(fixed, ~counted).withColumnRenamed("_start", "_kept_start")
    low_bits = F.lit((1 << _POSITION_BITS) - 1)
    kept = (
        fixed.withColumn("_all", _row_mark())
        .filter(~counted)
        .withColumn("_kept", _row_mark())
        .withColumn("_pid", F.spark_partition_id())
    )
    before = (F.col("_all_start") + F.col("_all").bitwiseAND(low_bits)) - (
        F.col("_kept_start") + F.col("_kept").bitwiseAND(low_bits)
    )
    return (
        kept.join(all_starts, "_pid")
        .join(kept_starts, "_pid")
        .withColumn(out, before)
        .drop("_pid", "_all", "_kept", "_all_start", "_kept_start")
    )
