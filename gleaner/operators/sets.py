"""Set operators by key: duplicates of surviving rows stay."""

from __future__ import annotations

from pyspark.sql import DataFrame

FEW = 32


def minus(pool: DataFrame, gone: DataFrame, key: str = "row_key") -> DataFrame:
    """Rows of ``pool`` whose key is not in ``gone``. Keys are made distinct first, so a frequent key costs one row."""
    return pool.join(gone.select(key).distinct(), key, "left_anti")


def fill_cores(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """For use before heavy work per row: spreads a table of a few partitions over the cores.

    A few small files are read by as few tasks. With more than ``FEW`` partitions, gigabytes, a shuffle costs more than idle
    cores, and the table is left as it is. Where the rows are light and the work on each is long, ``task_rows`` bounds the
    rows of a task, so that tasks become more and not longer as the table grows; the table should be stored, as it is counted.
    """
    cores, found = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if task_rows:
        wanted = max(cores, -(-df.count() // task_rows))
        return df.repartition(wanted) if found < wanted else df
    return df.repartition(cores) if found < min(cores, FEW) else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even partitions, for use after a selective filter and before expensive work on the rows."""
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
