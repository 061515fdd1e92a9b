"""Comparing two hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_overlap(first: DataFrame, second: DataFrame, n: int, id: str = "mol_id") -> DataFrame:
    """One row: pair_matches (every equal pair counts), distinct_matches, and the pairs as a percentage of ``n``.

    Ids are counted on each side first, so no pair is ever produced.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    left = first.groupBy(id).agg(F.count(F.lit(1)).alias("_n1"))
    right = second.groupBy(id).agg(F.count(F.lit(1)).alias("_n2"))
    pairs = F.coalesce(F.sum(F.col("_n1") * F.col("_n2")), F.lit(0))
    return (
        left.join(right, id)
        .agg(pairs.alias("pair_matches"), F.count(F.lit(1)).alias("distinct_matches"))
        .withColumn("percent", F.col("pair_matches") / F.lit(float(n)) * 100.0)
    )
