"""Samples and splits by a hash of the row key: exact, repeatable, and independent of the partitioning.

Rows are ordered by the hash, the key, and a hash of the whole row, so copies of a key and null keys have their place too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import HASH_BITS, hash_rank, hash_unit
from gleaner.session import broadcast_within

BUCKET_ROWS = 50_000  # a range of hashes with more distinct hashes than this is narrowed further
_FAN_OUT_BITS = 12
_MAX_BROADCAST_CLASSES = 100_000


def cut_at(ranks: DataFrame, n: int, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int] | None:
    """(rank, m): the first ``n`` rows by ``_rank`` are those below ``rank`` and ``m`` of those at it. None when there are fewer rows.

    Found by counting rows per range of ranks and narrowing the range in which the n-th lies, until that range, not n, is
    small. Only counts reach the driver, so no task ever holds n rows.
    """
    low, bits, need = 0, HASH_BITS, n
    while True:
        inside = ranks.filter((F.col("_rank") >= low) & (F.col("_rank") < low + (1 << bits)))
        bits = max(0, bits - _FAN_OUT_BITS)
        bucket = F.shiftright(F.col("_rank") - F.lit(low), bits)
        for row in inside.groupBy(bucket.alias("b")).count().orderBy("b").collect():
            if row["count"] >= need:
                low, size = low + (row["b"] << bits), row["count"]
                break
            need -= row["count"]
        else:
            return None
        if bits == 0:
            return low, need
        if size <= bucket_rows:
            inside = ranks.filter((F.col("_rank") >= low) & (F.col("_rank") < low + (1 << bits)))
            for row in inside.groupBy("_rank").count().orderBy("_rank").collect():
                if row["count"] >= need:
                    return row["_rank"], need
                need -= row["count"]


def exact_sample(df: DataFrame, key: str, n: int, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``n`` rows without replacement; all rows when there are fewer. One way for every size."""
    if n <= 0:
        return df.limit(0)
    rank = hash_rank(key, seed)
    cut = cut_at(df.select(rank.alias("_rank")), n, bucket_rows)
    if cut is None:
        return df
    last = df.filter(rank == cut[0])  # rows of one key, but for colliding hashes
    return df.filter(rank < cut[0]).unionAll(last.orderBy(key, F.xxhash64(*df.columns)).limit(cut[1]))


def fraction_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Each row with probability ``fraction``."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    return df if fraction == 1.0 else df.filter(hash_unit(key, seed) < fraction)


def split_side(key: Column | str, calibration: float, seed: int) -> Column:
    """'calibration' with probability ``calibration``, else 'proper'. No shuffle; a row never changes sides."""
    return F.when(hash_unit(key, seed) < calibration, F.lit("calibration")).otherwise(F.lit("proper"))


def with_split(df: DataFrame, key: str, calibration: float, seed: int, out: str = "side") -> DataFrame:
    return df.withColumn(out, split_side(key, calibration, seed))


def with_stratified_split(df: DataFrame, key: str, label: str, calibration: float, seed: int, out: str = "side") -> DataFrame:
    """As ``with_split``, but with ceil(calibration * size) calibration rows in every class, whatever its size.

    All classes at once: rows are counted by class and 4096th of the hashes, and only the 4096th in which a class's last
    calibration row lies is ordered. Null is a class like others.
    """
    place = f"_place_{out}"
    rows = df.withColumn(place, F.shiftright(hash_rank(key, seed), HASH_BITS - _FAN_OUT_BITS))
    counts = rows.groupBy(F.col(label).alias("_label"), F.col(place).alias("_at")).count()
    whole, upto = Window.partitionBy("_label"), Window.partitionBy("_label").orderBy("_at")
    counts = counts.withColumns(
        {
            "_wanted": F.ceil(F.round(F.lit(calibration) * F.sum("count").over(whole), 9)),
            "_before": F.sum("count").over(upto) - F.col("count"),
        }
    )
    cut = counts.filter((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("count") >= F.col("_wanted")))
    cut = broadcast_within(cut.select("_label", "_at", "_wanted", "_before"), _MAX_BROADCAST_CLASSES)
    marked = rows.join(cut, F.col(label).eqNullSafe(F.col("_label")), "left")
    rank = F.row_number().over(Window.partitionBy(label, place).orderBy(hash_rank(key, seed), key, F.xxhash64(*df.columns)))
    near = marked.filter(F.col(place) == F.col("_at")).withColumn("_in", F.col("_before") + rank <= F.col("_wanted"))
    clear = marked.filter(F.coalesce(F.col(place) != F.col("_at"), F.lit(True))).withColumn("_in", F.coalesce(F.col(place) < F.col("_at"), F.lit(False)))
    side = F.when(F.col("_in"), F.lit("calibration")).otherwise(F.lit("proper"))
    return clear.unionByName(near).select(*df.columns, side.alias(out))
