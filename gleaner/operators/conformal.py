"""Class-conditional inductive conformal prediction on margins.

How strange a row is for a class is its negated margin (class 1) or its margin (class 0). The p-value of class c is
(number of calibration rows of c at least as strange + 1) / (calibration rows of c + 1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.batches import p_values
from gleaner.operators.ordering import count_before

CLASSES = (0, 1)
MAX_CALIBRATION_ROWS = 1_000_000  # calibration tables up to this size are sent to the executors


def strangeness(margin: Column, label: Column) -> Column:
    return F.when(label == 1, -margin).otherwise(margin)


def calibration_table(labelled: DataFrame, margin: Column) -> DataFrame:
    """label, alpha: how strange each calibration row is for its own class."""
    return labelled.select(
        F.col("label").cast("int").alias("label"), strangeness(margin, F.col("label")).alias("alpha")
    )


@dataclass(frozen=True)
class Calibration:
    """A calibration table that was counted, and read if it is small; for use with more than one table of rows."""

    table: DataFrame
    sizes: dict[int, int]
    arrays: dict[int, np.ndarray] | None  # sorted, by class

    @classmethod
    def of(cls, calibration: DataFrame, max_rows: int = MAX_CALIBRATION_ROWS) -> Calibration:
        """Reads ``calibration`` once, under a limit; a larger one is only counted then."""
        alphas = calibration.select(F.col("label").cast("int").alias("label"), F.col("alpha").cast("double").alias("alpha"))
        read = alphas.limit(max_rows + 1).toPandas()
        if len(read) > max_rows:
            return cls(alphas, {row["label"]: row["count"] for row in alphas.groupBy("label").count().collect()}, None)
        arrays = {c: np.sort(read.loc[read["label"] == c, "alpha"].to_numpy(dtype=float)) for c in CLASSES}
        return cls(alphas, {c: len(a) for c, a in arrays.items()}, arrays)


def _by_search(test: DataFrame, margin: str, sorted_alphas: dict[int, np.ndarray]) -> DataFrame:
    """Both p-values by binary search in the sorted calibration arrays, per Arrow batch; no shuffle."""

    @F.arrow_udf("p0 double, p1 double")
    def searched(margins: pa.Array) -> pa.Array:
        return p_values(margins, sorted_alphas)

    return test.withColumn("_p", searched(F.col(margin).cast("double"))).withColumns({c: F.col(f"_p.{c}") for c in ("p0", "p1")}).drop("_p")


def _by_sort(test: DataFrame, margin: str, calibration: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Both p-values by counting calibration rows in one global order per class; for any size of calibration.

    The test rows are carried through the sort, so keys play no part in it.
    """
    unknown = F.col(margin).isNull() | F.isnan(F.col(margin).cast("double"))
    rows = test.filter(~unknown).select(F.struct(*test.columns).alias("_row"))
    for c in CLASSES:
        value = F.col(f"_row.{margin}").cast("double")
        asked = rows.withColumns({"_a": -value if c == 1 else value, "_cal": F.lit(False)})
        points = calibration.filter(F.col("label") == c).select(F.col("alpha").alias("_a"), F.lit(True).alias("_cal"))
        # Strangest first, and calibration rows before equally strange test rows, as "at least as strange" asks.
        order = [F.desc("_a"), F.desc("_cal"), F.xxhash64("_row")]
        counted = count_before(asked.unionByName(points, allowMissingColumns=True), order, F.col("_cal"), "_n")
        p = (F.col("_n") + 1.0) / F.lit(sizes.get(c, 0) + 1.0)
        rows = counted.select(*rows.columns, p.alias(f"p{c}"))
    none = F.lit(None).cast("double")
    return rows.select("_row.*", "p0", "p1").unionByName(test.filter(unknown).withColumns({"p0": none, "p1": none}))


def with_p_values(
    test: DataFrame,
    calibration: DataFrame | Calibration,
    margin: str = "margin",
    max_calibration_rows: int = MAX_CALIBRATION_ROWS,
) -> DataFrame:
    """Adds p0 and p1 to rows with a margin; a null or NaN margin has none. Every row comes back once, whatever its key.

    A ``calibration`` table is read here; one that is used again should be a ``Calibration``.
    """
    known = calibration if isinstance(calibration, Calibration) else Calibration.of(calibration, max_calibration_rows)
    if known.arrays is None:
        return _by_sort(test, margin, known.table, known.sizes)
    return _by_search(test, margin, known.arrays)


def prediction_set(significance: float) -> Column:
    """Array of the classes whose p-value exceeds ``significance``."""
    if not 0.0 <= significance <= 1.0:
        raise ValueError("significance must lie in [0, 1]")
    none = F.lit(None).cast("int")
    return F.array_compact(
        F.array(
            *[F.when(F.col(f"p{c}") > significance, F.lit(c)).otherwise(none) for c in CLASSES]
        )
    )


def with_predictions(df: DataFrame, significance: float) -> DataFrame:
    """Adds pred_set and verdict to rows with p0 and p1."""
    return df.withColumn("pred_set", prediction_set(significance)).withColumn("verdict", verdict(F.col("pred_set")))


def is_only(pred_set: Column, label: int) -> Column:
    return (F.size(pred_set) == 1) & (F.get(pred_set, F.lit(0)) == label)


def verdict(pred_set: Column) -> Column:
    """BAD for {0}, GOOD for {1}, UNKNOWN for both classes or none."""
    return F.when(is_only(pred_set, 0), F.lit("BAD")).when(is_only(pred_set, 1), F.lit("GOOD")).otherwise(F.lit("UNKNOWN"))


def efficiency(predictions: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: singletons, total, and their ratio (NULL without predictions)."""
    w = F.lit(1) if weight is None else weight
    return predictions.agg(
        F.coalesce(F.sum(F.when(F.size("pred_set") == 1, w).otherwise(F.lit(0))), F.lit(0)).cast("bigint").alias("singletons"),
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("total"),
    ).withColumn("efficiency", F.when(F.col("total") > 0, F.col("singletons") / F.col("total")))
