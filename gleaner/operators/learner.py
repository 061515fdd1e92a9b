"""Linear learners over labelled rows, and the margin they give every candidate.

A model is a table of weights by feature id. Ids that no training row holds have weight 0 under an L2 penalty and a start at 0,
so they are neither fitted nor stored: training re-indexes its rows to the ids that they hold, and the width of the dictionary
plays no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.batches import margins
from gleaner.functions.vectors import append_constant, sparse, to_ml_vector, vector_text
from gleaner.operators.spread_fit import SpreadFit
from gleaner.session import Workspace

WEIGHTS = "sig_id bigint, weight double"
MAX_LIGHT_WEIGHTS = 4_000_000  # weights up to this number, 16 bytes each, are sent to the tasks
_HOT_IDS = 1000
_HOT_SAMPLE = 0.02
_FILLER_KEYS = 4096


@dataclass(frozen=True)
class LinearModel:
    """``weights``: sig_id, weight; ids that it lacks have weight 0, and ids are unique."""

    weights: DataFrame
    intercept: float

    @classmethod
    def dense(cls, spark: SparkSession, weights: list[float], intercept: float) -> LinearModel:
        """The model whose feature i has the i-th weight."""
        return cls.of_arrays(spark, np.arange(len(weights)), np.array(weights, float), intercept)

    @classmethod
    def of_arrays(cls, spark: SparkSession, ids: np.ndarray, weights: np.ndarray, intercept: float) -> LinearModel:
        """Weights of 0 are left out; a model without any other keeps one for an id that no row has, so its table isn't empty."""
        used = weights != 0
        if not used.any():
            ids, weights, used = np.array([-1]), np.zeros(1), np.array([True])
        table = pd.DataFrame({"sig_id": np.asarray(ids)[used], "weight": weights[used]})
        return cls(spark.createDataFrame(table, WEIGHTS), float(intercept))

    @cached_property
    def _light(self) -> pa.Table:
        """The weights in order of their ids, or one more than can be sent to the tasks."""
        return self.weights.limit(MAX_LIGHT_WEIGHTS + 1).toArrow().sort_by("sig_id")

    def with_margin(self, df: DataFrame, features: str = "features", out: str = "margin", max_weights: int = MAX_LIGHT_WEIGHTS) -> DataFrame:
        """Adds w.x + b; null for a null vector.

        Up to ``max_weights`` weights go to the tasks and are looked up by binary search, a batch of rows at once. More
        are joined with the vectors' entries by shuffle.
        """
        if self._light.num_rows > min(max_weights, MAX_LIGHT_WEIGHTS):
            return _shuffled_margin(df, features, out, self.weights, self.intercept)
        ids, weights = (self._light.column(c).to_numpy() for c in ("sig_id", "weight"))
        return df.withColumn(out, _looked_up_margin(ids, weights, self.intercept)(F.col(features)))


def _looked_up_margin(ids: np.ndarray, weights: np.ndarray, intercept: float):
    @F.arrow_udf("double")
    def margin(features: pa.Array) -> pa.Array:
        return margins(features, ids, weights, intercept)

    return margin


def _hot_weights(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """The ids that occur most often in ``entries``, at most ``_HOT_IDS``, with their weights."""
    counts = entries.groupBy("sig_id").count()
    hot = counts.orderBy(F.desc("count"), "sig_id").limit(_HOT_IDS).select("sig_id")
    known = weights.join(F.broadcast(hot), "sig_id", "left_semi").select(F.col("sig_id").alias("_known"), "weight")
    found = hot.join(F.broadcast(known), F.col("sig_id") == F.col("_known"), "left")
    return found.select("sig_id", F.coalesce("weight", F.lit(0.0)).alias("_hot"))


def _shuffled_margin(df: DataFrame, features: str, out: str, weights: DataFrame, intercept: float) -> DataFrame:
    """The margin as a join of entries and weights, for models of any size.

    A margin belongs to a vector, so entries are summed by a digest of the vector and the sum is divided by the number of its
    copies: rows need no key. Frequent ids get their weight by broadcast and travel under filler keys, so that no id,
    however frequent, ends up in one task; products are added up before they are shuffled.
    """
    # Equal vectors are met in every task, and their rows carry nothing but the digest to the sums.
    digest = F.md5(F.concat_ws("\n", F.lit("v"), vector_text(F.col(features))))
    rows = df.withColumn("_vector", F.when(F.col(features).isNotNull(), digest))
    each = F.explode(F.arrays_zip(F.col(f"{features}.ids").alias("sig_id"), F.col(f"{features}.vals").alias("v")))
    # Only the vector's digest and entries go on; which ids count as frequent changes the way, not the result.
    some = df.sample(_HOT_SAMPLE, seed=1).select(each.alias("e")).select("e.sig_id")
    hot = F.broadcast(_hot_weights(some, weights))
    entries = rows.select("_vector", each.alias("e")).select("_vector", F.col("e.sig_id").cast("bigint").alias("sig_id"), "e.v")
    filler = -1 - F.pmod(F.xxhash64("_vector", "sig_id"), F.lit(_FILLER_KEYS))
    marked = entries.join(hot, "sig_id", "left").withColumn("_join", F.when(F.col("_hot").isNull(), F.col("sig_id")).otherwise(filler))
    cold = weights.select(F.col("sig_id").alias("_join"), F.col("weight").alias("_cold"))
    products = marked.join(cold, "_join", "left").select("_vector", (F.col("v") * F.coalesce("_hot", "_cold", F.lit(0.0))).alias("p"))
    sums = products.groupBy("_vector").agg(F.sum("p").alias("_sum"))
    copies = rows.groupBy("_vector").agg(F.count(F.lit(1)).alias("_copies"))
    margins = copies.join(sums, "_vector", "left").select("_vector", (F.coalesce("_sum", F.lit(0.0)) / F.col("_copies") + intercept).alias(out))
    return rows.join(margins, "_vector", "left").select(*df.columns, out)


class Learner(Protocol):
    def fit(self, labelled: DataFrame) -> LinearModel:
        """Model from columns ``label`` (0 or 1) and ``features``; raises ValueError when a class is absent."""


_ROWS_PER_PARTITION = 50_000
_MAX_DENSE_IDS = 4096  # Spark's learners send the driver several gradients for each evaluation of the loss, of a number for each id


def _held_ids(labelled: DataFrame) -> np.ndarray | None:
    """The feature ids of the training rows, ascending; None if there are more than ``_MAX_DENSE_IDS``."""
    found = labelled.select(F.explode("features.ids").alias("sig_id")).distinct().limit(_MAX_DENSE_IDS + 1)
    ids = np.sort(found.toArrow().column("sig_id").to_numpy())
    return ids if len(ids) <= _MAX_DENSE_IDS else None


def _renumbered(ids: np.ndarray):
    @F.arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            offsets = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy())))).astype(np.int32)
            at = np.searchsorted(ids, lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(at))

    return places


def _counted(rows: DataFrame) -> int:
    """How many training rows there are; raises ValueError when a class is absent."""
    counts = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    if not {0.0, 1.0} <= set(counts):
        raise ValueError(f"training needs both classes, got {sorted(counts)}")
    return sum(counts.values())


def _training_table(labelled: DataFrame, ids: np.ndarray, constant: bool) -> DataFrame:
    """ML input over the given ids alone, stored, and in partitions of a size that makes an optimiser step one short job."""
    rows = labelled.filter(F.col("features").isNotNull())
    small = sparse(F.lit(len(ids)), _renumbered(ids)(F.col("features.ids")), F.col("features.vals"))
    rows = Workspace(labelled.sparkSession, "training").write(rows.select(F.col("label").cast("double").alias("label"), small.alias("f")), "rows")
    parts = max(1, _counted(rows) // _ROWS_PER_PARTITION)
    vector = to_ml_vector(append_constant(F.col("f")) if constant else F.col("f"))
    return rows.select("label", vector.alias("x")).repartition(parts).persist()


def _fitted(estimator, labelled: DataFrame, constant: bool, loss: str) -> LinearModel:
    """The estimator's fit; for more ids than ``_MAX_DENSE_IDS``, that of the same risk with weights that stay among the tasks."""
    ids = _held_ids(labelled)
    if ids is None:
        return _spread(SpreadFit(loss, estimator.getMaxIter(), estimator.getRegParam(), estimator.getTol(), estimator.getFitIntercept()), labelled)
    table = _training_table(labelled, ids, constant or not len(ids))
    try:
        model = estimator.fit(table)
    finally:
        table.unpersist()
    weights = model.coefficients.toArray()
    intercept = float(weights[-1]) if constant else float(model.intercept)
    return LinearModel.of_arrays(labelled.sparkSession, ids, weights[: len(ids)], intercept)


def _spread(fit: SpreadFit, labelled: DataFrame) -> LinearModel:
    """A penalised bias stays out, since Spark's learners leave the weight of a column with one value at 0."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col("features").isNotNull()).select(F.col("label").cast("double").alias("label"), "features.ids", "features.vals")
    rows = Workspace(spark, "training").write(rows, "rows")
    n_rows = _counted(rows)
    if rows.filter(F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0)).limit(1).count():
        raise ValueError("labels are 0 or 1")
    size = rows.select(F.explode("ids").alias("id")).agg(F.count(F.lit(1)).alias("entries"), F.approx_count_distinct("id").alias("ids")).first()
    weights, bias = fit.fit(rows, n_rows, size["entries"], size["ids"])
    return LinearModel(weights, bias) if weights.limit(1).count() else LinearModel.of_arrays(spark, np.array([]), np.array([]), bias)


@dataclass(frozen=True)
class LinearSVM:
    """Hinge loss with an L2 penalty. ``bias='penalised'`` learns the bias as the weight of a constant feature."""

    max_iter: int = 50
    reg: float = 0.1
    tol: float = 1e-4
    bias: str = "penalised"

    def fit(self, labelled: DataFrame) -> LinearModel:
        if self.bias not in ("penalised", "free"):
            raise ValueError("bias is 'penalised' or 'free'")
        penalised = self.bias == "penalised"
        svc = LinearSVC(
            featuresCol="x", labelCol="label", maxIter=self.max_iter, regParam=self.reg, tol=self.tol, standardization=False, fitIntercept=not penalised
        )
        return _fitted(svc, labelled, constant=penalised, loss="hinge")


@dataclass(frozen=True)
class Logistic:
    """Logistic loss with an L2 penalty; shows that the loop does not depend on one learner."""

    max_iter: int = 50
    reg: float = 0.1

    def fit(self, labelled: DataFrame) -> LinearModel:
        regression = LogisticRegression(featuresCol="x", labelCol="label", maxIter=self.max_iter, regParam=self.reg, standardization=False)
        return _fitted(regression, labelled, constant=False, loss="logistic")


@dataclass(frozen=True)
class Known:
    """Learns nothing: a model that is there already, for checks and for screens with an older model."""

    model: LinearModel

    def fit(self, labelled: DataFrame) -> LinearModel:
        return self.model
