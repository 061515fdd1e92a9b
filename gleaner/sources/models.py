"""Trained models as plain tables: a row per model, its weights by feature id and its calibration rows beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.conformal import with_p_values, with_predictions
from gleaner.operators.learner import LinearModel

MODEL = "target string, code string, version int, intercept double, significance double, universe_size bigint"
WEIGHTS = "target string, code string, version int, sig_id bigint, weight double"
CALIBRATION = "target string, code string, version int, label int, alpha double"


@dataclass(frozen=True)
class StoredModel:
    target: str
    code: str
    version: int
    model: LinearModel
    significance: float
    universe_size: int
    calibration: DataFrame


def _replace(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("target", "code", "version").parquet(path)


def save_model(path: str, stored: StoredModel) -> None:
    """Adds to the tables ``models``, ``weights`` and ``calibration`` below ``path``; the same version again replaces itself.

    The model's row goes last, so a model that can be found is complete. No table has a row that grows with the dictionary.
    """
    ident = [
        F.lit(stored.target).alias("target"),
        F.lit(stored.code).alias("code"),
        F.lit(stored.version).cast("int").alias("version"),
    ]
    rows = stored.calibration.select(*ident, F.col("label").cast("int").alias("label"), F.col("alpha").cast("double").alias("alpha"))
    _replace(rows, f"{path}/calibration")
    weights = stored.model.weights
    _replace(weights.select(*ident, F.col("sig_id").cast("bigint").alias("sig_id"), "weight"), f"{path}/weights")
    model = (stored.target, stored.code, stored.version, stored.model.intercept, stored.significance, stored.universe_size)
    _replace(weights.sparkSession.createDataFrame([model], MODEL).coalesce(1), f"{path}/models")


def load_model(spark: SparkSession, path: str, target: str, code: str, version: int | None = None) -> StoredModel:
    """The given version, by default the highest. Weights and calibration rows stay tables."""
    models = spark.read.schema(MODEL).parquet(f"{path}/models")
    wanted = models.filter((F.col("target") == target) & (F.col("code") == code))
    if version is not None:
        wanted = wanted.filter(F.col("version") == version)
    row = wanted.orderBy(F.desc("version")).first()
    if row is None:
        raise LookupError(f"no model for target '{target}', code '{code}', version {version or 'any'}")

    def own(table: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{path}/{table}")
        return rows.filter((F.col("target") == target) & (F.col("code") == code) & (F.col("version") == row["version"]))

    model = LinearModel(own("weights", WEIGHTS).select("sig_id", "weight"), row["intercept"])
    calibration = own("calibration", CALIBRATION).select("label", "alpha")
    return StoredModel(target, code, row["version"], model, row["significance"], row["universe_size"], calibration)


def predict_with(
    stored: StoredModel, rows: DataFrame, significance: float | None = None
) -> DataFrame:
    """Margin, p-values, prediction set and verdict of new rows (key, features)."""
    eps = stored.significance if significance is None else significance
    return with_predictions(with_p_values(stored.model.with_margin(rows), stored.calibration), eps)
