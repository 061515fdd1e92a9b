"""Sparse vectors as ``struct<size, ids, vals>``: text form, dot product, and the step to the ML vector type."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = r"^\s*\((\d+),\s*\[([^\]]*)\],\s*\[([^\]]*)\]\)\s*$"


def sparse(size: Column, ids: Column, vals: Column) -> Column:
    return F.struct(
        size.cast("bigint").alias("size"),
        ids.cast("array<bigint>").alias("ids"),
        vals.cast("array<double>").alias("vals"),
    )


def from_dense(array: Column) -> Column:
    """The struct form of a dense array, all positions kept."""
    n = F.size(array)
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return sparse(n, ids, array)


def vector_text(features: Column) -> Column:
    """``(size,[ids],[vals])``."""
    return F.concat(
        F.lit("("),
        features["size"].cast("string"),
        F.lit(",["),
        F.array_join(features["ids"].cast("array<string>"), ","),
        F.lit("],["),
        F.array_join(features["vals"].cast("array<string>"), ","),
        F.lit("])"),
    )


def parse_vector(text: Column) -> Column:
    """The struct form of ``(size,[ids],[vals])``; NULL for any other text."""

    def numbers(group: int, item: str) -> Column:
        return F.from_json(F.concat(F.lit("["), F.regexp_extract(text, _TEXT, group), F.lit("]")), f"array<{item}>")

    return F.when(
        text.rlike(_TEXT),
        sparse(F.regexp_extract(text, _TEXT, 1).try_cast("bigint"), numbers(2, "bigint"), numbers(3, "double")),
    )


def dot(features: Column, weights: Column) -> Column:
    """Sum of value times weight, in order of the ids; ids beyond the weights count nothing."""
    products = F.zip_with(
        features["ids"],
        features["vals"],
        lambda i, v: v * F.coalesce(F.get(weights, i.cast("int")), F.lit(0.0)),
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def append_constant(features: Column) -> Column:
    """One more dimension holding 1, so that a learner without intercept has a (penalised) bias."""
    return sparse(
        features["size"] + 1,
        F.array_append(features["ids"], features["size"]),
        F.array_append(features["vals"], F.lit(1.0)),
    )


def to_ml_vector(features: Column) -> Column:
    """ML vector column, of at most 2**31 places. Built through JSON, which keeps the work in the JVM; meant for training rows."""
    body = F.struct(
        F.lit(0).alias("type"),
        features["size"].cast("int").alias("size"),
        features["ids"].cast("array<int>").alias("indices"),
        features["vals"].alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    text = F.when(features.isNotNull(), F.to_json(F.struct(body.alias("v"))))
    return F.from_json(text, schema)["v"]
