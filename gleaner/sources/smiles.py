"""Scan of line-notation files: structure, one blank, title (which may hold blanks itself)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_line(line: Column) -> tuple[Column, Column]:
    parts = F.split(line, r"[ \t]+", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def split_smiles(df: DataFrame, column: str = "value") -> DataFrame:
    """Columns smiles and title next to the other columns of ``df``; blank lines left out."""
    others = [c for c in df.columns if c != column]
    line = F.regexp_replace(F.trim(F.col(column)), r"\r$", "")
    smiles, title = split_line(F.col("_line"))
    return (
        df.select(*others, line.alias("_line"))
        .filter(F.col("_line") != "")
        .select(*others, smiles.alias("smiles"), title.alias("title"))
    )


def read_smiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return split_smiles(spark.read.text(path))
