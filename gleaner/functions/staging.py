"""Columns that are computed exactly once.

Catalyst pushes a filter on a derived column below the projection that derives it, by putting the column's expression in
the filter, and ``explode`` adds such a filter of its own. For a cheap expression that is a gain; for parsing a record
or building signatures it means doing the work again in every filter, and for chains of such columns the expression
grows with every step. Output of a generator is not pushed, so these helpers pass expensive columns through one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further (or replaced) columns, through a generator that yields one row per row."""
    keep = [c for c in df.columns if c not in columns]
    body = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(body)))


def explode_once(df: DataFrame, keep: list[str], array: Column | str, out: str) -> DataFrame:
    """One row per element of ``array``; rows without elements vanish."""
    return df.select(*keep, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())
