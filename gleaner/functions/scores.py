"""Reading a score out of a record's data items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score tag names, the text that marks a failed score, and the number that stands for it in output.
SCORE_METHODS = ("Chemgauss4", "Chemgauss3", "Shapegauss", "Chemscore", "Hybrid", "Hybrid1", "Hybrid2", "PLP")
FAILED_TEXT = "340282346638528859811704183484516925440.000000"
FAILED_NUMBER = -1.7976931348623157e308


def clean_score(score: Column) -> Column:
    """NaN is a failed score as well."""
    return F.when(~F.isnan(score), score)


def parse_score(tags: Column, method: str) -> Column:
    """Score of ``method``; NULL when absent, empty, not a number, or marked as failed."""
    if method not in SCORE_METHODS:
        raise ValueError(f"unknown score method '{method}'; known: {', '.join(SCORE_METHODS)}")
    text = F.try_element_at(tags, F.lit(method))
    return clean_score(F.when(text != FAILED_TEXT, F.trim(text).try_cast("double")))


def score_or_sentinel(score: Column) -> Column:
    """For output only: the lowest double in place of a failed score."""
    return F.coalesce(score, F.lit(FAILED_NUMBER))
