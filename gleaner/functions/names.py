"""Names taken from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_STEM = r"([^/]+?)(\.[^./]*)?$"


def file_stem(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_extract(path, FILE_STEM, 1)
