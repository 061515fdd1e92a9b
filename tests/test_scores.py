import pytest
from pyspark.sql import functions as F

from gleaner.functions.scores import parse_score, score_or_sentinel

SENTINEL = "340282346638528859811704183484516925440.000000"


def test_every_way_to_fail(spark):
    texts = [("a", "-7.25"), ("b", SENTINEL), ("c", ""), ("d", "NaN"), ("e", "none"), ("f", " 3.5 ")]
    df = spark.createDataFrame(texts, "k string, t string").withColumn("tags", F.create_map(F.lit("PLP"), "t"))
    out = {r.k: r.s for r in df.select("k", parse_score(F.col("tags"), "PLP").alias("s")).collect()}
    assert out == {"a": -7.25, "b": None, "c": None, "d": None, "e": None, "f": 3.5}
    other = df.select(score_or_sentinel(parse_score(F.col("tags"), "Hybrid")).alias("s")).distinct().collect()
    assert [r.s for r in other] == [-1.7976931348623157e308]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        parse_score(F.lit(None), "Other")
