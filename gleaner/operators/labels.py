"""Equal-width score bins and the labels taken from the extreme bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scores import clean_score
from gleaner.session import one_value

N_BINS = 10


def check_bins(bad_bin: int, good_bin: int) -> None:
    if not 0 <= bad_bin <= good_bin <= N_BINS:
        raise ValueError(f"need 0 <= bad_bin <= good_bin <= {N_BINS}")


def score_range(scored: DataFrame, score: str = "score") -> Column:
    """Struct (lo, hi) of the scores as a scalar subquery; failed scores do not count."""
    clean = scored.select(clean_score(F.col(score)).alias("_s"))
    return one_value(clean.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")), F.struct("lo", "hi"))


def edge(span: Column, k: int) -> Column:
    """Edge ``k`` of the bins; the last is the maximum itself."""
    return span["hi"] if k == N_BINS else span["lo"] + (span["hi"] - span["lo"]) * k / N_BINS


def score_bin(score: Column, span: Column) -> Column:
    """Bin 0..9 of a score; the maximum belongs to the last bin. All scores equal: bin 0."""
    width = span["hi"] - span["lo"]
    place = F.floor((score - span["lo"]) / width * N_BINS).cast("int")
    return F.when(width == 0, F.when(score.isNotNull(), F.lit(0))).otherwise(F.least(place, F.lit(N_BINS - 1)))


def score_histogram(scored: DataFrame, score: str = "score") -> DataFrame:
    """bin, low, high, n for all bins; a single bin when all scores are equal; no row without scores."""
    span = score_range(scored, score)
    counts = (
        scored.select(clean_score(F.col(score)).alias("_s"))
        .filter(F.col("_s").isNotNull())
        .withColumn("_span", span)
        .groupBy(score_bin(F.col("_s"), F.col("_span")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = scored.sparkSession.range(N_BINS).select(F.col("id").cast("int").alias("bin")).withColumn("_span", span)
    flat = F.col("_span.hi") == F.col("_span.lo")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k in range(N_BINS):
        low = F.when(F.col("bin") == k, edge(F.col("_span"), k)).otherwise(low)
        high = F.when(F.col("bin") == k, edge(F.col("_span"), k + 1)).otherwise(high)
    high = F.when(flat, F.col("_span.hi")).otherwise(high)
    return (
        bins.filter(F.col("_span.lo").isNotNull() & (~flat | (F.col("bin") == 0)))
        .join(F.broadcast(counts), "bin", "left")  # at most N_BINS rows
        .select("bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def label_extremes(
    scored: DataFrame,
    bad_bin: int,
    good_bin: int,
    score: str = "score",
    edges_from: DataFrame | None = None,
    out: str = "label",
) -> DataFrame:
    """The rows of the lowest bins (label 0) and of the highest (label 1), the rest left out.

    0 when the score is at most edge ``bad_bin``, else 1 when it is at least edge ``good_bin``. The edges come from
    ``edges_from`` (default: ``scored``); scores outside them get no label, nor does anything if all are equal.
    """
    check_bins(bad_bin, good_bin)
    span = F.col("_span")
    s = clean_score(F.col(score))
    label = F.when((s >= edge(span, 0)) & (s <= edge(span, bad_bin)), F.lit(0.0)).when(
        (s >= edge(span, good_bin)) & (s <= edge(span, N_BINS)), F.lit(1.0)
    )
    source = scored if edges_from is None else edges_from
    return (
        scored.withColumn("_span", score_range(source, score))
        .filter(F.col("_span.lo") < F.col("_span.hi"))
        .withColumn(out, label)
        .filter(F.col(out).isNotNull())
        .drop("_span")
    )
