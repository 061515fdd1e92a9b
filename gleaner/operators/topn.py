"""Ranking operators over pose tables (row_key, mol_id, score). A failed score is NULL and ranks last.

Short lists are cut in every task and once more at the end. For long ones, the n-th score is found first, by counting, so that
what belongs to the list is a filter and no task ever holds the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ordering import with_dense_index
from gleaner.session import Workspace, broadcast_if_light, broadcast_within

# Spark drops rows beyond the rank limit before the shuffle only up to this limit.
GROUP_LIMIT = 1000
SALTED_ABOVE = 16  # best n per id: from so many rows on, ids are salted
_SALTS = 64
MAX_BROADCAST_HITS = 1_000_000
MAX_LISTED = 10_000  # lists up to this length may be gathered in one task
_ACCURACY = 10_000  # relative error of the first look for a score is 1 / _ACCURACY


def _rank_key(score: str, tie: str, ascending: bool) -> Column:
    """Struct whose smallest value is the best pose: scored first, best score, smallest tie-break key."""
    s = F.col(score) if ascending else -F.col(score)
    return F.struct(F.col(score).isNull().alias("failed"), s.alias("s"), F.col(tie).alias("tie"))


def rank_order(score: str = "score", tie: str = "row_key", ascending: bool = False) -> list[Column]:
    by_score = F.asc_nulls_last(score) if ascending else F.desc_nulls_last(score)
    return [by_score, F.asc(tie)]


def best_per_id(
    poses: DataFrame,
    id: str = "mol_id",
    score: str = "score",
    tie: str = "row_key",
    ascending: bool = False,
    drop_failed: bool = False,
) -> DataFrame:
    """Best pose of every id: id, score, tie-break key. Pre-aggregated on the map side."""
    kept = poses.filter(F.col(score).isNotNull()) if drop_failed else poses
    best = kept.groupBy(id).agg(F.min(_rank_key(score, tie, ascending)).alias("_best"))
    value = F.col("_best.s") if ascending else -F.col("_best.s")
    return best.select(id, value.alias(score), F.col("_best.tie").alias(tie))


def top_n(
    poses: DataFrame,
    n: int,
    id: str = "mol_id",
    score: str = "score",
    tie: str = "row_key",
    ascending: bool = False,
    drop_failed: bool = False,
) -> DataFrame:
    """The ``n`` ids with the best scores, one pose each, best first."""
    best = best_per_id(poses, id, score, tie, ascending, drop_failed)
    if n <= MAX_LISTED:
        return best.orderBy(*rank_order(score, tie, ascending)).limit(n)
    return select_best(best, n, score, tie, ascending).orderBy(*rank_order(score, tie, ascending))


def _bracket(goodness: DataFrame, share: float) -> tuple[float, float] | None:
    """(low, high): two values of the column ``_g`` that most likely have the value at ``share`` of the way down between them."""
    margin = 2.0 / _ACCURACY
    at = F.array(F.lit(max(0.0, 1.0 - share - margin)), F.lit(min(1.0, 1.0 - share + margin)))
    found = goodness.agg(F.percentile_approx("_g", at, F.lit(_ACCURACY)).alias("at")).first()["at"]
    return None if found is None else (found[0], found[1])


def select_best(
    rows: DataFrame, n: int, score: str = "score", tie: str = "row_key", ascending: bool = False, bucket_rows: int = MAX_LISTED
) -> DataFrame:
    """The first ``n`` rows in the order of ``rank_order``, whatever ``n`` is; in no particular order themselves.

    A sketch of the scores gives two values with the n-th between them, exact counts say whether that holds and how many
    rows are needed from between; the same is done there until few rows or a single score is left. Of equal scores, the
    smallest ties are found by one sort of these rows, dealt by range. (``score``, ``tie``) should identify a row.
    """
    if n <= 0:
        return rows.limit(0)
    work = Workspace(rows.sparkSession, "best")
    # Higher is better from here on; a zero has one sign only.
    value = F.col(score).cast("double")
    rows = work.write(rows.withColumn("_g", (-value if ascending else value) + F.lit(0.0)), "rows")
    sizes = rows.agg(F.count(F.lit(1)).alias("all"), F.count("_g").alias("scored")).first()
    if n >= sizes["all"]:
        return rows.drop("_g")
    if n >= sizes["scored"]:
        failed = _first_ties(rows.filter(F.col("_g").isNull()), n - sizes["scored"], tie)
        return rows.filter(F.col("_g").isNotNull()).unionByName(failed).drop("_g")
    low, high, above, inside = float("-inf"), float("inf"), 0, sizes["scored"]
    g = F.col("_g")
    within = rows.filter(g.isNotNull())
    while inside > bucket_rows and low < high:
        a, b = _bracket(within.select("_g"), (n - above) / inside)
        counts = within.agg(F.count_if(g > b).alias("over"), F.count_if(g < a).alias("under")).first()
        over, under = counts["over"], counts["under"]
        if above + over >= n:  # the sketch was off: the n-th is above the bracket
            low, inside = b, over
            within = within.filter(g > b)
        elif above + inside - under < n:
            above, high, inside = above + inside - under, a, under
            within = within.filter(g < a)
        elif over or under:
            above, low, high, inside = above + over, a, b, inside - over - under
            within = within.filter((g >= a) & (g <= b))
        else:  # a few frequent scores, which no sketch tells apart: the n-th either is the lowest of them or above it
            over = within.agg(F.count_if(g > a).alias("over")).first()["over"]
            if above + over >= n:
                low, inside = a, over
                within = within.filter(g > a)
            else:
                above, low, high, inside = above + over, a, a, inside - over
                within = within.filter(g == a)
    near = work.write(within, "near")
    top = near.agg(F.max("_g")).first()[0]
    clear = rows.filter(g.isNotNull() & (g > F.lit(top)))
    if inside <= bucket_rows:
        last = near.orderBy(F.desc("_g"), F.asc(tie)).limit(n - above)
    else:
        last = _first_ties(near, n - above, tie)
    return clear.unionByName(last).drop("_g")


def _first_ties(rows: DataFrame, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the smallest ``tie``, through a sort that is dealt by range."""
    return with_dense_index(rows, [tie], "_at").filter(F.col("_at") < n).drop("_at")


def attach_payload(
    hits: DataFrame,
    table: DataFrame,
    key: str = "row_key",
    score: str = "score",
    ascending: bool = False,
    max_hits: int = MAX_BROADCAST_HITS,
) -> DataFrame:
    """Further columns of ``table`` for the hits, one row per hit, best first.

    Copies of a record share its key; one of them is taken. Hits are stored once; up to ``max_hits`` of them are broadcast,
    more are shuffled.
    """
    hits = Workspace(hits.sparkSession, "hits").write(hits, "hits")
    right, _ = broadcast_if_light(hits, max_hits, 1 << 28, F.lit(64))
    extra = [c for c in table.columns if c not in hits.columns]
    found = table.select(key, *extra).join(right, key).dropDuplicates(hits.columns)
    return found.orderBy(*rank_order(score, key, ascending))


def semi_join_top(poses: DataFrame, top: DataFrame, id: str = "mol_id", score: str = "score", max_hits: int = MAX_BROADCAST_HITS) -> DataFrame:
    """All poses that equal one of the top (id, score) pairs; failed scores equal each other.

    Up to ``max_hits`` pairs, which are fetched once and under that limit, are broadcast; more are shuffled.
    """
    pairs = top.select(F.col(id).alias("_id"), F.col(score).alias("_score"))
    right = broadcast_within(pairs, max_hits)
    same = F.col(id).eqNullSafe(F.col("_id")) & F.col(score).eqNullSafe(F.col("_score"))
    return poses.join(right, same, "left_semi")


def collapse(
    poses: DataFrame,
    n: int,
    id: str = "mol_id",
    score: str = "score",
    tie: str = "row_key",
    ascending: bool = False,
) -> DataFrame:
    """The best ``n`` poses of every id, with their ``rank``.

    Up to GROUP_LIMIT Spark cuts each id to n rows per task before the shuffle. That is done in two steps over salted ids
    unless n is small: a frequent id is not ranked by one task alone, and that task gets a number of rows that doesn't
    grow with the number of tasks before it.
    """
    order = rank_order(score, tie, ascending)
    staged = poses
    if n > SALTED_ABOVE:
        salt = F.pmod(F.xxhash64(tie), F.lit(_SALTS))
        within = Window.partitionBy(id, "_salt").orderBy(*order)
        staged = (
            poses.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(within))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    ranked = staged.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def sort_by_score(
    poses: DataFrame, score: str = "score", tie: str = "row_key", ascending: bool = False
) -> DataFrame:
    """Global order, best first. The tie-break key also spreads equal scores over the range partitions."""
    return poses.orderBy(*rank_order(score, tie, ascending))


def first_n(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows; after a sort, the first ``n``."""
    return df.limit(n)
