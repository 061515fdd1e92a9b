"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every source gets a target in words. Whole copies that the target certainly holds are given to every document; the rest is
a sample. Document i has the inclusion probability p_i = min(1, z w_i) for its weight w_i, with z solved so that the sample's
expected words are the rest exactly, and the random rank

    Q_i = (U_i / (1 - U_i)) / (p_i / (1 - p_i))

with U_i uniform from a hash of its id. Certain documents (p = 1) have rank 0 and come first. The documents of smallest rank are
taken until the source's words are reached; as z is exact, the cut lies near Q = 1.

The cut is found without sorting a source: Q / (1 + Q) is divided into 1024 ranges, whose words are summed; the range in which a
source's target falls is divided in the same way once more, and only the part of it with the cut, about a millionth of a source, is
ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import maybe_broadcast, same, text_of, unit_hash, word_count
from gleaner.session import Workspace

RANGES = 1024
#: Weights are whole numbers, so that their sums don't depend on the order of adding.
WEIGHT_SCALE = 10_000


def damped_weight(size: Column) -> Column:
    """Falls with the square root of the length, so that a few very long texts don't make up the sample."""
    return F.greatest(F.floor(WEIGHT_SCALE / F.sqrt(size.cast("double"))), F.lit(1)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with source_no, target: ``share`` of all words, dealt by weight under ceilings.

    Sources stand in code point order, null last, and take ``weights`` in turn. A target stops at ``most`` times its
    source's size; the excess is dealt again by weight until no source is above. Sorted by ceiling over weight, the sources that
    stop come first, so one pass of sums finds the level of the others. One row per source, so this is a small sort.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", F.row_number().over(order))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"w": turn, "ceiling": F.col("source_size") * F.lit(float(most))})
    by = Window.orderBy(F.col("ceiling") / F.col("w"), "source_no")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "at": F.row_number().over(by),
            "left": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
            "w_left": F.sum("w").over(after),
        }
    ).withColumn("level", F.col("left") / F.col("w_left"))
    free = F.when(F.col("ceiling") > F.col("level") * F.col("w"), F.struct("at", "level"))
    rows = rows.withColumn("level", F.min(free).over(everything)["level"])
    target = F.least("ceiling", F.coalesce(F.col("level") * F.col("w"), F.col("ceiling")))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def sampling_scales(words: DataFrame, rests: DataFrame) -> DataFrame:
    """(source_no, scale, certain): the z of each source, and the weight above which its documents are certain.

    ``words`` (source_no, weight, words) holds the words of a source's documents of each weight, ``rests`` (source_no, rest) the words
    that its sample should have. If all weights above w are certain, z = (rest - their words) / (weighted words of the others);
    the heaviest weight that z doesn't lift above 1 is the solution. A row for each weight is all that is ordered.
    """
    heavier = Window.partitionBy("source_no").orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lighter = Window.partitionBy("source_no").orderBy(F.col("weight").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = maybe_broadcast(rests.select(F.col("source_no").alias("no"), "rest"))
    rows = words.where("weight > 0 and words > 0").join(known, F.col("source_no") == F.col("no"))
    left = F.col("rest") - F.coalesce(F.sum("words").over(heavier), F.lit(0))
    scale = left / F.sum(F.col("weight") * F.col("words")).over(lighter)
    rows = rows.select("source_no", "weight", scale.alias("scale")).where("scale * weight <= 1")
    return rows.groupBy("source_no").agg(F.max("weight").alias("certain"), F.max_by("scale", "weight").alias("scale"))


def _divided(rows: DataFrame, place: Column) -> DataFrame:
    """``rows`` with ``range``: the thousandth part of ``place`` (0 to 1) in which a row falls."""
    return rows.withColumn("range", F.least(F.floor(place * RANGES), F.lit(RANGES - 1)).cast("int"))


def _cuts(rows: DataFrame) -> DataFrame:
    """(source_no, cut, before): the range of ``rows`` (source_no, range, size, rest, base) in which a source's rest falls, and the words before it.

    ``base`` says how many words stand before all of the rows.
    """
    sums = rows.groupBy("source_no", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    up_to = F.col("base") + F.sum("words").over(Window.partitionBy("source_no").orderBy("range"))
    sums = sums.withColumn("before", up_to - F.col("words"))
    cut = sums.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    return cut.select("source_no", F.col("range").alias("cut"), "before")


def _judged(rows: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``more``, those of the cut with ``base``): before a source's cut all rows are taken, behind it none.

    A source without a cut takes all of its ranges: their words stay below the rest by rounding alone.
    """
    known = maybe_broadcast(cuts.select(F.col("source_no").alias("no"), "cut", F.col("before").alias("until")))
    rows = rows.join(known, F.col("source_no") == F.col("no"), "left").drop("no")
    cut_at = F.coalesce("cut", F.when(F.col("rest") > 0, F.lit(RANGES)).otherwise(F.lit(-1)))
    near = rows.where(F.col("range") == cut_at).withColumn("base", F.col("until")).drop("cut", "until")
    clear = rows.where(F.col("range").isNull() | (F.col("range") != cut_at))
    more = F.when(F.col("range") < cut_at, 1).otherwise(0)
    return clear.withColumn("more", more).drop("cut", "until", "range", "base"), near


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    weight=damped_weight,
    size: Column | None = None,
) -> DataFrame:
    """One row per row of ``documents`` (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words of the text (null: 0). ``copies`` says how often the mix holds the row, ``taken`` is
    copies times size. Null is a source of its own, after all others. A row without words is never sampled and gets the
    whole copies of its source only. Rows with equal rank (repeated rows) follow the order of doc_id, null first, and size. The
    draw depends on doc_id and ``seed`` alone, so a rerun agrees. An empty table gives an empty result; other columns are
    not read.
    """
    work = Workspace(documents.sparkSession, "mixing")
    words = size if size is not None else word_count(text_of())
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), words.cast("bigint").alias("size"))
    rows = work.write(rows.withColumn("weight", F.when(F.col("size") > 0, weight(F.col("size"))).otherwise(F.lit(0))), "rows")
    words = rows.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    words = work.write(words, "words")
    sums = work.write(words.groupBy("source").agg(F.sum("words").alias("source_size")), "sums")
    sources = source_targets(sums, weights, share, most)
    sources = sources.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = work.write(sources, "sources")
    named = maybe_broadcast(sources.select(F.col("source").alias("s"), "source_no"))
    words = words.join(named, F.col("source").eqNullSafe(F.col("s"))).select("source_no", "weight", "words")
    scales = work.write(sampling_scales(words, sources), "scales")
    sources = work.write(sources.join(scales, "source_no", "left"), "scaled")

    known = maybe_broadcast(sources.withColumnRenamed("source", "s"))
    ranked = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    p = F.when(F.col("weight") > F.col("certain"), F.lit(1.0)).otherwise(F.col("scale") * F.col("weight"))
    u = unit_hash(F.col("doc_id"), seed)
    ranked = ranked.withColumns({"p": F.when(F.col("size") > 0, p), "u": u})
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    ranked = ranked.withColumn("q", F.when(F.col("p") > 0, odds)).drop("u", "p", "certain", "scale").withColumn("base", F.lit(0).cast("bigint"))
    place = F.col("q") / (1 + F.col("q"))
    ranked = _divided(ranked, place)
    clear, near = _judged(ranked, work.write(_cuts(ranked.where("range is not null")), "cuts"))
    near = _divided(near, place * RANGES - F.col("range"))
    within, last = _judged(near, work.write(_cuts(near), "cuts-within"))
    by_rank = Window.partitionBy("source_no").orderBy("q", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("base") + F.coalesce(F.sum("size").over(by_rank), F.lit(0)) + F.col("size") / 2
    last = last.withColumn("more", F.when(reached <= F.col("rest"), 1).otherwise(0)).drop("base", "range")
    clear = clear.unionByName(within).unionByName(last)
    both = clear.withColumn("copies", (F.col("whole") + F.col("more")).cast("bigint"))
    both = both.withColumn("taken", (F.col("copies") * F.col("size")).cast("bigint"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_rows(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of ``documents`` as often as the mix holds them, with the columns they had.

    Rows that agree in doc_id, source and number of words share one decision, the largest that one of them got.
    """
    work = Workspace(documents.sparkSession, "mixed")
    keys = ["doc_id", "source", "size"]
    decided = mix(documents, **parameters).groupBy(*keys).agg(F.max("copies").alias("copies"))
    decided = maybe_broadcast(work.write(decided.where("copies > 0"), "decided"))
    size = parameters.get("size")
    words = word_count(text_of()) if size is None else size
    rows = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words.cast("bigint").alias("size"),
    )
    taken = rows.join(decided, same(rows, decided, [(k, k) for k in keys])).select("row", "copies")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
