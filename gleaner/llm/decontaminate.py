"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

A document is contaminated by an item when it holds at least 75 % of the item's distinct shingles of five words. The
document may be thousands of times as long, so the Jaccard similarity says nothing and sketches of a fixed size would miss
most items. The sketches therefore depend on the item's size. Items are partitioned by their number of shingles, in powers
of two, and an item is represented by the k smallest of its shingles' hashes (bottom-k MinHash), with k one more than
a quarter of the largest size in its partition. A document that misses a quarter of the shingles at most has one of these k
at least, so the search loses nothing, whatever the document's length. On the document's side only hashes up to the
largest value of any sketch are looked up.

An item of fewer than five words is a single run of its own length, and is looked for among the documents' runs of that length;
only the lengths that items really have are cut.

Each pair found is verified with the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import maybe_broadcast, text_of
from gleaner.session import Workspace

#: Words are runs of letters and digits; case and punctuation don't count.
TOKEN = r"[\p{L}\p{N}]+"
WORDS = 5
PERCENT = 75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _windows(words: Column, n: int, joined, rest) -> Column:
    """``joined(words, i)`` for each start of ``n`` words; a shorter text has ``rest(words)`` as its only element, none if it is empty.

    ``words`` becomes the variable of a function, so it is computed once and not again for each element.
    """

    def windows(w: Column) -> Column:
        count = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(count - n, F.lit(0)))
        return F.when(count >= n, F.transform(starts, lambda i: joined(w, i))).otherwise(F.slice(F.array(rest(w)), F.lit(1), F.least(count, F.lit(1))))

    return F.transform(F.array(words), windows)[0]


def shingles(words: Column, n: int = WORDS) -> Column:
    """The runs of ``n`` words, joined by blanks, repeats included; of a shorter text, the whole."""
    return _windows(words, n, lambda w, i: F.array_join(F.slice(w, i + 1, n), " "), lambda w: F.array_join(w, " "))


def _runs(words: Column, lengths: list[int], joined) -> Column:
    """``joined(words, i, n)`` for every start i of n words, for each n of ``lengths``; none where a text is shorter."""

    def windows(w: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.slice(F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(1)) - 1), F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0)))
            return F.transform(starts, lambda i: joined(w, i, n))

        return F.concat(*[of(n) for n in lengths])

    return F.transform(F.array(words), windows)[0]


def run_hashes(words: Column, lengths: list[int]) -> Column:
    """A 64-bit hash for each run of as many words: equal runs have equal hashes."""
    return _runs(words, lengths, lambda w, i, n: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))


def runs(words: Column, lengths: list[int]) -> Column:
    """The runs of as many words, joined by blanks, repeats included."""
    return _runs(words, lengths, lambda w, i, n: F.array_join(F.slice(w, i + 1, n), " "))


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(hash, item_id, item_shingles): the sketch of every item with ``hashes``, one row per hash.

    The sketch has one hash more than the items of its partition may miss.
    """
    sized = items.withColumn("item_shingles", F.size("hashes").cast("bigint"))
    partition = F.pow(F.lit(2.0), F.floor(F.log2(F.col("item_shingles").cast("double"))) + 1) - 1  # the largest size in it
    k = (F.floor(partition * (100 - percent) / 100) + 1).cast("int")
    sketch = F.slice(F.array_sort("hashes"), F.lit(1), k)
    return sized.where("item_shingles > 0").select(F.explode(sketch).alias("hash"), "item_id", "item_shingles")


def contamination(documents: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs of a document and an item that it contains: doc_id, item_id, shared, item_shingles, containment.

    ``documents`` has doc_id and text, ``items`` item_id and text; no other column is read. A null or empty text, or one
    without letters and digits, contains nothing and is contained in nothing. An item of fewer than ``n`` words is one shingle,
    and every document that holds these words in a row, anywhere, contains it. Rows with one doc_id (null is an id too) are taken together, with the
    largest number of shared shingles; so are rows with one item_id, with the union of their shingles. Documents without a
    contained item don't appear.
    """
    work = Workspace(documents.sparkSession, "decontaminate")
    each = items.select(F.col("item_id").cast("bigint"), F.explode(shingles(tokens(text_of()), n)).alias("s"))
    gathered = each.groupBy("item_id").agg(F.collect_set("s").alias("shingles"))
    # Beyond the last word, get() is null and adds nothing to the hash, so a short item's is that of a run of its length.
    hashed = F.transform("shingles", lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(k)) for k in range(n)]))
    known = work.write(gathered.withColumn("hashes", F.array_distinct(hashed)), "items")
    index = work.write(item_sketches(known, percent), "sketches")
    size = F.size(F.split("s", " "))
    lengths = [n, *sorted(r[0] for r in known.select(F.explode("shingles").alias("s")).where(size < n).select(size).distinct().collect())]

    texts = documents.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    top = index.agg(F.max("hash")).scalar()
    hashes = texts.select("doc_id", run_hashes(tokens(F.col("text")), lengths).alias("hashes"))
    probes = hashes.select("doc_id", F.size("hashes").alias("n"), F.explode("hashes").alias("hash")).where(F.col("hash") <= top)
    enough = F.col("n") * 100 >= F.col("item_shingles") * percent
    found = probes.join(maybe_broadcast(index), "hash").where(enough).select("doc_id", "item_id")
    pairs = work.write(found.distinct(), "pairs")

    ids = maybe_broadcast(work.write(pairs.select("doc_id").distinct(), "ids"))
    near = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    near = near.select("doc_id", F.array_distinct(runs(tokens(F.col("text")), lengths)).alias("own"))
    light = maybe_broadcast(pairs.withColumnRenamed("doc_id", "id"))
    both = near.join(light, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")
    light = maybe_broadcast(known.select(F.col("item_id").alias("id"), "shingles"))
    both = both.join(light, F.col("item_id").eqNullSafe(F.col("id"))).drop("id")
    both = both.select("doc_id", "item_id", F.size(F.array_intersect("own", "shingles")).cast("bigint").alias("shared"), F.size("shingles").cast("bigint").alias("item_shingles"))
    best = both.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("item_shingles").alias("item_shingles"))
    return best.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean_documents(documents: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` whose doc_id contains no item, with the columns they had. Rows of one doc_id share their fate."""
    work = Workspace(documents.sparkSession, "clean")
    hit = contamination(documents, items, n, percent).select(F.col("doc_id").alias("hit_id")).distinct()
    hit = maybe_broadcast(work.write(hit, "hit"))
    return documents.join(hit, documents["doc_id"].cast("bigint").eqNullSafe(hit["hit_id"]), "left_anti")
