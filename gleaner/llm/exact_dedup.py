"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut into chunks at places that its own characters decide: it is read as short tokens, every three tokens in a row are
hashed, and a place whose hash is the least among its neighbours is a cut. After an insertion the cuts return to step, so texts that
differ in one chunk share the others. Equal chunks get one identifier, and a text becomes the ordered list of its chunks'
identifiers, its recipe. Two texts are equal if and only if their recipes are.

Only texts that may have a copy are cut: those whose length and 64-bit checksum another row has too. That decides nothing by
itself, the recipes do. The texts that are cut move once. Their chunks are merged in the tasks that cut them, and each chunk is
stored once, to verify that an identifier stands for one chunk only; where it doesn't, the chunk itself takes its place. Recipes,
32 characters for a chunk, are all that is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import maybe_broadcast, spread_lookup, text_of
from gleaner.session import Workspace

#: A token ends with a blank, a mark or a digit; in a long stretch without any, with the next vowel or one of some ideographs.
TOKEN = r"[^\s\p{P}\p{N}]{0,15}[\s\p{P}\p{N}]|[^\s\p{P}\p{N}]{16,63}?[aeiouAEIOU一-埿]|[^\s\p{P}\p{N}]{1,64}"
#: One hash of so many may be a cut, and is one if it is the least among so many others of its kind before and behind it.
ONE_OF, NEIGHBOURS = 16, 8


def _bound(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; together they are the text. Empty for an empty text."""

    def of_tokens(t: Column) -> Column:
        hashed = F.transform(t, lambda w, i: F.struct((i + 1).alias("end"), F.xxhash64(w, F.get(t, i - 1), F.get(t, i - 2)).alias("h")))

        def of_marks(m: Column) -> Column:
            def least(x: Column, i: Column) -> Column:
                # Equal hashes cut before the later one only, so a repeated passage isn't cut at each repeat.
                before = [F.coalesce(x["h"] < F.get(m, i - k)["h"], F.lit(True)) for k in range(1, NEIGHBOURS + 1)]
                behind = [F.coalesce(x["h"] <= F.get(m, i + k)["h"], F.lit(True)) for k in range(1, NEIGHBOURS + 1)]
                out = before[0]
                for more in before[1:] + behind:
                    out = out & more
                return out

            def of_ends(ends: Column) -> Column:
                starts = F.concat(F.array(F.lit(0)), ends)
                each = F.zip_with(starts, F.concat(ends, F.array(F.size(t))), lambda s, e: F.array_join(F.slice(t, s + 1, e - s), ""))
                return F.filter(each, lambda c: c != "")

            return _bound(F.transform(F.filter(m, least), lambda x: x["end"]), of_ends)

        return _bound(F.filter(hashed, lambda x: x["h"] % ONE_OF == 0), of_marks)

    return _bound(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of_tokens)


def identifier(chunk: Column) -> Column:
    return F.md5(chunk)


def ambiguous_identifiers(pieces: DataFrame) -> list[str]:
    """Identifiers that stand for more than one chunk of the column ``chunk``: none, unless texts were made for it."""
    store = pieces.groupBy("chunk").agg(F.lit(1).alias("seen"))
    several = store.groupBy(identifier(F.col("chunk")).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    return [row.id for row in several.select("id").collect()]


def recipes(texts: DataFrame, ambiguous: list[str]) -> DataFrame:
    """``texts`` (chunks, ...) with ``recipe`` in place of ``chunks``; an ambiguous identifier is followed by the chunk itself."""
    whole = lambda c: F.when(identifier(c).isin(ambiguous), F.concat(identifier(c), c)).otherwise(identifier(c))
    return texts.withColumn("recipe", F.transform("chunks", whole if ambiguous else identifier)).drop("chunks")


def checksum(text: Column) -> Column:
    """What equal texts have in common; others seldom do."""
    return F.xxhash64(text, F.octet_length(text))


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text; all empty texts are copies of each other. Of equal texts the largest doc_id stays, a null
    doc_id only if there is no other. Repeated rows of one doc_id count as rows, and all of them are kept or dropped
    together. An empty table gives an empty result; other columns are not read.
    """
    work = Workspace(documents.sparkSession, "exact-dedup")
    texts = documents.select(F.col("doc_id").cast("bigint"), text_of().alias("text"))
    texts = texts.withColumns({"sum": checksum(F.col("text")), "text_sha256": F.sha2("text", 256)})
    base = work.write(texts.select("doc_id", "sum", "text_sha256"), "sums")
    counts = work.write(base.groupBy("sum").agg(F.count("*").alias("copies")), "counts")
    alone = base.join(counts.where("copies = 1"), "sum", "left_semi")

    wanted = maybe_broadcast(work.write(counts.where("copies > 1").select(F.col("sum").alias("wanted")), "wanted"))
    suspects = texts.join(wanted, texts["sum"] == wanted["wanted"], "left_semi")
    cut = work.write(suspects.select("doc_id", "text_sha256", chunks(F.col("text")).alias("chunks")), "cut")
    ambiguous = ambiguous_identifiers(cut.select(F.explode("chunks").alias("chunk")))
    lists = recipes(cut, ambiguous).withColumn("key", F.sha2(F.concat_ws(" ", "recipe"), 256))
    lists = work.write(lists, "recipes")

    groups = lists.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = work.write(groups.withColumn("n", F.col("group_size")), "groups")
    found = spread_lookup(lists.withColumnRenamed("recipe", "own"), groups, "key", "n", lists.count()).where("own = recipe")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint")})
    both = found.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(single.drop("sum"))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(columns)
