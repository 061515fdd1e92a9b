"""Removal of lines that earlier documents hold, by levelled sorted runs of line hashes, with DataFrame functions only.

Documents come in batches of ascending id. A run is a table of line hashes, each with the first document that holds it, dealt
into buckets by hash and sorted within them. No hash stands in two runs. A batch is dealt into the same buckets once. Its hashes
are merged with those of the runs, bucket by bucket, so that the runs themselves are never shuffled: those found are lines of
earlier documents, those not found become a new run of level 0. When a level has ``fan`` runs, they are compacted into one run
of the next level, so a batch meets a number of runs that grows with the logarithm of the number of batches.

Texts move once, and only to the list of places that they lose. Hashes are the first 128 bits of a SHA-256.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import same, spread_lookup, text_of
from gleaner.session import Workspace

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter keys are never dropped.
LEAST_CHARS = 10
#: Batches that a table is dealt into, and runs of a level that are compacted into one.
BATCHES, FAN = 8, 3


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


class LineRuns:
    """The runs by level, stored as bucketed tables below ``work``.

    ``buckets`` is fixed for the life of the runs; it should be the number of shuffle partitions of the jobs that add to them.
    """

    def __init__(self, spark: SparkSession, work: Workspace, buckets: int, fan: int = FAN):
        self.spark, self.work, self.buckets, self.fan = spark, work, buckets, fan
        self.levels: list[list[str]] = [[]]
        self.made: list[str] = []

    def runs(self) -> list[DataFrame]:
        """The live runs (hash, first), largest first."""
        return [self._run(name) for level in reversed(self.levels) for name in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where(~F.col("earlier")).select("hash", "first")

    def _store(self, hashes: DataFrame) -> str:
        """``hashes`` as a table: one file for each bucket, sorted."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = hashes.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", self.work.table_path(name)).saveAsTable(name)
        self.made.append(name)
        return name

    def split(self, batch: DataFrame) -> DataFrame:
        """``batch`` (hash, ...) with ``earlier``: whether a run has the hash. Dealt into buckets once, then merged with each run."""
        found, earlier = batch.repartition(self.buckets, "hash"), F.lit(False)
        for i, run in enumerate(self.runs()):
            found = found.join(run.select("hash", F.lit(True).alias(f"_{i}")).hint("merge"), "hash", "left")
            earlier = earlier | F.col(f"_{i}").isNotNull()
        return found.select(*batch.columns, earlier.alias("earlier"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Stores ``batch`` (hash, first, ...; a row for each hash) and returns it with ``earlier``.

        Its hashes that no run has are a new run of level 0, the same table without the others. Full levels are compacted.
        """
        name = self._store(self.split(batch))
        self.levels[0].append(name)
        level = 0
        while len(self.levels[level]) >= self.fan:
            union = self._run(self.levels[level][0])
            for other in self.levels[level][1:]:
                union = union.unionByName(self._run(other))
            if level + 1 == len(self.levels):
                self.levels.append([])
            compacted = union.withColumn("earlier", F.lit(False)).repartition(self.buckets, "hash")
            self.levels[level + 1].append(self._store(compacted))
            self.levels[level] = []
            level += 1
        return self.spark.table(name)

    def close(self) -> None:
        """Takes the tables' names out of the catalogue; their files stay with the workspace."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bounds(rows: DataFrame, batches: int) -> list[int]:
    """Ids that cut ``rows`` into about equal batches; which ones doesn't change the result."""
    at = F.array(*[F.lit(i / batches) for i in range(1, batches)])
    found = rows.select(F.percentile_approx("doc_id", at, F.lit(1000)).alias("at")).first()["at"] if batches > 1 else None
    return sorted(set(found or ()))


def dropped_places(documents: DataFrame, work: Workspace, batches: int = BATCHES, least: int = LEAST_CHARS, fan: int = FAN) -> DataFrame:
    """(doc_id, row, places): the numbers, from 0, of the lines that each text loses. ``row`` is a hash of the text."""
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select("doc_id", row_hash(F.col("text")).alias("row"), "text")
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least)
    bounds = _bounds(documents.select("doc_id"), batches)
    batch = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        batch = F.when(F.col("doc_id") <= bounds[i], F.lit(i)).otherwise(batch)
    lines = lines.select("doc_id", "row", "place", line_hash(F.col("key")).alias("hash"), batch.alias("batch"))
    path = work.table_path("lines")
    lines.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(lines.schema).parquet(path)

    runs, known = LineRuns(spark, work, buckets, fan), None
    # Null is an id of its own, behind all others.
    several = ~F.min("doc_id").eqNullSafe(F.max("doc_id")) | ((F.count("doc_id") > 0) & (F.count("doc_id") < F.count(F.lit(1))))
    for i in range(len(bounds) + 1):
        own = stored.where(F.col("batch") == i).groupBy("hash")
        judged = runs.add(own.agg(F.min("doc_id").alias("first"), several.alias("several"), F.count(F.lit(1)).alias("lines")))
        # What some document of the batch loses: lines of earlier batches, and those that several of its own documents hold.
        lost = judged.where("earlier or several").select(F.lit(i).alias("batch"), "hash", "first", "earlier", "lines")
        known = lost if known is None else known.unionByName(lost)
    groups = work.write(known.select(F.struct("batch", "hash").alias("key"), "first", "earlier", "lines"), "groups")
    rows = stored.select("doc_id", "row", "place", F.struct("batch", "hash").alias("key"))
    found = spread_lookup(rows, groups, "key", "lines", stored.count())
    loses = F.col("earlier") | (F.col("doc_id").isNull() & F.col("first").isNotNull()) | (F.col("doc_id") > F.col("first"))
    places = found.where(loses).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("place")).alias("places"))
    places = work.write(places, "places")
    runs.close()
    return places


def row_hash(text: Column) -> Column:
    """Tells the texts of one doc_id apart, should there be several."""
    return F.xxhash64(text, F.length(text))


def without_places(lines: Column, places: Column) -> Column:
    """``lines`` without the elements at ``places`` (ascending): the slices between them, so each line is touched once."""

    def cut(both: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(both["places"], lambda p: p + 1))
        ends = F.concat(both["places"], F.array(F.size(both["lines"])))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(both["lines"], s + 1, e - s)))

    return F.transform(F.array(F.struct(lines.alias("lines"), places.alias("places"))), cut)[0]


def dedup_lines(documents: DataFrame, batches: int = BATCHES, least: int = LEAST_CHARS, fan: int = FAN) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_lines, n_dropped, kept.

    A line is what stands between line feeds; a null or empty text is one empty line. Lines with equal keys (``line_key``) of
    ``least`` code points or more stay in the document with the smallest doc_id that holds one, all of them, and go from all
    others. ``kept`` is the rest, joined by line feeds; it is empty if nothing stays. Rows with one doc_id are one document,
    and null is an id of its own that stands behind all others. An empty table gives an empty result; other columns are
    not read. The result doesn't depend on ``batches`` and ``fan``.
    """
    work = Workspace(documents.sparkSession, "line-dedup")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    places = dropped_places(rows, work, batches, least, fan).select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "places")
    each = rows.withColumn("row", row_hash(F.col("text")))
    both = each.join(places, same(each, places, [("doc_id", "of"), ("row", "of_row")]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(without_places(lines, F.col("places")), "\n"))
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("bigint")
    return both.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))
