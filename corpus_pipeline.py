"""A corpus in five steps: toxic documents go, one of each group of near copies stays, documents with benchmark passages go,
sources are mixed to their target weights, and what is left is packed into shards.

Each stage takes (spark, docs, folder of the other tables) and works on all that the stage before kept. Every stage but the
last returns the columns of ``docs``; the last one returns the shard and slot of each row. What a stage does with nulls,
empty texts, repeated rows and empty tables is said where its operator is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.decontaminate import clean_documents
from gleaner.llm.mixing import mixed_rows
from gleaner.llm.ngram_join import one_of_each
from gleaner.llm.sharding import shard_documents
from gleaner.llm.toxicity import without_toxic
from gleaner.session import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted to be toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links by shingles connect."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix holds them."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and a greedy packing have no SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
