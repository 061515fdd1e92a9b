"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group, and a group stays in one shard unless it is larger than a quarter of a shard. The
packing places units one by one, the largest first, each where the dot product of its vector with the residual capacity is
highest. The number of units doesn't grow with the table:

* a group that holds more than 1/4096 of the bytes, tokens or rows is a unit of its own (so there are 12,288 at most);
* one that is larger than a quarter of a shard is cut by doc_id into pieces, as many for each shard;
* all other groups are dealt by hash into 4096 cells, and a cell is a unit.

Only the units' sums reach the driver. Slots are counted within small parts of a unit and shifted by the sums of the parts
before, so no shard is ever gathered.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import text_of, word_count
from gleaner.session import Workspace

CELLS = 4096
#: A group above this part of a shard is cut.
WHOLE = 1 / 4
DIMENSIONS = ["size", "tokens", "n"]
#: How much each dimension counts in the dot product; bytes are the law, the others follow as far as groups allow.
IMPORTANCE = (6.0, 1.0, 1.0)


def place(vectors: np.ndarray, shards: int, importance: tuple[float, ...] = IMPORTANCE) -> np.ndarray:
    """The shard of each unit. ``vectors`` are shares of the totals, one row per unit; ties go to the lower number."""
    out = np.zeros(len(vectors), dtype=np.int64)
    residual = np.full((shards, vectors.shape[1]), 1 / shards)
    weight = np.asarray(importance)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        out[i] = best = int(np.argmax(residual @ (weight * vectors[i])))
        residual[best] -= vectors[i]
    return out


def shard_documents(documents: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text and 8; null is the empty text. The law is ``bytes``: the shards' sizes are near
    equal, as far as single texts allow. Slots run from 0 without a gap in every shard. Repeated rows and null ids are rows
    like others; equal ids in one part of a unit get slots in no particular order. An empty table gives an empty result; other
    columns are not read.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "sharding")
    text = text_of()
    rows = documents.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),  # two texts under one hash would only share a shard
    )
    rows = work.write(rows.withColumn("pick", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7))), "rows")
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n")]
    totals = rows.agg(*sums).first()
    share = F.greatest(*[F.col(d) / float(max(totals[d], 1)) for d in DIMENSIONS])
    large = rows.groupBy("key").agg(*sums).withColumn("share", share).where(F.col("share") > 1 / CELLS).collect()

    plan = []  # (key, pieces of the group, parts of a piece for counting slots)
    for g in large:
        pieces = shards * math.ceil(g["share"] / (shards * WHOLE / shards)) if g["share"] > WHOLE / shards else 1
        plan.append((g["key"], pieces, max(1, math.ceil(g["share"] * CELLS / pieces))))
    known = F.broadcast(spark.createDataFrame(plan, "key bigint, pieces int, parts int"))
    cell = F.pmod(F.col("key"), F.lit(CELLS))
    units = rows.join(known, "key", "left").select(
        *[c for c in rows.columns if c not in ("key", "pick")],
        F.when(F.col("pieces").isNull(), cell).otherwise(F.col("key")).alias("unit"),
        F.coalesce(F.pmod(F.col("pick"), F.col("pieces")), F.lit(-1)).cast("int").alias("piece"),
        F.coalesce(F.pmod(F.shiftrightunsigned("pick", 24), F.col("parts")), F.lit(0)).cast("int").alias("part"),
    )
    name = ["unit", "piece", "part"]
    parts = units.groupBy(*name).agg(*sums).collect()

    by_unit: dict[tuple[int, int], np.ndarray] = {}
    for p in parts:
        by_unit.setdefault((p["unit"], p["piece"]), np.zeros(3))[:] += [p[d] for d in DIMENSIONS]
    order = sorted(by_unit)
    vectors = np.array([by_unit[u] for u in order]).reshape(len(order), 3) / np.maximum([totals[d] for d in DIMENSIONS], 1)
    shard_of = dict(zip(order, place(vectors, shards).tolist()))
    filled, table = [0] * shards, []
    for p in sorted(parts, key=lambda p: (p["unit"], p["piece"], p["part"])):
        shard = shard_of[p["unit"], p["piece"]]
        table.append((p["unit"], p["piece"], p["part"], shard, filled[shard]))
        filled[shard] += p["n"]
    placed = F.broadcast(spark.createDataFrame(table, "unit bigint, piece int, part int, shard int, before bigint"))
    within = F.row_number().over(Window.partitionBy(*name).orderBy("doc_id"))
    return units.join(placed, name).select(
        "doc_id",
        "size",
        "tokens",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + within - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
