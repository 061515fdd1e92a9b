"""The expensive score as a step from (row_key, ...) to (row_key, score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.records import DELIMITER, set_tag, to_sdf
from gleaner.functions.scores import clean_score
from gleaner.operators.program import Program, started
from gleaner.sources import sdf

Scorer = Callable[[DataFrame], DataFrame]
KEY_ITEM = "gleaner.row_key"  # data item that carries a record's key through a program
ANSWERS, RECORDS = 1000, 100  # answers of a program that are handed on at once


def table_scorer(scores: DataFrame, key: str = "row_key", score: str = "score") -> Scorer:
    """Looks the scores up in a table that has one row per key."""

    def run(batch: DataFrame) -> DataFrame:
        return batch.select(key).join(scores.select(key, score), key)

    return run


def external_scorer(
    command: Sequence[str],
    payload: str,
    key: str = "row_key",
    timeout: float = 3600.0,
) -> Scorer:
    """Runs a program once per task.

    It reads ``key<TAB>payload`` lines and prints ``key<TAB>score`` lines, at any time before it ends. Keys it leaves out or whose
    score is no number have failed. Lines go in and out as the program takes and gives them. A program that ends with another
    status than 0, or does nothing for ``timeout`` seconds, stops the job with the key it was at. It must be present on
    the executors.
    """

    def run(batch: DataFrame) -> DataFrame:
        def score(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lines = ((k, f"{k}\t{p}\n") for pdf in pdfs for k, p in zip(pdf["key"], pdf["payload"]))
            program = started(command, lines, timeout)
            answers = _answers(program) if program else iter(())
            while rows := list(islice(answers, ANSWERS)):
                yield pd.DataFrame(rows, columns=["key", "text"], dtype=object)

        clean = F.regexp_replace(F.col(payload).cast("string"), r"[\t\r\n]", " ")
        asked = batch.select(F.col(key).cast("string").alias("key"), F.coalesce(clean, F.lit("")).alias("payload"))
        answers = asked.mapInPandas(score, "key string, text string")
        return answers.select(
            F.col("key").cast(batch.schema[key].dataType).alias(key),
            clean_score(F.trim("text").try_cast("double")).alias("score"),
        )

    return run


def _answers(program: Program) -> Iterator[tuple[str, str]]:
    for line in program.lines():
        key, _, text = line.rstrip("\r\n").partition("\t")
        if key or text:
            program.answered(key)
            yield key, text


def _records(program: Program) -> Iterator[str]:
    """The records that a program prints, each up to its delimiter line."""
    held: list[str] = []
    key_next = False
    for line in program.lines():
        if key_next:
            program.answered(line.rstrip("\r\n"))
        key_next = line.startswith(">") and f"<{KEY_ITEM}>" in line
        held.append(line)
        if line.rstrip() == DELIMITER:
            yield "".join(held)
            held = []
    if "".join(held).strip():
        yield "".join(held)


def external_records(
    molecules: DataFrame,
    command: Sequence[str],
    method: str,
    key: str = "row_key",
    timeout: float = 3600.0,
    wanted: Sequence[str] = sdf.COLUMNS,
) -> DataFrame:
    """Poses from a program that reads records and writes records: the records it returns, parsed, with ``score``.

    ``wanted`` names the columns that are built of them; ``parse_ok``, ``tags`` and the key are always there.

    ``molecules`` needs ``raw`` and ``tags``. The program runs once per task; it gets whole records, each ended by the delimiter
    line and with the key in a data item, and prints records the same way, with a score item named ``method``. It may leave
    records out or return several for one. The record text that it returned is kept as ``raw``. Records go in and out one by
    one, and a failure names the key of the first record without an answer.
    """

    def pipe(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = ((k, record + "\n") for pdf in pdfs for k, record in zip(pdf["key"], pdf["record"]))
        program = started(command, records, timeout)
        answers = _records(program) if program else iter(())
        while texts := list(islice(answers, RECORDS)):
            yield pd.DataFrame({"text": texts}, dtype=object)

    tagged = set_tag(F.col("tags"), KEY_ITEM, F.col(key).cast("string"))
    asked = molecules.select(F.col(key).cast("string").alias("key"), to_sdf(F.col("raw"), tagged).alias("record"))
    answers = sdf.explode_records(asked.mapInPandas(pipe, "text string"), "text")
    poses = sdf.with_score(sdf.parse_molecules(answers, [*wanted, "parse_ok", "tags"]), method)
    return poses.withColumn(key, F.try_element_at("tags", F.lit(KEY_ITEM)).cast(molecules.schema[key].dataType))


def score_rows_with(scorer: Scorer, batch: DataFrame, key: str = "row_key") -> DataFrame:
    """key, score for every key of ``batch``: the best score returned for it, NULL when none was.

    Keys and answers meet in one aggregation. ``batch`` is read once for each of them, the first time for its key alone.
    """
    asked = batch.select(key, F.lit(None).cast("double").alias("score"))
    answers = scorer(batch).select(key, clean_score(F.col("score")).alias("score"))
    known = asked.unionByName(answers).groupBy(key)
    return known.agg(F.max("score").alias("score"))
