"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, never taken for clean. Linear numpy classifiers
minimise the positive-unlabelled risk, in which the class prior turns the unlabelled loss into that of the negatives. Where
that estimate falls below zero, which no true risk can, a step is taken against it instead of along it.

The inputs are hashed words and beginnings of words. For each of 2 ** 20 hash values the documents and the positives that have it
are counted, over all text; those that positives have significantly more often become inputs, however many they are. The risk's
gradient is summed over every document outside the held-out fold, in the tasks that hold them: a step is one pass over short
lists of inputs, and only its sums reach the driver. There is no sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import arrow_batches, maybe_broadcast
from gleaner.llm.quality import fold
from gleaner.llm.sums import few_tasks, for_passes, summed
from gleaner.llm.textbytes import Texts, slices, span_hashes
from gleaner.session import Workspace

#: Beginnings of words, in bytes, that count besides whole words.
BEGINNINGS = (4, 5, 6)
#: Hash values of pieces, and how many of them are added up in one place.
BUCKETS, RANGE = 1 << 20, 1 << 14
#: Twice the log-likelihood ratio from which on positives have a piece significantly more often than all text.
SIGNIFICANT = 10.0
#: Classifiers, each of which leaves another share of the documents out, and the steps of their fit.
CLASSIFIERS, STEPS, RATE, DECAY = 3, 40, 0.02, 1e-4
#: A fit ends early when no classifier's step is longer; how far the positives lie above all text where it begins.
LEAST_RATE, SPREAD = 1e-4, 5.0
#: The class prior where labels don't tell it, as no label says that a document isn't toxic.
PRIOR = 0.1
#: Rows with whole texts that go to Python at once.
TEXT_ROWS = 1000
#: Documents whose inputs are packed into one row for the passes, and such rows that go to Python at once.
PACK_ROWS, BATCH_BLOCKS = 1_000, 4


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, times) of the words and beginnings of words of each text, and each text's number of words.

    Words are runs of letters, lower-cased as far as Latin-1.
    """
    data = texts.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.concatenate(([False], data[:-1] == 0xC3))
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    starts, ends, text = texts.spans(((data >= 97) & (data <= 122)) | (data >= 128))
    sums = texts.prefix_sums(data)
    hashes, owners = [span_hashes(sums, starts, ends)], [text]
    for n in BEGINNINGS:
        long = ends - starts > n
        hashes.append(span_hashes(sums, starts[long], starts[long] + n) + np.uint64(n))  # a beginning isn't the word
        owners.append(text[long])
    key = np.concatenate(owners).astype(np.int64) * BUCKETS + (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    return key % BUCKETS, key // BUCKETS, times, np.bincount(text, minlength=len(texts))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and positives by bucket, a row of counts for each range of buckets."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        for texts in slices(batch.column("text")):
            bucket, owner, _, _ = pieces(texts)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[positive[texts.first + owner]], minlength=BUCKETS)
    ranges = [(i, counts[:, i * RANGE : (i + 1) * RANGE]) for i in range(BUCKETS // RANGE)]
    ranges = [(i, c) for i, c in ranges if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ranges], pa.int32()), pa.array([c.tobytes() for _, c in ranges], pa.binary())], ["part", "counts"])


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b.as_buffer(), np.int64) for b in table.column("counts")], axis=0)
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """(documents, positives) that have each bucket, over all of ``rows`` (text, positive)."""
    schema = "part int, counts binary"
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in rows.select("text", "positive").mapInArrow(_count_task, schema).groupBy("part").applyInArrow(_add_counts, schema).collect():
        counts[:, r["part"] * RANGE : (r["part"] + 1) * RANGE] = np.frombuffer(r["counts"], np.int64).reshape(2, RANGE)
    return counts


def chosen_inputs(counts: np.ndarray, documents: int, positives: int) -> np.ndarray:
    """The buckets that positives have significantly more often than all documents, in order."""
    expected = (counts[0] + 1) / (documents + 1) * positives
    seen = counts[1]
    ratio = 2 * (seen * np.log(np.maximum(seen, 1) / expected) - (seen - expected))
    return np.flatnonzero((seen > expected) & (ratio >= SIGNIFICANT))


def _input_task(chosen: np.ndarray):
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                bucket, owner, times, words = pieces(texts)
                at = np.minimum(np.searchsorted(chosen, bucket), max(len(chosen) - 1, 0))
                hit = chosen[at] == bucket if len(chosen) else np.zeros(len(bucket), bool)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[hit], minlength=len(texts))))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[hit].astype(np.int32))) for v in (at, times)]
                kept = [batch.column(c).slice(texts.first, len(texts)) for c in ("doc_id", "positive")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int64()), *lists], ["doc_id", "positive", "words", "x", "times"])

    return inputs


class Inputs(NamedTuple):
    """Rows of a sparse matrix: ``at`` and ``value`` of the entries of each row, from ``first[i]`` to ``first[i + 1]``.

    An entry grows with how often a text has the piece, and falls with its length: what is common in long texts by chance tells less. The last two columns are the logarithm of the number of words, and one; every row has them.
    """

    first: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        """The product with ``w``, a column for each classifier."""
        return np.add.reduceat(self.value[:, None] * w[self.at], self.first[:-1], axis=0) if len(self) else np.zeros((0, w.shape[1]))

    def transposed_times(self, c: np.ndarray, width: int) -> np.ndarray:
        """The product of the transposed matrix with the column ``c``."""
        return np.bincount(self.at, self.value * np.repeat(c, np.diff(self.first)), width)

    def rows(self, which: np.ndarray) -> Inputs:
        """The given rows alone."""
        lengths = np.diff(self.first)[which]
        first = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.first[:-1][which] - first[:-1], lengths) + np.arange(first[-1])
        return Inputs(first, self.at[at], self.value[at])


def read_inputs(batch: pa.RecordBatch, inputs: int) -> Inputs:
    lists, times = batch.column("x"), batch.column("times")
    lengths = np.diff(lists.offsets.to_numpy())
    first = np.concatenate(([0], np.cumsum(lengths + 2)))
    at, value = np.empty(first[-1], np.int64), np.empty(first[-1])
    own = np.ones(first[-1], bool)
    own[first[1:] - 1] = own[first[1:] - 2] = False
    words = batch.column("words").to_numpy()
    at[own] = lists.flatten().to_numpy(zero_copy_only=False)
    value[own] = np.log1p(10 * times.flatten().to_numpy(zero_copy_only=False) / np.sqrt(np.repeat(np.maximum(words, 1), lengths)))
    at[first[1:] - 2], value[first[1:] - 2] = inputs, np.log1p(words) / 10
    at[first[1:] - 1], value[first[1:] - 1] = inputs + 1, 1.0
    return Inputs(first, at, value)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk_sums(x: Inputs, w: np.ndarray, unlabelled: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """For each classifier (a column of ``w`` and of the 0/1 weights of rows): the sums that ``risk_gradient`` needs, as one array.

    Under the sigmoid loss a positive costs 1 - s and a negative s; both have the slope s (1 - s).
    """
    s = sigmoid(x.times(w))
    marked = np.flatnonzero(positive.any(axis=1))  # a few of all rows
    kinds = ((x, s, unlabelled), (x.rows(marked), s[marked], positive[marked]))
    out = []
    for k in range(w.shape[1]):
        for part, sk, rows in ((part, s[:, k], rows[:, k]) for part, s, rows in kinds):
            out += [[rows.sum(), (rows * sk).sum()], part.transposed_times(rows * sk * (1 - sk), len(w))]
    return np.concatenate(out)


def risk_gradient(sums: np.ndarray, prior: float) -> np.ndarray:
    """The direction of a step: of the positive-unlabelled risk where its negative part is positive, else against that part."""
    (n_u, s_u, *d_u), (n_p, s_p, *d_p) = sums.reshape(2, -1)
    d_u, d_p = np.array(d_u) / max(n_u, 1), np.array(d_p) / max(n_p, 1)
    negative = s_u / max(n_u, 1) - prior * s_p / max(n_p, 1)
    return d_u - 2 * prior * d_p if negative >= 0 else prior * d_p - d_u


def placed(start: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``start`` scaled so that positives lie ``SPREAD`` above all text on average, zero halfway, and the mean of each input.

    ``sums`` are those at weights of zero, where every slope is a quarter. Without this a sum over thousands of inputs would begin,
    or land after one step, where the sigmoid is flat.
    """
    unlabelled, positive = (4 * s[2:] / max(s[0], 1) for s in sums.reshape(start.shape[1], 2, -1).sum(axis=0))
    w = start.copy()
    gap = (positive - unlabelled)[:-1] @ w[:-1]
    with_gap = gap > 0
    w[:-1, with_gap] *= SPREAD / gap[with_gap]
    w[-1, with_gap] = -((unlabelled + positive)[:-1] / 2 @ w[:-1, with_gap])
    return w, unlabelled


def train(total, start: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights, a column for each classifier. ``total(w)`` is the sum of ``risk_sums`` over all rows; Adam over whole passes.

    Inputs are taken about their mean, so that a step changes what tells rows apart and not all scores at once. A step that
    doesn't lower a classifier's risk is taken back and its rate falls to a third; the others raise theirs by a fifth.
    """
    best, mean = placed(start, total(np.zeros_like(start)))
    w = best.copy()
    m, v, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    rate, t, least = np.full(w.shape[1], RATE), np.zeros(w.shape[1]), np.full(w.shape[1], np.inf)
    for _ in range(steps):
        for k, s in enumerate(total(w).reshape(w.shape[1], -1)):
            (n_u, s_u), (n_p, s_p) = s.reshape(2, -1)[:, :2]
            risk = prior * (1 - s_p / max(n_p, 1)) + max(0.0, s_u / max(n_u, 1) - prior * s_p / max(n_p, 1))
            if risk < least[k]:
                best[:, k], least[k] = w[:, k], risk
                step[:, k] = risk_gradient(s, prior)
                step[:-1, k] += DECAY * w[:-1, k] - step[-1, k] * mean[:-1]
                rate[k] *= 1.2
            else:  # again from the best, along its own gradient alone
                m[:, k], v[:, k], t[k] = 0, 0, 0
                rate[k] /= 3
        t += 1
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        change = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        change[-1] -= mean[:-1] @ change[:-1]
        w = best - change
        if (rate < LEAST_RATE).all():
            break
    return best


def start_weights(counts: np.ndarray, chosen: np.ndarray, documents: int, positives: int, prior: float = PRIOR) -> np.ndarray:
    """Where the fit begins: the square of the log ratio of how often positives and the others have each input.

    How often the others have it follows from the prior, and is at least the error of that estimate. The square keeps the many
    inputs that positives have a little more often, and that go together, from outweighing those that mark them.
    """
    seen, every = (counts[1][chosen] + 0.5) / (positives + 1), (counts[0][chosen] + 0.5) / (documents + 1)
    others = np.maximum(every - prior * seen, prior * np.sqrt(counts[1][chosen] + 1) / max(positives, 1)) / (1 - prior)
    return np.concatenate((np.maximum(np.log(seen / others), 0) ** 2, [0.0, -1.0]))


def _pack_task(width: int):
    """The rows of inputs as a few arrays each, so that a pass reads no lists."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = read_inputs(batch, width)
                bag = batch.column("bag").to_numpy().astype(np.int8)
                positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int8)
                arrays = (np.diff(x.first).astype(np.int32), x.at.astype(np.int32), x.value.astype(np.float32), bag, positive)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], PACKED)

    return pack


PACKED = ["lengths", "at", "value", "bag", "positive"]


def _total(inputs: DataFrame, work: Workspace, width: int, held: int, folds: int):
    """The sum of ``risk_sums`` over all stored rows outside the fold ``held``, as a function of the weights."""
    learn = inputs.withColumn("bag", F.pmod(F.xxhash64("doc_id"), F.lit(CLASSIFIERS)).cast("int")).where(fold(F.col("doc_id"), folds) != held)
    with arrow_batches(inputs.sparkSession, PACK_ROWS):
        packed = for_passes(learn).mapInArrow(_pack_task(width), ", ".join(f"{c} binary" for c in PACKED))
        packed = for_passes(work.write(packed, "packed"))
    direct = few_tasks(packed)

    def total(w: np.ndarray) -> np.ndarray:
        size = 2 * (len(w) + 2) * CLASSIFIERS

        def add(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(size)
            for row in zip(*(batch.column(c) for c in PACKED)):
                lengths, at, value, bag, positive = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int32, np.int32, np.float32, np.int8, np.int8)))
                x = Inputs(np.concatenate(([0], np.cumsum(lengths))), at, value.astype(float))
                bags = bag[:, None] != np.arange(CLASSIFIERS)
                out += risk_sums(x, w, bags.astype(float), (bags & (positive[:, None] == 1)).astype(float))
            return out

        return summed(packed, size, add, BATCH_BLOCKS, direct)

    return total


def _score_task(weights: np.ndarray | None, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows) if weights is None else sigmoid(read_inputs(batch, width).times(weights)).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return score


def toxicity_scores(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, prior: float | None = None) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic; only rows outside the fold ``held`` are used, those of 1 as positives. ``prior`` is the class prior,
    between 0 and 1; by default the share of 1 among those labels, ``PRIOR`` if none of them is 0. A null or empty text
    has no words and gets the score of the constant alone. Equal texts get equal scores. Without a confirmed toxic document
    every score is 0; a single one is enough to learn from. A null id is not held out and never learnt from. An empty table
    gives an empty result; other columns are not read.
    """
    with arrow_batches(documents.sparkSession, TEXT_ROWS):
        return _toxicity_scores(documents, labels, folds, held, prior)


def _toxicity_scores(documents: DataFrame, labels: DataFrame, folds: int, held: int, prior: float | None) -> DataFrame:
    work = Workspace(documents.sparkSession, "toxicity")
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    usable = labels.where(fold(F.col("doc_id"), folds) != held).select(F.col("doc_id").cast("bigint"), F.col("toxic").alias("label"))
    usable = work.write(usable.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    shares = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    if prior is None:
        prior = shares.p / shares.n if shares.p < shares.n else PRIOR
    confirmed = maybe_broadcast(work.write(usable.where("label = 1").select(F.col("doc_id").alias("confirmed")), "confirmed"))
    rows = rows.join(confirmed, F.col("doc_id") == F.col("confirmed"), "left").select("doc_id", "text", F.col("confirmed").isNotNull().alias("positive"))

    chosen, counts, n = np.zeros(0, np.int64), np.zeros((2, BUCKETS), np.int64), None
    if shares.p:
        counts = bucket_counts(rows)
        n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("positive").cast("int")), F.lit(0)).alias("p")).first()
        chosen = chosen_inputs(counts, n.n, n.p)
    inputs = rows.mapInArrow(_input_task(chosen), "doc_id bigint, positive boolean, words bigint, x array<int>, times array<int>")
    inputs = work.write(inputs, "inputs")
    weights = None
    if n is not None and n.p:
        start = np.column_stack([start_weights(counts, chosen, n.n, n.p, prior)] * CLASSIFIERS)
        weights = train(_total(inputs, work, len(chosen), held, folds), start, prior)
    scored = inputs.mapInArrow(_score_task(weights, len(chosen)), "doc_id bigint, score double")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that aren't predicted to be toxic, with the columns they had.

    Decisions are taken by doc_id, for the most toxic of its rows; null is an id like others.
    """
    work = Workspace(documents.sparkSession, "without-toxic")
    toxic = toxicity_scores(documents, labels).where("predicted = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    toxic = maybe_broadcast(work.write(toxic, "toxic"))
    return documents.join(toxic, documents["doc_id"].cast("bigint").eqNullSafe(toxic["toxic_id"]), "left_anti")
