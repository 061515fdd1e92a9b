"""Quality scores by a regularised quadratic discriminant over statistics of the text.

Each class of labelled documents has a mean and a covariance of transformed statistics. The covariances are shrunk towards the
pooled one and towards a multiple of the identity, and factorised once. The score of a document is the logistic of the
difference of the log densities, which are Mahalanobis distances from triangular solves, and of the class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.textbytes import BLANK, Texts, slices, span_hashes
from gleaner.session import Workspace

STATISTICS = (
    "words",
    "bytes_per_word",
    "spread_of_word_bytes",
    "letters",
    "capitals",
    "digits",
    "stops",
    "calls",
    "bars",
    "signs",
    "other_ascii",
    "beyond_ascii",
    "words_per_line",
    "words_per_stop",
    "distinct_words",
    "repeated_next",
    "commonest_word",
    "repeated_line_bytes",
)
#: Shares shrunk towards the pooled covariance and towards a multiple of the identity.
POOLED, ROUND = 0.3, 0.05
#: Standardised statistics are cut here, so that one odd statistic doesn't decide alone.
REACH = 6.0

#: Kinds of bytes: 0 other ASCII, 1 small letters, 2 digits, 3 stops, 4 calls, 5 bars, 6 signs, 7 capitals, 8 beyond ASCII, 9 blanks.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[128:], _KIND[BLANK] = 1, 7, 8, 9
for _kind, _bytes in ((2, b"0123456789"), (3, b".,;:?"), (4, b"!"), (5, b"|"), (6, b"#$%&*@^~_=+<>{}[]\\")):
    _KIND[list(_bytes)] = _kind


def statistics(texts: Texts) -> np.ndarray:
    """A row of ``STATISTICS`` for each text, transformed: logarithms of counts and of shares with a small floor."""
    n, data = len(texts), texts.data
    lengths = np.diff(texts.offsets)
    owner = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(owner * 10 + _KIND[data], minlength=n * 10).reshape(n, 10).astype(float)
    starts, ends, text = texts.spans(~BLANK[data])
    size = (ends - starts).astype(float)
    count = np.bincount(text, minlength=n).astype(float)
    some = np.maximum(count, 1)
    mean = np.bincount(text, size, n) / some
    spread = np.sqrt(np.maximum(np.bincount(text, size * size, n) / some - mean**2, 0))

    sums = texts.prefix_sums(data)
    hashes = span_hashes(sums, starts, ends)
    again = np.bincount(text[1:], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]), n)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[new], minlength=n)
    at = np.flatnonzero(new)
    commonest = np.zeros(n)
    np.maximum.at(commonest, t[at], np.diff(np.append(at, len(h))))

    l_starts, l_ends, l_text = texts.spans(data != 10)
    l_hash = span_hashes(sums, l_starts, l_ends)
    order = np.lexsort((l_hash, l_text))
    same = np.zeros(len(order), bool)
    same[1:] = (l_hash[order][1:] == l_hash[order][:-1]) & (l_text[order][1:] == l_text[order][:-1])
    repeated = np.bincount(l_text[order], same * (l_ends - l_starts)[order], n)
    lines = np.maximum(np.bincount(l_text, minlength=n), 1)

    total = np.maximum(lengths, 1)
    share = lambda x, of: np.log(x / of + 1e-3)
    columns = (
        np.log1p(count),
        np.log1p(mean),
        np.log1p(spread),
        *(share(kinds[:, k], total) for k in (1, 7, 2, 3, 4, 5, 6, 0, 8)),
        np.log1p(count / lines),
        np.log1p(count / (kinds[:, 3] + 1)),
        share(distinct, some),
        share(again, some),
        share(commonest, some),
        share(repeated, total),
    )
    return np.column_stack(columns)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            rows = statistics(texts)
            flat = pa.array(rows.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)), lists], ["doc_id", "x"])


def document_features(documents: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text, null as empty."""
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_features, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("label").to_numpy()
        one = np.column_stack((np.ones(len(x)), x))
        for k in (0, 1):
            sums[k] += one[y == k].T @ one[y == k]
    k, i, j = np.indices(sums.shape)
    columns = [pa.array(a.ravel().astype(np.int32)) for a in (k, i, j)] + [pa.array(sums.ravel())]
    yield pa.RecordBatch.from_arrays(columns, ["k", "i", "j", "s"])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        z = np.clip((x - self.centre) / self.scale, -REACH, REACH)
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(sums: np.ndarray, pooled: float = POOLED, rounded: float = ROUND) -> Discriminant | None:
    """The model from the two classes' moment matrices (of 1 and x); None when a class has no rows."""
    counts = sums[:, 0, 0]
    if (counts < 1).any():
        return None
    d = sums.shape[1] - 1
    both = sums.sum(axis=0)
    centre = both[0, 1:] / both[0, 0]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre**2, 1e-12))
    raw = sums[:, 0, 1:] / counts[:, None]
    means = (raw - centre) / scale
    spreads = np.array([(s[1:, 1:] / n - np.outer(m, m)) / np.outer(scale, scale) for s, n, m in zip(sums, counts, raw)])
    shared = np.tensordot(counts / counts.sum(), spreads, 1)
    factors, constants = [], []
    for s, n in zip(spreads, counts):
        s = (1 - pooled - rounded) * s + pooled * shared + rounded * (np.trace(s) / d + 1e-3) * np.eye(d)
        cholesky = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(cholesky))
        constants.append(np.log(n / counts.sum()) - np.log(np.diag(cholesky)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(constants))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant of ``labels`` (doc_id, label 0 or 1) over stored ``features``; other labels and null ids are left out.

    Every labelled row counts, also a repeated one. Only sums of products reach the driver.
    """
    marked = labels.where(F.col("label").isin(0, 1)).select(F.col("doc_id").cast("bigint"), F.col("label").cast("int"))
    parts = features.join(marked, "doc_id").select("x", "label").mapInArrow(_moments, "k int, i int, j int, s double")
    d = len(STATISTICS) + 1
    sums = np.zeros((2, d, d))
    for row in parts.groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect():
        sums[row.k, row.i, row.j] = row.s
    return discriminant(sums)


def _score_task(model: Discriminant | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            s = np.full(len(x), 0.5) if model is None else model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return score


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` has doc_id and quality; only rows outside the fold ``held`` are learnt from. A null or empty text has the
    statistics of an empty text and is scored by them. Equal texts get equal scores. Where one class has no row to learn
    from, every score is 0.5. A null id is not held out. An empty table gives an empty result; other columns are not read.
    """
    work = Workspace(documents.sparkSession, "quality")
    features = work.write(document_features(documents), "features")
    train = labels.where(fold(F.col("doc_id"), folds) != held).select("doc_id", F.col("quality").alias("label"))
    model = fit(features, train)
    scored = features.mapInArrow(_score_task(model), "doc_id bigint, score double")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
