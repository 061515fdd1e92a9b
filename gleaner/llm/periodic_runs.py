"""Runs of repeating words in texts, by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(6, 4 q) long, that
no neighbouring word extends. It holds each of its words four times at least. So a word that occurs less than four times in a
segment of a text is in no run of this segment and splits it. In the smaller segments further words are too rare; they
are split until nothing changes. Few words of ordinary text survive. What survives is scanned for every possible lag.

The scan of lag q looks at every q-th word only: a run of this period holds four of these places in a row, with equal words. The
rare places that have them are extended word by word. A segment of m words so takes m (1 + 1/2 + 1/3 + ...) comparisons at
most, and not m * m, whatever it holds.

A text is worked on as a whole within its row, so nothing is shuffled and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has four periods and six words at least; so it holds each of its words four times.
PERIODS, LEAST = 4, 6
#: Bytes of text whose words are held at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def surviving_segments(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ``codes`` that hold each of their words four times. ``owner``: the text of each word."""
    done: list[tuple[int, int]] = []
    places, segment = np.arange(len(codes)), owner
    while len(places):
        # Words of one segment are neighbours, so a sort by segment and word is a sort within segments.
        order = np.lexsort((codes[places], segment))
        word, part = codes[places[order]], segment[order]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (part[1:] != part[:-1]))))
        times = np.diff(np.append(new, len(order)))
        frequent = np.empty(len(order), bool)
        frequent[order] = np.repeat(times >= PERIODS, times)
        # A segment without a rare word is stable; only the others go on.
        broken = np.zeros(int(segment[-1]) + 1, bool)
        broken[segment[~frequent]] = True
        stable = ~broken[segment]
        done += _stretches(places[stable], segment[stable])
        left = frequent & ~stable
        places, segment = places[left], segment[left]
        kept = _stretches(places, segment)
        places = np.concatenate([np.arange(i, j) for i, j in kept]) if kept else places[:0]
        segment = np.repeat(np.arange(len(kept)), [j - i for i, j in kept]) if kept else places
    return sorted(done)


def _stretches(places: np.ndarray, segment: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of neighbouring ``places`` of one segment that are long enough for a run."""
    if not len(places):
        return []
    first = np.flatnonzero(np.concatenate(([True], (places[1:] != places[:-1] + 1) | (segment[1:] != segment[:-1]))))
    begin, end = places[first], places[np.append(first[1:], len(places)) - 1] + 1
    long = end - begin >= LEAST
    return list(zip(begin[long].tolist(), end[long].tolist()))


def _equal_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of ``a`` and ``b`` are equal."""
    n = min(len(a), len(b))
    a, b, at, step = a[:n], b[:n], 0, 16
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a segment, given as numbers of words."""
    n, found = len(words), []
    until = np.zeros(n, np.int64)  # the last end of the runs that hold a place
    for q in range(1, n // PERIODS + 1):
        nth = words[::q]
        equal = nth[1:] == nth[:-1]
        hits = np.flatnonzero(equal[2:] & equal[1:-1] & equal[:-2]) * q
        # Within a run of a smaller period, this lag can only give the same run, as its period then divides q.
        hits = hits[until[hits] <= hits + (PERIODS - 1) * q]
        for probe in {q // 3, q // 2, q - 1} - {0}:
            if not len(hits):
                break
            hits = hits[(words[hits + probe] == words[hits + probe + q]) & (words[hits + probe + q] == words[hits + probe + 2 * q])]
        seen = 0
        for at in hits.tolist():
            if at + (PERIODS - 1) * q < seen:
                continue
            end = at + q + _equal_for(words[at:], words[at + q :])
            if end <= at + (PERIODS - 1) * q:
                continue
            start = at - _equal_for(words[:at][::-1], words[q : at + q][::-1])
            seen = end
            if end - start >= max(LEAST, PERIODS * q):
                found.append((start, end - start, q))
                until[start:end] = np.maximum(until[start:end], end)
    return found


def runs_of(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of all texts, by start, then period; places count from the first word of all."""
    return sorted((begin + s, length, q) for begin, end in surviving_segments(codes, owner) for s, length, q in lag_scan(codes[begin:end]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run is cut to its first period."""
    keep = np.ones(n, bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return keep


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text or b"")
        size += len(chunk[-1])
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first = 0
        for chunk in _chunks(batch.column("text").to_pylist()):
            split = [text.split() for text in chunk]  # of bytes: at the six ASCII blanks
            words = [w for text in split for w in text]
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            counts = np.array([len(s) for s in split])
            begin = np.concatenate(([0], np.cumsum(counts)))
            runs: list[list] = [[] for _ in chunk]
            every = runs_of(codes, np.repeat(np.arange(len(chunk)), counts))
            for (start, length, q), i in zip(every, (np.searchsorted(begin, [r[0] for r in every], side="right") - 1).tolist()):
                runs[i].append((start - int(begin[i]), length, q))
            texts = []
            for text, own, found in zip(chunk, split, runs):
                kept = collapsed(len(own), found) if found else None
                texts.append(b" ".join(own if kept is None else [own[i] for i in np.flatnonzero(kept)]))
            lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], _RUNS)
            columns = [batch.column("doc_id").slice(first, len(chunk)), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
            first += len(chunk)


_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, runs, collapsed.

    Words are what stands between the six ASCII blanks, and are compared byte by byte. ``runs`` holds (start, length, period) in
    words, numbered from 0, by start, then period. ``collapsed`` is the text without the words that any run holds after its first
    period, joined by one blank; without runs, all words. A null or empty text, or one of blanks, has no words, no runs and
    an empty collapsed text. Repeated rows and null ids are rows like others. An empty table gives an empty result; other
    columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_task, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def longest(runs_column: str = "runs") -> Column:
    """The run with the greatest length, of these the first by start, then period; null without runs."""
    order = F.transform(runs_column, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r.alias("run")))
    return F.array_min(order)["run"]
